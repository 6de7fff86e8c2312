"""Restricted filters: conjunctions of literal comparisons, read by Spark's own parser.

A filter becomes both a list of predicates, for estimating, and a Column, for running. OR, NOT, IS NULL, LIKE,
functions, comparisons of two columns, qualified names and parameters are refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter outside the supported form."""


@dataclass(frozen=True)
class Predicate:
    """column op values; op is one of = < <= > >= in between true."""

    column: str
    op: str
    values: tuple

    def to_column(self) -> Column:
        c, v = F.col(f"`{self.column.replace('`', '``')}`"), self.values
        if self.op == "in":
            return c.isin(*v)
        if self.op == "between":
            return c.between(*v)
        if self.op == "true":
            return c
        return {"=": c.__eq__, "<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__}[self.op](v[0])

    def to_sql(self) -> str:
        name = '"' + self.column.replace('"', '""') + '"'
        shown = [sql_literal(x) for x in self.values]
        if self.op == "in":
            return f"{name} IN ({', '.join(shown)})"
        if self.op == "between":
            return f"{name} BETWEEN {shown[0]} AND {shown[1]}"
        return name if self.op == "true" else f"{name} {self.op} {shown[0]}"


def sql_literal(value) -> str:
    """A text, number or truth value as SQL text; numbers in their shortest form that reads back equal."""
    if isinstance(value, str):
        return "'{}'".format(value.replace("'", "''"))
    try:
        return json.dumps(value, allow_nan=False)
    except ValueError as e:
        raise FilterError("only finite numbers can be written") from e


_COMPARE = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
_TURNED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _children(node) -> list:
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _literal(node):
    """The Python value of a literal, below any casts; None if it is no literal."""
    while _kind(node) in ("Cast", "UnaryMinus", "UnaryPositive"):
        if _kind(node) == "UnaryMinus":
            got = _literal(_children(node)[0])
            return None if got is None else (-got[0],)
        node = _children(node)[0]
    if _kind(node) != "Literal":
        return None
    value, kind = node.value(), node.dataType().simpleString()
    if value is None:
        raise FilterError("NULL literals are not supported")
    if kind == "boolean":
        return (bool(value),)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return (int(value),)
    if kind.startswith("decimal") or kind in ("float", "double"):
        return (float(str(value)),)
    if kind == "string":
        return (value.toString(),)
    return (node.toString(),)  # dates and timestamps by their text


def _column(node, columns: list[str]) -> str | None:
    if _kind(node) != "UnresolvedAttribute":
        return None
    parts = node.nameParts()
    if parts.size() != 1:
        raise FilterError(f"qualified names are not supported: {node.sql()}")
    name = parts.apply(0)
    if name not in columns:
        raise FilterError(f"unknown column {name!r}")
    return name


def parse_filter(spark: SparkSession, text: str, columns: list[str]) -> tuple[Predicate, ...]:
    """The predicates of a filter over these columns (names compare by case)."""
    if not text or not text.strip():
        raise FilterError("the filter is empty")
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception as e:
        raise FilterError(f"not one valid expression: {text!r}") from e

    def walk(node) -> list[Predicate]:
        kind = _kind(node)
        if kind == "And":
            parts = [p for c in _children(node) for p in walk(c)]
            return parts
        if kind in _COMPARE:
            left, right = _children(node)
            op = _COMPARE[kind]
            if (name := _column(left, columns)) is not None and (value := _literal(right)) is not None:
                return [Predicate(name, op, value)]
            if (name := _column(right, columns)) is not None and (value := _literal(left)) is not None:
                return [Predicate(name, _TURNED[op], value)]
        if kind in ("In", "Between") or (kind == "UnresolvedFunction" and node.nameParts().apply(0) == "between"):
            first, *rest = _children(node)
            values = [_literal(x) for x in rest]
            if (name := _column(first, columns)) is not None and all(v is not None for v in values):
                return [Predicate(name, "in" if kind == "In" else "between", tuple(v[0] for v in values))]
        if (name := _column(node, columns)) is not None:
            return [Predicate(name, "true", (True,))]
        raise FilterError(f"not supported in a filter: {node.sql()}")

    return tuple(_merged(walk(tree)))


def _merged(predicates: list[Predicate]) -> list[Predicate]:
    """`a >= x AND a <= y` side by side, which is how BETWEEN is read, as one predicate."""
    out: list[Predicate] = []
    for p in predicates:
        if out and (last := out[-1]).column == p.column and (last.op, p.op) == (">=", "<="):
            out[-1] = Predicate(p.column, "between", (last.values[0], p.values[0]))
        else:
            out.append(p)
    return out


def to_column(predicates: tuple[Predicate, ...]) -> Column:
    """The conjunction as a Column."""
    return reduce(and_, (p.to_column() for p in predicates), F.lit(True)) if predicates else F.lit(True)


def filter_columns(predicates: tuple[Predicate, ...]) -> list[str]:
    """The distinct columns, in order."""
    return list(dict.fromkeys(p.column for p in predicates))
