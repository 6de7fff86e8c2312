"""Shapes of filtered vector searches in a statement log, without the values they were run with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r'"?([A-Za-z_]\w*)"?'
_ORDER = rf"(?is)\border\s+by\s+(?:\w+\.)?{_NAME}\s*(<->|<#>|<=>|<\+>|<~>|<%>)"
_TABLE = rf"(?is)\bfrom\s+((?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*)"
_WHERE = r"(?is)\bwhere\s+(.*?)\s*\border\s+by\b"
_LIMIT = r"(?is)\blimit\s+(\S+?)\s*;?\s*$"
_NESTED = r"(?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+"
_VALUE = r"\$\d+|'(?:[^']|'')*'(?:::\w+)?|[+-]?\d+(?:\.\d+)?|true|false"


def top_statements(log: DataFrame, *, min_calls: int = 1, limit: int = 100) -> DataFrame:
    """Log rows (queryid, query, calls, rows, total_exec_time_ms[, mean_exec_time_ms]) by total time, then calls."""
    mean = F.col("total_exec_time_ms") / F.nullif(F.col("calls"), F.lit(0))
    if "mean_exec_time_ms" in log.columns:
        mean = F.coalesce("mean_exec_time_ms", mean)
    return log.where(F.col("calls") >= min_calls).withColumn("mean_exec_time_ms", mean).orderBy(F.desc("total_exec_time_ms"), F.desc("calls"), "queryid").limit(limit)


def _value_kind(v: Column) -> Column:
    return F.when(v.rlike(r"^\$\d+$"), "parameter").when(v.rlike(rf"(?i)^(?:{_VALUE})$"), "constant").otherwise("expression")


def _predicate(p: Column) -> Column:
    """(column, kind, operator, value_kind) of one conjunct; kind is null where it is not supported."""
    compared = rf"(?is)^{_NAME}\s*(=|<=|>=|<|>)\s*({_VALUE})$"
    within = rf"(?is)^{_NAME}\s+(in)\s*\((.*)\)$"
    between = rf"(?is)^{_NAME}\s+(between)\s+({_VALUE})\s*\x01\s*({_VALUE})$"
    make = lambda c, kind, op, value: F.struct(c.alias("column"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), op.alias("operator"), value.alias("value_kind"))
    g = lambda pattern, i: F.regexp_extract(p, pattern, i)
    op = g(compared, 2)
    none = F.lit(None).cast("string")
    listed = F.when(g(within, 3).rlike(r"^\s*\$\d+(\s*,\s*\$\d+)*\s*$"), "parameter").when(g(within, 3).contains("$"), "mixed_list").otherwise("list")
    return (
        F.when(p.rlike(compared), make(g(compared, 1), F.when(op == "=", "eq").otherwise("range"), op, _value_kind(g(compared, 3))))
        .when(p.rlike(between), make(g(between, 1), "between", F.lit("between"), _value_kind(g(between, 3))))
        .when(p.rlike(within), make(g(within, 1), "in", F.lit("in"), listed))
        .when(p.rlike(rf"^{_NAME}$"), make(g(rf"^{_NAME}$", 1), "bool", F.lit("true"), F.lit("constant")))
        .otherwise(make(none, none, none, none))
    )


def _reason(p: Column) -> Column:
    """Why a conjunct is not supported."""
    forms = {
        "subquery": r"\(subquery\)", "or": r"(?i)\bor\b", "null_test": r"(?i)\bis\s+(not\s+)?null\b", "pattern": r"(?i)\b(i?like|similar)\b|~", "negation": r"(?i)\bnot\b|<>|!=",
        "nested_and": r"(?i)\band\b", "function": r"\w\s*\(",
    }
    return F.coalesce(*(F.when(p.rlike(form), F.lit(name)) for name, form in forms.items()), F.lit("other"))


def _masked(query: Column) -> Column:
    """A statement in one line without comments, the contents of quoted texts and of sub-queries."""
    q = F.regexp_replace(F.coalesce(query, F.lit("")), "'(?:[^']|'')*+'", "'_'")
    q = F.trim(F.regexp_replace(F.regexp_replace(q, r"(?s)/\*.*?\*/|--[^\n]*", " "), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(q, rf"(?i)\(\s*select\b{_NESTED}\)", "(subquery)"), r"\s*;$", "")


def _rejection(q: Column) -> Column:
    """Why a masked statement is no vector search; null if it is one."""
    return F.when(q.contains(";"), "several_statements").when(~q.rlike(r"(?i)^(select|with)\b"), "no_select").when(~q.rlike(_ORDER), "no_vector_order")


def _conjuncts(where: Column) -> Column:
    """The conjuncts of a condition: AND within brackets or of a BETWEEN parts none, and a condition with OR outside of brackets is one."""
    kept = F.regexp_replace(where, rf"(?i)(between\s+(?:{_VALUE}))\s+and\s+", "$1 \u0001 ")
    open_ = lambda p: F.length(F.regexp_replace(p, r"[^(]", "")) - F.length(F.regexp_replace(p, r"[^)]", ""))

    def add(seen: Column, p: Column) -> Column:
        joined = F.when(seen["open"] == "", p).otherwise(F.concat(seen["open"], F.lit(" AND "), p))
        whole = open_(joined) <= 0
        return F.struct(F.when(whole, F.array_append(seen["done"], joined)).otherwise(seen["done"]).alias("done"), F.when(whole, F.lit("")).otherwise(joined).alias("open"))

    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    parts = F.aggregate(F.split(kept, r"(?i)\s+and\s+"), none, add, lambda seen: F.when(seen["open"] == "", seen["done"]).otherwise(F.array_append(seen["done"], seen["open"])))
    outside = F.regexp_replace(where, rf"\({_NESTED}\)", "()")
    parts = F.when(outside.rlike(r"(?i)\bor\b"), F.array(where)).otherwise(parts)
    # brackets around a single comparison say nothing
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"^\(\s*([^()]*?)\s*\)$", "$1")), lambda p: p != "")


def shapes(log: DataFrame) -> DataFrame:
    """One row per vector search of the log: fingerprint, table, vector_column, operator, limit, predicates, template and counters.

    Statements without a distance operator in their ORDER BY, or of several parts, give no row. `unsupported` names the
    forms of conjuncts that `predicates` leaves out.
    """
    one = log.withColumn("q_", _masked(F.col("query"))).where(_rejection(F.col("q_")).isNull())
    parts = _conjuncts(F.regexp_extract("q_", _WHERE, 1))
    one = one.withColumn("parts_", F.transform(parts, lambda p: F.struct(F.when(~p.contains("(subquery)"), _predicate(p)).alias("is"), _reason(p).alias("reason"))))
    supported = F.transform(F.filter("parts_", lambda p: p["is"]["kind"].isNotNull()), lambda p: p["is"])
    unsupported = F.sort_array(F.transform(F.filter("parts_", lambda p: p["is"]["kind"].isNull()), lambda p: p["reason"]))
    limit = F.regexp_extract("q_", _LIMIT, 1)
    limit_kind = F.when(limit == "", "absent").when(limit.rlike(r"^\d+$"), "constant").when(limit.rlike(r"^\$\d+$"), "parameter").otherwise("other")
    shown = F.transform(supported, lambda p: F.when(p["kind"] == "bool", p["column"]).when(p["kind"] == "in", F.concat(p["column"], F.lit(" IN (<value>)"))).when(p["kind"] == "between", F.concat(p["column"], F.lit(" BETWEEN <value> AND <value>"))).otherwise(F.concat_ws(" ", p["column"], p["operator"], F.lit("<value>"))))
    shaped = one.select(
        "queryid", F.regexp_extract("q_", _TABLE, 1).alias("table"), F.regexp_extract("q_", _ORDER, 1).alias("vector_column"), F.regexp_extract("q_", _ORDER, 2).alias("operator"),
        F.struct(limit_kind.alias("kind"), F.when(limit_kind == "constant", limit.cast("int")).alias("value")).alias("limit"), supported.alias("predicates"),
        unsupported.alias("unsupported"), F.size(unsupported).alias("n_unsupported"), F.array_join(shown, " AND ").alias("template"), "calls", "rows", "total_exec_time_ms",
    )
    identity = F.to_json(F.struct("table", "vector_column", "operator", "limit", "predicates", "unsupported"))
    return shaped.select(F.substring(F.sha2(identity, 256), 1, 24).alias("fingerprint"), "*")


def report(log: DataFrame) -> DataFrame:
    """(outcome, reason, n_statements, calls, rows, total_exec_time_ms) of all statements of a log.

    Outcomes: complete (every conjunct has a shape), partial by the form left out (a statement with several such
    forms counts for each), rejected by the reason why it is no vector search.
    """
    why = _rejection(_masked(F.col("query")))
    rejected = log.select(F.lit("rejected").alias("outcome"), why.alias("reason"), "calls", "rows", "total_exec_time_ms").where("reason is not null")
    reasons = F.when(F.col("n_unsupported") == 0, F.array(F.lit(""))).otherwise(F.array_distinct("unsupported"))
    outcome = F.when(F.col("n_unsupported") == 0, "complete").otherwise("partial")
    shaped = shapes(log).select(outcome.alias("outcome"), F.explode(reasons).alias("reason"), "calls", "rows", "total_exec_time_ms")
    return rejected.unionAll(shaped).groupBy("outcome", "reason").agg(
        F.count("*").alias("n_statements"), F.sum("calls").alias("calls"), F.sum("rows").alias("rows"), F.sum("total_exec_time_ms").alias("total_exec_time_ms")
    )


def roll_up(shaped: DataFrame) -> DataFrame:
    """Shapes with equal fingerprints as one row with their summed counters."""
    return shaped.groupBy("fingerprint", "table", "vector_column", "operator", "template").agg(
        F.count("*").alias("n_statements"), F.sum("calls").alias("calls"), F.sum("rows").alias("rows"), F.sum("total_exec_time_ms").alias("total_exec_time_ms")
    )
