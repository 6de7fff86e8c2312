"""The cost model of the retrieval strategies as column expressions, so that whole grids of cases are ranked at once.

A case is a row: n_rows, s_global, s_local (shares of rows that pass, overall and near the query), s_index and
s_partition (shares that a filtered copy or the pruned partitions hold; null where there is none), k, ef, max_scan.
Costs are in microseconds; the constants come from a calibration on the engine at hand.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from pathlib import Path
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 1e-12
#: Of equal costs the earlier one is taken.
STRATEGIES = ("exact", "partition", "partial", "postfilter", "iterative_relaxed", "iterative_strict")


@dataclass(frozen=True)
class Calibration:
    """Cost constants and the measured recall by frontier size (ascending, recall never falling)."""

    c_d: float = 0.1
    c_scan: float = 0.1
    c_h: float = 4.0
    delta_strict: float = 0.0
    recall_curve: tuple[tuple[int, float], ...] = ((10, 0.7), (20, 0.85), (40, 0.95), (80, 0.98), (160, 0.99))
    dataset_id: str = "default"
    version: int = 1

    def __post_init__(self):
        efs = [e for e, _ in self.recall_curve]
        recalls = [r for _, r in self.recall_curve]
        if not efs or efs != sorted(set(efs)) or efs[0] < 1 or recalls != sorted(recalls) or not 0 < recalls[0] <= recalls[-1] <= 1:
            raise ValueError("the recall curve must ascend")
        if min(self.c_d, self.c_scan, self.c_h) <= 0 or self.delta_strict < 0:
            raise ValueError("cost constants must be positive")

    def recall_at(self, ef: float) -> float:
        """Linear between the measured points, flat outside."""
        curve = self.recall_curve
        if ef <= curve[0][0]:
            return curve[0][1]
        for (a, ra), (b, rb) in zip(curve, curve[1:], strict=False):
            if ef <= b:
                return ra + (rb - ra) * (ef - a) / (b - a)
        return curve[-1][1]

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2) + "\n")

    @classmethod
    def load(cls, path: str) -> Calibration:
        held = json.loads(Path(path).read_text())
        unknown = set(held) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        if held.get("version", 1) != 1:
            raise ValueError("only version 1 is known")
        return cls(**held | {"recall_curve": tuple((int(e), float(r)) for e, r in held["recall_curve"])})


def recall_column(cal: Calibration, ef: Column) -> Column:
    """Calibration.recall_at as an expression."""
    curve = cal.recall_curve
    out = F.when(ef <= curve[0][0], F.lit(float(curve[0][1])))
    for (a, ra), (b, rb) in zip(curve, curve[1:], strict=False):
        out = out.when(ef <= b, F.lit(float(ra)) + F.lit(float(rb - ra)) * (ef - a) / F.lit(float(b - a)))
    return out.otherwise(F.lit(float(curve[-1][1])))


def estimates(cases: DataFrame, cal: Calibration) -> DataFrame:
    """`cases` times strategies: strategy, priority, latency_us, recall, returns_k. Strategies a case has no layout for are left out."""
    c = F.col
    n, k, ef = c("n_rows").cast("double"), c("k").cast("double"), c("ef").cast("double")
    at_ef = recall_column(cal, c("ef"))
    log = lambda x: F.log(F.greatest(x, F.lit(2.0)))
    passing = F.greatest(F.lit(1.0), n * F.greatest(c("s_global"), F.lit(LEAST)))
    survivors = c("s_local") * ef
    candidates = k / F.greatest(c("s_local"), F.lit(LEAST))
    capped = candidates > c("max_scan")
    walk = cal.c_d * cal.c_h

    def case(name: str, latency: Column, recall: Column, returns_k: Column) -> Column:
        return F.struct(F.lit(name).alias("strategy"), F.lit(STRATEGIES.index(name)).alias("priority"), latency.alias("latency_us"), recall.alias("recall"), returns_k.alias("returns_k"))

    iterative = walk * log(n) * candidates
    iterative_recall = at_ef * F.when(capped, F.least(F.lit(1.0), c("s_local") * c("max_scan") / F.greatest(k, F.lit(1.0)))).otherwise(1.0)
    kept = lambda share: F.greatest(F.lit(1.0), n * F.greatest(share, F.lit(LEAST)))
    every = [
        case("exact", (cal.c_scan + cal.c_d) * passing + cal.c_scan * passing * F.log2(F.greatest(k, F.lit(2.0))), F.lit(1.0), F.lit(True)),
        case("postfilter", walk * ef * log(n), at_ef * F.least(F.lit(1.0), survivors / F.greatest(k, F.lit(1.0))), survivors >= k),
        case("iterative_relaxed", iterative, iterative_recall, ~capped),
        case("iterative_strict", iterative * (1 + cal.delta_strict), iterative_recall, ~capped),
        F.when(c("s_index").isNotNull(), case("partial", walk * ef * log(kept(c("s_index"))), at_ef, F.lit(True))),
        F.when(c("s_partition").isNotNull(), case("partition", walk * ef * log(kept(c("s_partition"))), at_ef, F.lit(True))),
    ]
    return cases.select("*", F.inline(F.filter(F.array(*every), lambda x: x.isNotNull())))


def best(estimated: DataFrame, keys: list[str], target: float) -> DataFrame:
    """(keys..., winner): the cheapest strategy that returns k rows at the target recall; exact where none does."""
    viable = F.col("returns_k") & (F.col("recall") >= target)
    order = F.struct(F.round("latency_us", 9), "priority")
    cheapest = F.min(F.when(viable, F.struct(order.alias("order"), F.col("strategy")))).alias("least")
    return estimated.groupBy(*keys).agg(cheapest).select(*keys, F.coalesce("least.strategy", F.lit("exact")).alias("winner"))


def frontier_for(cal: Calibration, target: float, least: int, k: int, s_local: float | None = None) -> int:
    """The smallest measured frontier of at least `least` (and k / s_local) that reaches the target; else the largest."""
    floor = max(least, math.ceil(k / max(s_local, LEAST)) if s_local is not None else 0)
    reach = [e for e, r in cal.recall_curve if e >= floor and r >= target]
    return reach[0] if reach else max(floor, cal.recall_curve[-1][0])


def fit(n_rows: int, share: float, k: int, exact_us: float, post: list[tuple[int, float, float]], dataset_id: str = "measured") -> Calibration:
    """A calibration from one exact latency and (frontier, latency, recall) measurements."""
    if n_rows < 2 or not 0 < share <= 1 or exact_us <= 0 or not post:
        raise ValueError("a calibration needs rows, a share, an exact latency and frontiers")
    c = exact_us / (n_rows * share * (2 + math.log2(max(k, 2))))
    c_h = median(us / (c * ef * math.log(n_rows)) for ef, us, _ in post)
    curve, reached = [], 0.0
    for ef, _, recall in sorted(post):
        reached = max(reached, recall)
        curve.append((ef, min(1.0, max(reached, 1e-6))))
    return Calibration(c, c, c_h, 0.0, tuple(curve), dataset_id)
