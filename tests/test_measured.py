"""Measured sweeps, bounds by rank and SQL functions on small tables with ties, nulls and nothing at all."""

import random

import pytest
from pyspark.sql import functions as F

from farsight.functions import vectors
from farsight.operators import measured, search, statistics

SCHEMA = "vec_id long, embedding array<double>, label int"


def _plain(points, ids, filters, efs, k):
    """Recall and rows by filter and frontier, one query at a time."""
    out = {}
    for name, passes in filters.items():
        for ef in efs:
            recalls, found = [], []
            for q in ids:
                order = sorted(points, key=lambda p: (abs(p[1] - points[q][1]), p[0]))
                true = [p[0] for p in order if passes(p)][:k]
                got = [p[0] for p in order[:ef] if passes(p)][:k]
                recalls.append(len(set(true) & set(got)) / len(true) if true else 1.0)
                found.append(len(got))
            out[name, ef] = (round(sum(recalls) / len(ids), 9), round(sum(found) / len(ids), 9))
    return out


def test_sweep_is_that_of_one_query_at_a_time(spark):
    drawn = random.Random(3)
    # ties in the distance, and labels that are null
    points = [(i, float(drawn.randrange(12)), drawn.choice([None, 0, 1, 2])) for i in range(60)]
    base = spark.createDataFrame([(i, [x], n) for i, x, n in points], SCHEMA)
    ids = [0, 20, 40]
    queries = base.where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    filters = {"one": F.col("label") == 1, "none": F.col("label") == 9}
    found = measured.sweep(base, queries, filters, [2, 10, 60], 4).collect()
    plain = _plain(points, ids, {"one": lambda p: p[2] == 1, "none": lambda p: p[2] == 9}, [2, 10, 60], 4)
    assert {(r["filter"], r["ef"]): (round(r["recall"], 9), round(r["mean_results"], 9)) for r in found} == plain
    won = {r["filter"]: (r["winner"], r["ef"]) for r in measured.best(measured.sweep(base, queries, filters, [2, 10, 60], 4), F.lit(60), 0.9).collect()}
    assert won["none"] == ("exact", None)


def test_a_sweep_searches_once_however_many_filters(spark, monkeypatch):
    searched, top_k = [], search.top_k
    monkeypatch.setattr(search, "top_k", lambda *args, **options: searched.append(args[2]) or top_k(*args, **options))
    base = spark.createDataFrame([(i, [float(i)], i % 3) for i in range(12)] + [(12, None, 1)], SCHEMA)
    queries = base.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    # five rows are labelled 1, of which one has no vector; four of them are the truth
    found = measured.sweep(base, queries, {"one": F.col("label") == 1, "two": F.col("label") == 2}, [3, 12], 5).collect()
    assert {(r["filter"], r["ef"]): (r["recall"], r["returns_k"]) for r in found} == {("one", 3): (0.25, False), ("one", 12): (1.0, True), ("two", 3): (0.25, False), ("two", 12): (1.0, True)}
    assert searched == [12]


def test_sweep_of_nothing(spark):
    base = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([], "query_id long, qvec array<double>")
    assert measured.sweep(base, queries, {"one": F.col("label") == 1}, [2], 4).collect() == []


@pytest.mark.parametrize("values", [[], [5], [None, None], ["b", "a", "a", None, "c"], [1, 1, 1, 1, 2], list(range(101)), [drawn % 7 for drawn in range(50)]])
def test_bounds_by_rank(spark, values):
    kind = "string" if any(isinstance(v, str) for v in values) else "int"
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    held = sorted(v for v in values if v is not None)
    expected = [(i, held[i * (len(held) - 1) // 10]) for i in range(11)] if held else []
    assert sorted((r["bound_no"], r["bound"]) for r in statistics.ranked_bounds(df, "x", 10).collect()) == expected


def test_sql_functions(spark):
    names = vectors.register(spark)
    assert len(names) == 7
    one = spark.sql("SELECT vector_l2(array(0D, 3D), array(4D, 0D)) AS l2, vector_cosine(array(0D), array(1D)) AS cosine, bits_hamming(5L, 6L) AS hamming, bits_jaccard(0L, 0L) AS jaccard, vector_l1(NULL, array(1D)) AS none").first()
    assert (one.l2, one.cosine, one.hamming, one.jaccard, one.none) == (5.0, 1.0, 2, 0.0, None)
    with pytest.raises(Exception):
        spark.sql("SELECT vector_l2(array(1D, 2D), array(1D))").collect()


def test_bounds_of_many_values_are_those_of_one_buffer(spark, monkeypatch):
    drawn = random.Random(8)
    df = spark.createDataFrame([(drawn.choice([None, 7.0, drawn.gauss(0, 9)]), drawn.choice(["a", "b", None])) for _ in range(800)], "x double, s string")
    one = statistics.analyze(df, ["x", "s"], target=3, parts=20)
    placed, whole = [], statistics._placed
    monkeypatch.setattr(statistics, "_placed", lambda counts: placed.append(counts) or whole(counts))
    many = statistics.analyze(df, ["x", "s"], target=3, parts=20, most=50)
    assert one == many and len(placed) == 1 and one.columns["x"].common == (7.0,)
    rest = df.where("x <> 7").agg(F.percentile("x", F.array(*(F.lit(i / 20) for i in range(21))))).first()[0]
    assert list(many.columns["x"].bounds) == rest and statistics.analyze(df.where("false"), ["x"]).columns["x"].bounds == ()


def test_each_column_is_counted_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 AS a", "id % 3 = 0 AS b").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    spark.sparkContext.setJobGroup("analyze-once", "")
    try:
        statistics.analyze(df, ["a", "b"])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    from farsight.operators.timed import _group_totals

    assert _group_totals(spark, "analyze-once")[0] <= 2 * 100 + 2 * 10  # the table by column, and the kept counts
