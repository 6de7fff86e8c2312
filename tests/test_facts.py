"""Facts from footers, mergeable sketches and measured runs on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from farsight.operators import search, timed
from farsight.plans import observe
from farsight.sources import facts, sketches


@pytest.fixture
def table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    r = np.random.default_rng(1)
    rows = [(i, int(r.zipf(1.6) % 500), ["a", "b", None][i % 3], float(r.normal()), i % 4) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, value int, tag string, x double, part int")
    df.repartition(3).write.partitionBy("part").parquet(path)
    return path


def _more(spark, path, n, start=10_000):
    spark.range(start, start + n).select("id", F.lit(9999).alias("value"), F.lit("new").alias("tag"), F.lit(0.5).alias("x"), F.lit(1).alias("part")).coalesce(1).write.mode("append").partitionBy("part").parquet(path)


def test_facts_equal_counts(spark, table):
    df = spark.read.parquet(table)
    assert facts.partition_keys(spark, table) == ["part"] and facts.partition_keys(spark, f"{table}/part=1") == []
    found = facts.files(spark, table)
    assert {r["part"]: r["n"] for r in found.groupBy("part").agg(F.sum("n_rows").alias("n")).collect()} == {i: 1500 for i in range(4)}
    one = facts.relation_facts(spark, table).first()
    assert (one["n_files"], one["n_rows"]) == (12, 6000) and one["n_bytes"] > 0 and one["modified"] is not None
    assert all(s["schema"] == "struct<>" for s in observe.scans(found))
    by = {r["column_name"]: r for r in facts.column_facts(spark, table, ["id", "value", "x", "tag", "part"]).collect()}
    low, high, n = df.agg(F.min("value"), F.max("value"), F.count("value")).first()
    assert set(by) == {"id", "value", "x"} and (by["value"]["low"], by["value"]["high"], by["value"]["n_values"], by["value"]["n_rows"]) == (str(low), str(high), n, 6000)
    assert "PushedAggregation: [COUNT(*)" in observe.plan_text(facts.column_facts(spark, table, ["id"]))


def test_freshness_follows_files(spark, table, tmp_path):
    snapshot = facts.files(spark, table)
    snapshot.write.parquet(f"file://{tmp_path}/snapshot")
    snapshot = spark.read.parquet(f"file://{tmp_path}/snapshot")
    assert facts.freshness(None, facts.files(spark, table)) == "never_analyzed"
    assert facts.freshness(snapshot, facts.files(spark, table)) == "fresh"
    _more(spark, table, 900)
    assert facts.freshness(snapshot, facts.files(spark, table)) == "fresh"
    _more(spark, table, 1200, 20_000)
    now = facts.files(spark, table)
    assert facts.freshness(snapshot, now) == "stale" and tuple(facts.changed_rows(snapshot, now).first()) == (6000, 8100, 2100)


def test_dimensions(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [3.0, 4.0], "b")], "id long, v array<float>, t string")
    assert facts.vector_dimension(df) == 2 and facts.vector_dimension(df, "v") == 2 and facts.vector_dimension(df.drop("v")) == 0 and facts.vector_dimension(df.limit(0)) == 0
    with pytest.raises(ValueError, match="named"):
        facts.vector_dimension(df, "t")
    with pytest.raises(ValueError, match="1 to 2"):
        facts.vector_dimension(df.unionAll(spark.createDataFrame([(3, [1.0], "")], df.schema)))


def test_sketches_merge_and_read_only_new_files(spark, table, tmp_path):
    store = sketches.Store(spark, table, f"file://{tmp_path}/store", ("id", "value", "tag", "x", "part"), (("tag", "part"),))
    assert len(store.refresh()) == 12 and store.refresh() == []
    df = spark.read.parquet(table)
    by = {r["column_name"]: r for r in store.statistics(10, 50).collect()}
    assert by["id"]["n_rows"] == 6000 and abs(by["id"]["n_distinct"] / 6000 - 1) < 0.05 and round(by["tag"]["null_frac"], 9) == round(1 / 3, 9)
    values = sorted(r["x"] for r in df.select("x").collect())
    for i, b in enumerate(by["x"]["bounds"]):
        assert abs(np.searchsorted(values, b) - i * 600) < 0.03 * 6000
    exact = {str(r["value"]): r["count"] for r in df.groupBy("value").count().collect()}
    assert all(exact[c["value"]] == c["n"] for c in by["value"]["common"]) and len(by["value"]["common"]) == 50 and by["tag"]["bounds"] is None
    shares = sketches.group_shares(store.statistics(), ("tag", "part"))
    joint = {(r["tag"], str(r["part"])): r["count"] / 6000 for r in df.where("tag is not null").groupBy("tag", "part").count().collect()}
    assert shares == joint
    _more(spark, table, 500)
    assert len(store.refresh()) == 1
    after = {r["column_name"]: r for r in store.statistics(10, 50).collect()}
    assert after["id"]["n_rows"] == 6500 and ("9999", 500) in [(c["value"], c["n"]) for c in after["value"]["common"]]
    # files that go are left out
    spark.read.parquet(table).where("part = 1").limit(0).write.mode("overwrite").parquet(f"{table}/part=1")
    assert {r["n_rows"] for r in store.statistics().select("n_rows").collect()} == {4500}


def test_runs_are_told_by_rows_and_bytes(spark, table, tmp_path):
    df = spark.read.parquet(table)
    runs = timed.timed_runs(spark, {"whole": lambda: df.select("id", "x"), "part": lambda: df.where("part = 1").select("id"), "twice": lambda: df.select("id").unionAll(df.select("id"))}, 2)
    by = {r["strategy"]: r for r in timed.summarised(runs, 10).collect()}
    assert {n: r["rows_read"] for n, r in by.items()} == {"whole": 6000, "part": 1500, "twice": 12000} and all(r["repeats"] == 2 for r in by.values())
    assert 0 < by["part"]["bytes_read"] < by["whole"]["bytes_read"] and all(0 < r["p50_ms"] <= r["p95_ms"] for r in by.values())
    for name in ("runs.csv", "runs"):
        timed.save_runs(runs, f"file://{tmp_path}/{name}")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/runs.csv").count() == 6
    (part,) = (tmp_path / "runs").glob("part-*")
    assert json.loads(part.read_text().splitlines()[0])["strategy"] == "whole"


def test_a_calibration_from_runs(spark):
    summary = spark.createDataFrame([("exact", 5.0), ("postfilter_10", 1.0), ("postfilter_40", 4.0)], "strategy string, ms_per_query double")
    cal = timed.calibrated(summary, {10: 0.5, 40: 0.9}, n_rows=1000, share=0.25, k=4)
    assert cal.recall_curve == ((10, 0.5), (40, 0.9)) and cal.c_d == pytest.approx(5000 / (250 * 4)) and cal.c_h > 0
    assert search.top_k is not None
