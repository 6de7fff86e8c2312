"""The result cache, the .npy data source and top-k from SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from farsight.functions import topk
from farsight.operators import search
from farsight.sources import cache, npy
from farsight.sources import vectors as sources


def test_cache_follows_the_table(spark, tmp_path):
    path, held = f"file://{tmp_path}/table", cache.ResultCache(spark, f"file://{tmp_path}/cache")
    spark.range(10).write.parquet(path)
    calls = []

    def total():
        calls.append(1)
        return spark.read.parquet(path).agg(F.sum("id").alias("total"))

    def ask(k=1):
        result, hit = held.get(cache.cache_key(table=cache.table_fingerprint(spark, path), query="sum", k=k), total)
        return result.first()["total"], hit

    assert [ask(), ask(), ask(2)] == [(45, False), (45, True), (45, False)] and len(calls) == 2
    spark.range(10, 12).write.mode("append").parquet(path)
    assert ask() == (66, False) and ask() == (66, True)
    key = cache.cache_key(table=cache.table_fingerprint(spark, path), query="sum", k=1)
    (part,) = (tmp_path / "cache" / key / "rows").glob("part-*")
    part.write_bytes(part.read_bytes()[:40])  # torn
    (tmp_path / "cache" / key / "rows" / f".{part.name}.crc").unlink()
    assert held.load(key) is None and ask() == (66, False) and ask() == (66, True)
    for x in (tmp_path / "cache" / key / "manifest").glob("*"):
        x.unlink()
    assert ask() == (66, False)
    assert not list((tmp_path / "cache").glob("writing-*"))


def test_fingerprints_do_not_depend_on_order(spark):
    a = sources.queries_of(spark, [[1.0], [2.0], [3.0]])
    assert cache.vectors_fingerprint(a) == cache.vectors_fingerprint(a.orderBy(F.desc("query_id"))) != cache.vectors_fingerprint(a.limit(2))
    assert cache.cache_key(a=1, b=[2]) == cache.cache_key(b=[2], a=1) != cache.cache_key(a=1, b=[3])


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
def test_npy_files_are_read_by_row_ranges(spark, tmp_path, dtype):
    npy.register(spark)
    x = np.random.default_rng(1).normal(size=(1000, 7)).astype(dtype)
    np.save(tmp_path / "x.npy", x)
    df = spark.read.format("npy_vectors").option("rows", 300).load(str(tmp_path / "x.npy"))
    assert df.rdd.getNumPartitions() == 4
    rows = df.orderBy("vec_id").collect()
    assert [r["vec_id"] for r in rows] == list(range(1000)) and np.array_equal(np.array([r["embedding"] for r in rows], np.float32), x.astype(np.float32))


def test_npy_round_trip_and_manifest(spark, tmp_path):
    npy.register(spark)
    path = f"file://{tmp_path}/set"
    made = sources.clustered(spark, 5000, 6).select("vec_id", "embedding").repartition(5)
    made.write.format("npy_vectors").mode("append").save(path)
    manifest = json.loads((tmp_path / "set" / "manifest.json").read_text())
    assert (manifest["rows"], manifest["dim"]) == (5000, 6) and len(manifest["parts"]) == 5
    back = spark.read.format("npy_vectors").load(path)
    digest = lambda df: df.select(F.xxhash64("embedding").alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    assert digest(back) == digest(made) and back.select("vec_id").distinct().count() == 5000
    with pytest.raises(Exception, match="already"):
        made.write.format("npy_vectors").mode("append").save(path)
    made.limit(10).write.format("npy_vectors").mode("overwrite").save(path)
    assert spark.read.format("npy_vectors").load(path).count() == 10


def test_a_failed_task_leaves_no_manifest(spark, tmp_path):
    npy.register(spark)
    bad = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="size"):
        bad.coalesce(1).write.format("npy_vectors").mode("append").save(f"file://{tmp_path}/bad")
    assert not (tmp_path / "bad" / "manifest.json").exists()
    with pytest.raises(Exception, match="manifest"):
        spark.read.format("npy_vectors").load(f"file://{tmp_path}/bad").count()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_top_k_from_sql_is_that_of_the_operator(spark, metric):
    topk.register(spark)
    base = sources.clustered(spark, 9000, 5)
    base.createOrReplaceTempView("made_vectors")
    queries = sources.clustered_queries(spark, 4, 5)
    literal = "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in r["qvec"]) + ")" for r in queries.orderBy("query_id").collect()) + ")"
    found = spark.sql(topk.top_k_sql("made_vectors", k=6, queries=literal, where="passes_filter", metric=metric, parts=3))
    expected = search.exact(base, queries, 6, F.col("passes_filter"), metric=metric)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.select("query_id", "rank", "vec_id", "distance").collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(query_no" in plan
