import numpy as np
import pytest
from pyspark.sql import functions as F

from farsight.functions import vectors
from farsight.operators import metrics, search
from farsight.plans import observe
from farsight.sources import layouts
from farsight.sources import vectors as sources


def _base(spark, points, mask=None):
    rows = [(i, [float(x) for x in p], True if mask is None else mask[i]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, ok boolean")


def test_masked_top_k(spark):
    r = np.random.default_rng(17)
    points, mask = r.normal(size=(90, 3)), r.random(90) < 0.4
    wanted = r.normal(size=(4, 3))
    found = search.exact(_base(spark, points.astype(np.float32), mask.tolist()), sources.queries_of(spark, wanted.tolist()), 7, F.col("ok")).orderBy("query_id", "rank").collect()
    expected = []
    for q, v in enumerate(wanted):
        far = [(float(np.sqrt(((np.float32(p).astype(float) - v) ** 2).sum())), i) for i, p in enumerate(points) if mask[i]]
        expected += [(q, i, round(d, 9)) for d, i in sorted(far)[:7]]
    assert [(x["query_id"], x["vec_id"], round(x["distance"], 9)) for x in found] == expected


def test_fewer_rows_than_k_and_ties_by_id(spark):
    base = _base(spark, [[1, 0], [1, 0], [1, 0]], [False, True, True])
    found = search.exact(base, sources.queries_of(spark, [[0, 0]]), 3, F.col("ok")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 2]


def test_null_vectors_are_never_found(spark):
    base = spark.createDataFrame([(0, None), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in search.nearest_to(base, [0.0], 5).collect()] == [1]
    assert [r["vec_id"] for r in search.top_k(base, sources.queries_of(spark, [[0.0]]), 5).collect()] == [1]


def test_sizes_must_agree(spark):
    base = _base(spark, [[1, 2]])
    with pytest.raises(Exception, match="different sizes"):
        search.nearest_to(base, [1.0], 1).collect()
    with pytest.raises(Exception, match="elements"):
        search.top_k(base, sources.queries_of(spark, [[1.0]]), 1).collect()


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_kernels_agree_with_expressions(spark, metric):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 37)).astype(np.float32)
    base = _base(spark, x)
    q = r.normal(size=37)
    a = {r["vec_id"]: r["distance"] for r in search.nearest_to(base, q.tolist(), 200, metric=metric).collect()}
    b = {r["vec_id"]: r["distance"] for r in search.top_k(base, sources.queries_of(spark, [q.tolist()]), 200, metric=metric).collect()}
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_blocks_of_queries_change_nothing(spark):
    base = sources.clustered(spark, 500, 4, clusters=3)
    q = sources.clustered_queries(spark, 9, 4, clusters=3)
    whole, parts = (sorted(map(tuple, search.top_k(base, q, 3, block=n).collect())) for n in (100, 2))
    assert whole == parts and len(whole) == 27


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_gives_the_shuffle_k_rows_for_each_query(spark, small_batches, monkeypatch):
    given, ranked = [], search.ranked_top_k
    monkeypatch.setattr(search, "ranked_top_k", lambda spark, found, k: given.extend(found) or ranked(spark, found, k))
    base = _base(spark, np.random.default_rng(5).normal(size=(100, 3))).coalesce(1)
    assert search.top_k(base, sources.queries_of(spark, [[0, 0, 0], [1, 1, 1]]), 4).count() == 8
    assert [g.count() for g in given] == [8]


def test_many_queries_are_not_left_to_one_task(spark, monkeypatch):
    given, ranked = [], search.ranked_top_k
    monkeypatch.setattr(search, "ranked_top_k", lambda spark, found, k: given.extend(found) or ranked(spark, found, k))
    points = np.random.default_rng(6).normal(size=(search.TILE + 1, 3))
    assert search.top_k(_base(spark, points).coalesce(1), sources.queries_of(spark, points.tolist()), 2).count() == 2 * len(points)
    assert len(given) == 1 and given[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_copies_and_odd_rows_rank_as_one_by_one(spark, small_batches, metric):
    r = np.random.default_rng(7)
    points = r.normal(size=(60, 5)).astype(np.float32)[r.integers(0, 60, 300)]
    points[::41] = np.nan
    points[1::67, 2] = np.inf
    wanted = points[np.isfinite(points).all(axis=1)][:3].astype(np.float64)
    found = search.top_k(_base(spark, points), sources.queries_of(spark, wanted.tolist()), 40, metric=metric).orderBy("query_id", "rank").collect()
    for q, v in enumerate(wanted):
        d = vectors.paired_distances(points.astype(np.float64), np.broadcast_to(v, points.shape), metric)
        order = np.lexsort((np.arange(len(d)), d))[:40]
        if not (d[order] == -np.inf).any():
            assert [x["vec_id"] for x in found if x["query_id"] == q] == order.tolist()


def test_rows_at_no_distance_come_last(spark):
    base = _base(spark, [[np.nan, 0]] * 5 + [[1, 0], [2, 0]]).coalesce(1)
    assert [r["vec_id"] for r in search.top_k(base, sources.queries_of(spark, [[0, 0]]), 4).orderBy("rank").collect()] == [5, 6, 0, 1]


def test_strategies_and_quality(spark):
    base = sources.clustered(spark, 2000, 6, clusters=5, selectivity=0.1, correlation=-0.5)
    q = sources.clustered_queries(spark, 5, 6, clusters=5)
    passes = F.col("passes_filter")
    truth = search.exact(base, q, 10, passes)
    post = search.postfilter(base, q, 10, passes, ef=40)
    iterated = search.iterative(base, q, 10, passes, ef=40, max_scan=2000)
    best = metrics.summary(metrics.per_query(truth, iterated, q, 10)).first()
    assert best["recall_at_k"] == 1.0 and best["returns_k_rate"] == 1.0
    assert metrics.summary(metrics.per_query(truth, post, q, 10)).first()["recall_at_k"] <= 1.0


def test_no_truth_means_full_recall(spark):
    base = _base(spark, [[0, 0]], [False])
    q = sources.queries_of(spark, [[0, 0]])
    row = metrics.per_query(search.exact(base, q, 2, F.col("ok")), search.postfilter(base, q, 2, F.col("ok")), q, 2).first()
    assert (row["n_truth"], row["recall"], row["returns_k"]) == (0, 1.0, True)


def test_plans_show_the_strategy(spark, tmp_path):
    base = sources.clustered(spark, 300, 4, clusters=3).select("vec_id", "cluster_id", "passes_filter", "embedding")
    base.write.parquet(str(tmp_path / "base"))
    stored = spark.read.parquet(str(tmp_path / "base"))
    zero = [0.0] * 4
    exact = search.nearest_to(stored, zero, 5, where=F.col("passes_filter"))
    assert observe.strategy_of(exact) == "exact"
    assert "passes_filter" in observe.scans(exact)[0]["pushed"]
    assert observe.strategy_of(search.nearest_to(stored, zero, 40).join(stored, "vec_id").where("passes_filter")) in ("postfilter", "exact")
    copy = layouts.write_filtered(stored, F.col("passes_filter"), str(tmp_path / "copy"))
    assert observe.strategy_of(search.nearest_to(spark.read.parquet(copy.path), zero, 5), (copy.path,)) == "partial"
    parted = layouts.write_partitioned(stored, "cluster_id", str(tmp_path / "parted"))
    pruned = search.nearest_to(spark.read.parquet(parted.path), zero, 5, where=F.col("cluster_id") == 1)
    assert observe.strategy_of(pruned) == "partition"
    assert sorted(r[0] for r in pruned.select("vec_id").collect()) == sorted(r[0] for r in search.nearest_to(stored, zero, 5, where=F.col("cluster_id") == 1).select("vec_id").collect())


def test_lists_by_centre_find_all_with_all_probes(spark, tmp_path):
    base = sources.clustered(spark, 400, 4, clusters=4)
    q = sources.clustered_queries(spark, 3, 4, clusters=4)
    centres = layouts.fit_centres(base, 4)
    layouts.write_by_centre(base, centres, str(tmp_path / "lists"))
    found = layouts.search_by_centre(spark, str(tmp_path / "lists"), centres, q, 5, probes=4)
    assert sorted((r["query_id"], r["vec_id"]) for r in found.collect()) == sorted((r["query_id"], r["vec_id"]) for r in search.top_k(base, q, 5).collect())


def test_lists_by_centre_reach_the_recall_asked_for(spark, sf_dir):
    from farsight import catalog

    found = catalog.QUERIES["ann_by_centre"](spark, sf_dir).first()
    assert found["recall_at_k"] >= 0.9 and found["returns_k_rate"] == 1.0


def test_lists_by_centre_without_queries_or_in_small_blocks(spark, tmp_path):
    base = sources.clustered(spark, 300, 4, clusters=4)
    q = sources.clustered_queries(spark, 5, 4, clusters=4)
    centres = layouts.fit_centres(base, 4)
    layouts.write_by_centre(base, centres, str(tmp_path / "lists"))
    found = [sorted((r["query_id"], r["rank"], r["vec_id"]) for r in layouts.search_by_centre(spark, str(tmp_path / "lists"), centres, q, 3, probes=2, block=b).collect()) for b in (2, 256)]
    assert found[0] == found[1] and len(found[0]) == 15
    assert layouts.search_by_centre(spark, str(tmp_path / "lists"), centres, q.limit(0), 3, probes=2).count() == 0
    nearest = {r["vec_id"]: r["least"] for r in search.nearest_query(base, q, block=2).collect()}
    plain = {r["vec_id"]: r["least"] for r in search.nearest_query(base, q).collect()}
    assert nearest == plain and len(plain) == 300
    first = search.top_k(base, q, 1).agg(F.min("distance")).first()[0]
    assert abs(min(plain.values()) - first) < 1e-9


def test_probes_hold_the_rows_asked_for():
    assert [layouts.probes_for(m, 0, 500) for m in (1, 2, 4, 5, 100)] == [1, 2, 2, 3, 10]
    assert [layouts.probes_for(m, 10, 1000) for m in (1, 2, 200, 201, 5000)] == [1, 2, 2, 3, 10]
    assert layouts.probes_for(50, 1, 0) == 1 and layouts.probes_for(50, 8, 3) == 8
    with pytest.raises(ValueError):
        layouts.probes_for(0, 4, 10)


def test_reading_vectors(spark, tmp_path):
    assert sources.parse_vector("1, 2 3") == [1.0, 2.0, 3.0]
    assert sources.parse_vectors('{"vectors": [[1, 2], [3, 4]]}') == [[1.0, 2.0], [3.0, 4.0]]
    assert sources.parse_vectors("# no\n1 2\n3,4 # yes\n", most=1) == [[1.0, 2.0]]
    for bad in ("[true]", "[]", "nan 1"):
        with pytest.raises(ValueError):
            sources.parse_vector(bad)
    values, mask = np.random.default_rng(23).normal(size=(37, 5)).astype(np.float32), np.arange(37) % 4 == 1
    np.save(tmp_path / "v.npy", values)
    np.save(tmp_path / "m.npy", mask)
    rows = sources.vectors_from_npy(spark, str(tmp_path / "v.npy"), str(tmp_path / "m.npy")).orderBy("vec_id").collect()
    assert np.array_equal(np.array([r["embedding"] for r in rows], np.float32), values) and [r["passes_filter"] for r in rows] == mask.tolist()
    assert sources.queries_from_file(spark, str(tmp_path / "v.npy"), most=2).count() == 2
    assert sources.queries_from_sql(spark, "SELECT array(1.0, 2.0) AS v").first()["qvec"] == [1.0, 2.0]
    with pytest.raises(ValueError):
        sources.queries_from_sql(spark, "DROP TABLE x")


def test_clustered_selectivity_follows(spark):
    for selectivity, correlation in ((0.1, 0.3), (0.35, -0.9), (0.6, 0.0)):
        chances = sources.cluster_chances(11, selectivity, correlation)
        assert abs(chances.mean() - selectivity) < 1e-6 and (chances[0] > chances[-1]) == (correlation > 0)
        share = sources.clustered(spark, 3000, 3, clusters=11, selectivity=selectivity, correlation=correlation).agg(F.avg(F.col("passes_filter").cast("double"))).first()[0]
        assert abs(share - selectivity) < 0.06
