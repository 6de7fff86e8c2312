"""Shelves, the resumable scan and the neighbour graph against brute force."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farsight.operators import metrics, resumable, search
from farsight.sources import graph, shelves
from farsight.sources import vectors as sources


def _plain(rows, queries, k, max_scan, passes):
    out = {}
    for q, v in queries:
        order = sorted((float(np.sqrt(((np.array(x, float) - np.array(v)) ** 2).sum())), i, lab) for i, x, lab in rows if x is not None)[:max_scan]
        out[q] = [i for _, i, lab in order if passes(lab)][:k]
    return out


def _by_query(found, queries):
    out = {q: [] for q, _ in queries}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append(r["vec_id"])
    return out


@pytest.mark.parametrize("max_scan", [7, 40, 5000])
def test_scan_finds_the_first_that_pass_and_reads_no_shelf_twice(spark, tmp_path, max_scan):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(0, 6, 3)], None if i % 11 == 0 else int(r.integers(0, 5))) for i in range(700)]  # many ties
    rows += [(1000 + i, [2.0, 2.0, 2.0], 4) for i in range(150)] + [(2000, None, 1)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("extra", F.lit("kept"))
    queries = [(i, [float(x) for x in r.normal(2, 2, 3)]) for i in range(25)]
    made = shelves.write_shelves(base, f"file://{tmp_path}/shelves", lists=6, shelf_rows=32)
    assert made.size.sum() == 850 and made.size.max() <= 32 and made.rows.select("vec_id", "extra").distinct().count() == 850
    q = spark.createDataFrame(queries, "query_id long, qvec array<double>")
    scan = resumable.iterative_scan(made, q, 5, F.col("label") == 1, f"file://{tmp_path}/rounds", max_scan=max_scan, first=1, growth=2)
    assert _by_query(scan.found, queries) == _plain(rows, queries, 5, max_scan, lambda lab: lab == 1)
    reads = scan.reads
    assert reads.count() == reads.select("query_id", "shelf").distinct().count() and scan.rounds > 1
    old = search.iterative(base, q, 5, F.col("label") == 1, ef=4, max_scan=max_scan)
    assert _by_query(scan.found, queries) == _by_query(old, queries)


def test_scan_leaves_far_shelves_alone(spark, tmp_path):
    base = sources.clustered(spark, 6000, 8, clusters=12, selectivity=0.5, spread=0.01)
    queries = sources.clustered_queries(spark, 20, 8, clusters=12, spread=0.01)
    made = shelves.write_shelves(base, f"file://{tmp_path}/shelves", lists=12, shelf_rows=128)
    scan = resumable.iterative_scan(made, queries, 5, F.col("passes_filter"), f"file://{tmp_path}/rounds", max_scan=100, first=1, growth=2)
    truth = search.exact(base, queries, 5, F.col("passes_filter"))
    assert sorted(map(tuple, scan.found.select("query_id", "rank", "vec_id").collect())) == sorted(map(tuple, truth.select("query_id", "rank", "vec_id").collect()))
    assert scan.reads.count() < 0.4 * 20 * len(made.number)


def test_scan_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    made = shelves.write_shelves(empty, f"file://{tmp_path}/shelves")
    q = sources.queries_of(spark, [[0.0, 1.0]])
    assert resumable.iterative_scan(made, q, 5, F.lit(True), f"file://{tmp_path}/rounds").found.count() == 0
    one = shelves.write_shelves(spark.createDataFrame([(4, [1.0, 1.0], 1)], empty.schema), f"file://{tmp_path}/one")
    assert resumable.iterative_scan(one, q.limit(0), 5, F.lit(True), f"file://{tmp_path}/none").found.count() == 0
    assert [r["vec_id"] for r in resumable.iterative_scan(one, q, 5, F.lit(True), f"file://{tmp_path}/some").found.collect()] == [4]


def test_links_reach_every_row():
    x = np.random.default_rng(4).normal(size=(500, 6))
    links = graph.link_rows(x)
    seen, ahead = {0}, [0]
    while ahead:
        for j in links[ahead.pop()]:
            if j >= 0 and int(j) not in seen:
                seen.add(int(j))
                ahead.append(int(j))
    assert len(seen) == 500
    same = graph.link_rows(np.zeros((40, 3)))
    assert ((same >= -1) & (same < 40)).all() and (graph.link_rows(np.zeros((1, 3))) == -1).all()


def test_best_first_with_a_wide_frontier_is_exact():
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 5))
    at, d, compared = graph.best_first(x, graph.link_rows(x), np.zeros(5), 300, np.array([0]))
    assert len(at) == compared == 300 and (np.diff(d) >= 0).all()
    assert np.allclose(d, np.sort((x**2).sum(axis=1)))


def test_graph_search_has_recall_for_few_comparisons(spark, tmp_path):
    base = sources.clustered(spark, 12_000, 16, clusters=24, selectivity=0.4, spread=0.3)
    made = graph.write_graph(base, f"file://{tmp_path}/graph", shelf_rows=2048)
    q = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qvec"))
    found, compared = graph.search_graph(made, q, 10, ef=48, probes=5)
    recall = metrics.summary(metrics.per_query(search.top_k(base, q, 10), found, q, 10)).first()["recall_at_k"]
    share = compared.agg(F.avg("compared")).first()[0] / 12_000
    print(f"recall {recall:.4f} at {share:.4f} of all comparisons")
    assert recall >= 0.9 and share < 0.2
    passing, _ = graph.search_graph(made, q, 10, ef=48, probes=5, passes=F.col("passes_filter"))
    assert passing.join(base.where("passes_filter"), "vec_id", "left_anti").count() == 0 and passing.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 10


def test_graph_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    made = graph.write_graph(empty, f"file://{tmp_path}/graph")
    found, compared = graph.search_graph(made, sources.queries_of(spark, [[0.0]]), 3)
    assert found.count() == 0 and compared.count() == 0


def test_queries_that_start_from_a_row_stand_its_absence(spark, tmp_path):
    from farsight import catalog
    from farsight.sources import layouts

    rows = [(i, [float(i), 1.0], i % 5) for i in range(5, 30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    for name in ("src2_single_search", "dsg1_projection_tail"):
        assert catalog.QUERIES[name](spark, f"file://{tmp_path}").count() == 0
    assert len(layouts.fit_centres(spark.createDataFrame([], "vec_id long, embedding array<float>"), 3)) == 0


def test_asks_of_a_shelf_are_answered_by_tile():
    r = np.random.default_rng(4)
    x, v = r.normal(size=(300, 6)), r.normal(size=(2 * search.TILE + 5, 6))
    bounds = [None if i % 3 else 2.0 for i in range(len(v))]
    asks = pa.RecordBatch.from_pydict({"query_id": pa.array(range(len(v)), pa.int64()), "qvec": v.tolist(), "bound": pa.array(bounds, pa.float64())})
    frames = list(resumable.nearest_in_shelf(x, np.arange(300), np.ones(300, bool), asks, 20))
    assert max(map(len, frames)) <= 20 * search.TILE
    found = {q: part["vec_id"].tolist() for q, part in pd.concat(frames).groupby("query_id")}
    for q, bound in enumerate(bounds):
        d = np.sqrt(((x - v[q]) ** 2).sum(axis=1))
        assert found.get(q, []) == [i for i in np.argsort(d, kind="stable")[:20] if bound is None or d[i] <= bound]


def _directory(r, n):
    low = r.uniform(0, 2, n)
    return shelves.Shelves(None, r.normal(size=(40, 6)), 7 * np.arange(n), r.integers(0, 40, n), low, low + r.uniform(0, 0.1, n), np.ones(n, int))


def test_asks_are_given_out_in_small_batches_however_many_shelves():
    r, n = np.random.default_rng(8), 3000
    known = _directory(r, n)
    v = r.normal(size=(300, 6))
    bounds, done = [(None, np.inf, 1.0, 0.2)[i % 4] for i in range(300)], [(i % 5) * 8 for i in range(300)]
    asks = pa.RecordBatch.from_pydict({"query_id": pa.array(range(300), pa.int64()), "qvec": v.tolist(), "bound": pa.array(bounds, pa.float64()), "done": pa.array(done, pa.int64())})
    cells = []

    def pick(known, gaps, some):
        cells.append(gaps.shape[0] * n)
        return resumable.ahead(512)(known, gaps, some)

    batches = list(shelves.route(known, asks, pick))
    assert max(b.num_rows for b in batches) <= shelves.ASKS < sum(b.num_rows for b in batches) and max(cells) <= shelves.CELLS
    found = {i: [] for i in range(300)}
    for b in batches:
        for shelf, q, own in zip(b.column("shelf").to_pylist(), b.column("query_id").to_pylist(), b.column("qvec").to_pylist(), strict=True):
            assert own == v[q].tolist()
            found[q].append(shelf)
    least = known.bounds(known.gaps(v))
    for q in range(300):
        order = np.argsort(least[q], kind="stable")[done[q] : done[q] + 512]
        assert found[q] == [7 * i for i in order if bounds[q] is None or least[q][i] <= bounds[q]]


def test_walks_are_routed_a_part_of_the_queries_at_a_time():
    r, n = np.random.default_rng(9), 3000
    known, v, cells = _directory(r, n), r.normal(size=(300, 6)), []

    def pick(known, gaps, some):
        cells.append(gaps.shape[0] * n)
        return graph.nearest_shelves(4)(known, gaps, some)

    found = [x for b in shelves.route(known, pa.RecordBatch.from_pydict({"qvec": v.tolist()}), pick) for x in b.column("shelf").to_pylist()]
    assert len(cells) > 1 and max(cells) <= shelves.CELLS
    gaps = known.gaps(v)
    near = np.lexsort((known.bounds(gaps), gaps[:, known.centre]), axis=1)[:, :4]
    assert found == known.number[near].ravel().tolist()
