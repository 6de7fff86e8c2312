"""The registered queries over the driver's tables, with the DuckDB SQL that gives the same rows.

The searches take the vectors with ids divisible by 20 as their stated queries, against all vectors, and `label in (1, 2, 3)` as their filter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farsight.functions import filters, topk, vectors
from farsight.operators import grid, local, measured, metrics, resumable, search, statistics, sweeps, timed, workload
from farsight.plans import costs, observe
from farsight.plans import recommend as advice
from farsight.sources import cache, facts, graph, layouts, npy, shelves, sketches
from farsight.sources import vectors as sources
from farsight.sources.shared import shared_base

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K, EF, MAX_SCAN, PROBE = 10, 40, 160, 50
_PASSES_SQL = "label IN (1, 2, 3)"


def _query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _passes():
    return F.col("label").isin(1, 2, 3)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")


def _queries(base: DataFrame) -> DataFrame:
    return base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qvec"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


_NEAR = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT query_id, vec_id, label, {distance} AS distance FROM q, embeddings {where})"""
_L2 = "list_distance(embedding::DOUBLE[], qvec)"


def _ranked_sql(distance: str = _L2, where: str = "", k: int = K) -> str:
    near = _NEAR.format(distance=distance, where=where)
    return f"""WITH {near}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near)
SELECT query_id, rank::INT AS rank, vec_id, round(distance, 6) AS distance FROM r WHERE rank <= {k}"""


def _frontier_sql(frontier: int) -> str:
    near = _NEAR.format(distance=_L2, where="")
    return f"""{near},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM near) WHERE place <= {frontier} AND {_PASSES_SQL}),
found AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, vec_id, distance FROM f)"""


@_query(_ranked_sql(where=f"WHERE {_PASSES_SQL}"))
def str1_exact(spark, sf_dir):
    """Filter first, then the k nearest by L2."""
    base = _base(spark, sf_dir)
    return _rounded(search.exact(base, _queries(base), K, _passes()))


@_query(f"WITH {_frontier_sql(EF)} SELECT query_id, rank::INT AS rank, vec_id, round(distance, 6) AS distance FROM found WHERE rank <= {K}")
def str2_postfilter(spark, sf_dir):
    """The first k that pass among the 40 nearest."""
    base = _base(spark, sf_dir)
    return _rounded(search.postfilter(base, _queries(base), K, _passes(), ef=EF))


@_query(f"WITH {_frontier_sql(MAX_SCAN)} SELECT query_id, rank::INT AS rank, vec_id, round(distance, 6) AS distance FROM found WHERE rank <= {K}")
def str3_iterative(spark, sf_dir):
    """Rounds over shelves of the table until no other can hold one of the first k that pass among the 160 nearest."""
    return _rounded(_iterative(spark, _base(spark, sf_dir)))


def _iterative(spark: SparkSession, base: DataFrame) -> DataFrame:
    shelved = shelves.write_shelves(base, _copy_path(spark, "shelves"))
    return resumable.iterative_scan(shelved, _queries(base), K, _passes(), _copy_path(spark, "rounds"), max_scan=MAX_SCAN).found


def _copy_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which goes when the session ends."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@_query(_ranked_sql(where=f"WHERE {_PASSES_SQL}"))
def str4_partial(spark, sf_dir):
    """The k nearest in a filtered copy of the table."""
    base = _base(spark, sf_dir)
    layout = layouts.write_filtered(base, _passes(), _copy_path(spark, "filtered"))
    return _rounded(search.top_k(spark.read.parquet(layout.path), _queries(base), K))


@_query(_ranked_sql(where=f"WHERE {_PASSES_SQL}"))
def str5_partition(spark, sf_dir):
    """The k nearest in a copy in folders by label, of which the filter prunes all but three."""
    base = _base(spark, sf_dir)
    layout = layouts.write_partitioned(base, "label", _copy_path(spark, "partitioned"))
    return _rounded(search.exact(spark.read.parquet(layout.path), _queries(base), K, _passes()))


@_query(_ranked_sql("-list_inner_product(embedding::DOUBLE[], qvec)"))
def top1_inner_product(spark, sf_dir):
    """The k nearest by inner product (its sign turned)."""
    base = _base(spark, sf_dir)
    return _rounded(search.top_k(base, _queries(base), K, metric="ip"))


@_query(_ranked_sql("list_cosine_distance(embedding::DOUBLE[], qvec)"))
def top1_cosine(spark, sf_dir):
    """The k nearest by cosine distance."""
    base = _base(spark, sf_dir)
    return _rounded(search.top_k(base, _queries(base), K, metric="cosine"))


@_query(
    f"""WITH one AS (SELECT embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings, one WHERE {_PASSES_SQL} ORDER BY {_L2}, vec_id LIMIT {K}"""
)
def src2_single_search(spark, sf_dir):
    """One query vector, in expressions only."""
    base = _base(spark, sf_dir)
    query = base.where("vec_id = 0").select("embedding").first()
    return search.nearest_to(base, query[0] if query else [], K if query else 0, where=_passes()).withColumn("distance", F.round("distance", 6))


@_query(
    """SELECT a.vec_id, round(list_distance(a.e, b.e), 6) AS l2, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS l2_squared,
round(list_inner_product(a.e, b.e), 6) AS ip, round(list_cosine_distance(a.e, b.e), 6) AS cosine,
round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 6) AS l1, round(sqrt(list_inner_product(a.e, a.e)), 6) AS norm,
bit_count(xor(a.vec_id, 85)) AS hamming, round(CASE WHEN (a.vec_id | 85) = 0 THEN 0.0 ELSE 1 - bit_count(a.vec_id & 85)::DOUBLE / bit_count(a.vec_id | 85) END, 6) AS jaccard
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1"""
)
def vec_functions(spark, sf_dir):
    """Every vector function, between each vector and the one with the next id."""
    a = _base(spark, sf_dir).select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    shown = {
        "l2": vectors.l2("embedding", "other"), "l2_squared": vectors.l2_squared("embedding", "other"), "ip": vectors.inner_product("embedding", "other"),
        "cosine": vectors.cosine("embedding", "other"), "l1": vectors.l1("embedding", "other"), "norm": vectors.norm("embedding"),
        "jaccard": vectors.jaccard(F.col("vec_id"), F.lit(85).cast("long")),
    }
    hamming = vectors.hamming(F.col("vec_id"), F.lit(85).cast("long")).cast("tinyint")
    return a.join(b, "vec_id").select("vec_id", *(F.round(c, 6).alias(n) for n, c in shown.items()), hamming.alias("hamming"))


_TRUTH_SQL = f"""t AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near WHERE {_PASSES_SQL}) WHERE rank <= {K})"""
_METRICS_SQL = f"""WITH {_frontier_sql(EF)}, {_TRUTH_SQL},
m AS (SELECT q.query_id, (SELECT count(*) FROM t WHERE t.query_id = q.query_id) AS n_truth, (SELECT count(*) FROM found f WHERE f.query_id = q.query_id AND rank <= {K}) AS n_found,
(SELECT count(*) FROM found f JOIN t USING (query_id, vec_id) WHERE f.query_id = q.query_id AND rank <= {K}) AS hits FROM q)"""


@_query(f"{_METRICS_SQL} SELECT *, CASE WHEN n_truth = 0 THEN 1.0::DOUBLE ELSE hits::DOUBLE / n_truth END AS recall, n_found >= least(n_truth, {K}) AS returns_k FROM m")
def agg6_recall_by_query(spark, sf_dir):
    """Recall and returned rows of the postfilter strategy, by query."""
    base = _base(spark, sf_dir)
    q = _queries(base)
    return metrics.per_query(search.exact(base, q, K, _passes()), search.postfilter(base, q, K, _passes(), ef=EF), q, K)


@_query(
    f"""{_METRICS_SQL} SELECT round(avg(CASE WHEN n_truth = 0 THEN 1.0 ELSE hits::DOUBLE / n_truth END), 6) AS recall_at_k,
round(avg((n_found >= least(n_truth, {K}))::INT), 6) AS returns_k_rate, round(avg(n_found), 6) AS mean_results FROM m"""
)
def agg7_quality(spark, sf_dir):
    """Mean recall, rate of full answers and mean number of rows."""
    found = metrics.summary(agg6_recall_by_query(spark, sf_dir))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


_RUN_SQL = """SELECT '{name}' AS strategy, round(avg(CASE WHEN n_truth = 0 THEN 1.0 ELSE hits::DOUBLE / n_truth END), 6) AS recall_at_k, round(avg((n_found >= least(n_truth, {k}))::INT), 6) AS returns_k_rate, round(avg(n_found), 6) AS mean_results FROM
(SELECT q.query_id, (SELECT count(*) FROM t WHERE t.query_id = q.query_id) AS n_truth, (SELECT count(*) FROM {found} f WHERE f.query_id = q.query_id) AS n_found, (SELECT count(*) FROM {found} f JOIN t USING (query_id, vec_id) WHERE f.query_id = q.query_id) AS hits FROM q)"""


def _first_sql(name: str, frontier: int) -> str:
    """The first k that pass among so many nearest rows."""
    return f"""{name} AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM placed WHERE place <= {frontier} AND {_PASSES_SQL}) WHERE rank <= {K})"""


@_query(
    f"""WITH {_NEAR.format(distance=_L2, where='')}, {_TRUTH_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM near), {_first_sql('few', EF)}, {_first_sql('more', MAX_SCAN)} """
    + " UNION ALL ".join(_RUN_SQL.format(name=n, found=f, k=K) for n, f in (("exact", "t"), ("postfilter", "few"), ("iterative", "more"), ("partial", "t"), ("partition", "t")))
)
def str7_measured_runs(spark, sf_dir):
    """Every strategy over the whole table: measured recall, share of queries with all k rows, and mean rows."""
    base = _base(spark, sf_dir)
    q = _queries(base)
    truth = search.exact(base, q, K, _passes())
    filtered = spark.read.parquet(layouts.write_filtered(base, _passes(), _copy_path(spark, "filtered")).path)
    parted = spark.read.parquet(layouts.write_partitioned(base, "label", _copy_path(spark, "partitioned")).path)
    runs = {
        "exact": truth, "postfilter": search.postfilter(base, q, K, _passes(), ef=EF), "iterative": _iterative(spark, base),
        "partial": search.top_k(filtered, q, K), "partition": search.exact(parted, q, K, _passes()),
    }
    rows = [metrics.summary(metrics.per_query(truth, found, q, K)).select(F.lit(name).alias("strategy"), *(F.round(c, 6).alias(c) for c in ("recall_at_k", "returns_k_rate", "mean_results"))) for name, found in runs.items()]
    return reduce(DataFrame.unionAll, rows)


def _runs(spark, base: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Every strategy as a run over copies that stand already."""
    q, root = _queries(base), _copy_path(spark, "rounds")
    filtered = spark.read.parquet(layouts.write_filtered(base, _passes(), _copy_path(spark, "filtered")).path)
    parted = spark.read.parquet(layouts.write_partitioned(base, "label", _copy_path(spark, "partitioned")).path)
    shelved, linked = shelves.write_shelves(base, _copy_path(spark, "shelves")), graph.write_graph(base, _copy_path(spark, "graph"))
    return {
        "exact": lambda: search.exact(base, q, K, _passes()), "postfilter": lambda: search.postfilter(base, q, K, _passes(), ef=EF),
        "iterative": lambda: resumable.iterative_scan(shelved, q, K, _passes(), f"{root}/{uuid.uuid4().hex}", max_scan=MAX_SCAN).found,
        "partial": lambda: search.top_k(filtered, q, K), "partition": lambda: search.exact(parted, q, K, _passes()),
        "graph": lambda: graph.search_graph(linked, q, K, ef=EF, passes=_passes())[0],
    }


@_query()
def str7_timed_runs(spark, sf_dir):
    """Every strategy with recall and returned rows beside what three repeats cost: rows and bytes read, p50 and p95 of time."""
    base = _base(spark, sf_dir)
    q, runs = _queries(base), _runs(spark, base)
    truth = _kept(runs["exact"]())
    quality = [metrics.summary(metrics.per_query(truth, run(), q, K)).withColumn("strategy", F.lit(name)) for name, run in runs.items()]
    summary = timed.summarised(timed.timed_runs(spark, runs, 3), q.count())
    return reduce(DataFrame.unionAll, quality).join(F.broadcast(summary), "strategy")  # a row for each strategy


@_query()
def cal3_measured_calibration(spark, sf_dir):
    """The cost model's constants and recall curve, fitted to timed runs of exact and of postfilter at five frontiers."""
    base = _base(spark, sf_dir)
    q = _queries(base)
    n, passing = base.agg(F.count("*"), F.count_if(_passes())).first()
    recalls = {r["ef"]: r["recall"] for r in _sweep(spark, sf_dir).where("filter = 'three'").collect()}  # a row for each frontier
    runs = {"exact": lambda: search.exact(base, q, K, _passes())} | {f"postfilter_{ef}": lambda ef=ef: search.postfilter(base, q, K, _passes(), ef=ef) for ef in recalls}
    cal = timed.calibrated(timed.summarised(timed.timed_runs(spark, runs, 3), q.count()), recalls, n_rows=n, share=passing / n, k=K)
    return spark.createDataFrame([(ef, r, cal.c_d, cal.c_scan, cal.c_h) for ef, r in cal.recall_curve], "ef int, recall double, c_d double, c_scan double, c_h double")


_FACTS = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM lineitem" for c in _FACTS))
def src4_column_facts(spark, sf_dir):
    """Counts and bounds of columns as the footers of the files have them."""
    found = facts.column_facts(spark, f"{sf_dir}/lineitem.parquet", list(_FACTS))
    return found.withColumn("low", F.col("low").cast("double")).withColumn("high", F.col("high").cast("double"))


@_query("SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def src4_relation_facts(spark, sf_dir):
    """Row counts of tables from footers and file listings, without a scan of any column."""
    one = lambda t: facts.relation_facts(spark, f"{sf_dir}/{t}.parquet").where("n_files > 0 and n_bytes > 0 and modified is not null").select(F.lit(t).alias("table_name"), "n_rows")
    return reduce(DataFrame.unionAll, map(one, ("orders", "lineitem", "events", "documents")))


@_query("SELECT 'label' AS partition_key, label::VARCHAR AS value, count(*) AS n_rows FROM embeddings GROUP BY label")
def src8_partition_keys(spark, sf_dir):
    """The keys that a copy is in folders by, and the rows under each of their values, from the file listing."""
    layout = layouts.write_partitioned(_base(spark, sf_dir), "label", _copy_path(spark, "partitioned"))
    (key,) = facts.partition_keys(spark, layout.path)
    return facts.files(spark, layout.path).groupBy(F.lit(key).alias("partition_key"), F.col(key).cast("string").alias("value")).agg(F.sum("n_rows").alias("n_rows"))


@_query("SELECT 'embedding' AS column_name, max(len(embedding))::INT AS dimension FROM embeddings")
def src9_dimension(spark, sf_dir):
    """The number of elements of the first column of vectors."""
    return spark.createDataFrame([("embedding", facts.vector_dimension(_base(spark, sf_dir)))], "column_name string, dimension int")


@_query(
    """WITH n AS (SELECT count(*) FILTER (o_orderkey % 4 <> 0) AS before, count(*) AS after FROM orders)
SELECT before AS snapshot_rows, after AS current_rows, after - before AS changed_rows, CASE WHEN after - before >= 1000 AND after - before >= 0.2 * greatest(1, before) THEN 'stale' ELSE 'fresh' END AS health FROM n"""
)
def sel17_freshness(spark, sf_dir):
    """What a snapshot of a table's files says after a quarter of its rows were appended."""
    orders, path = _table(spark, sf_dir, "orders"), _copy_path(spark, "orders")
    orders.where("o_orderkey % 4 <> 0").write.parquet(path)
    snapshot = _kept(facts.files(spark, path))
    orders.where("o_orderkey % 4 = 0").write.mode("append").parquet(path)
    changed = facts.changed_rows(snapshot, facts.files(spark, path))
    return changed.withColumn("health", F.lit(facts.freshness(snapshot, facts.files(spark, path))))


@_query()
def src5_sketched_statistics(spark, sf_dir):
    """Null share, distinct values, bounds of ten bins and the five most common values of columns, from merged sketches by file."""
    store = sketches.Store(spark, f"{sf_dir}/orders.parquet", _copy_path(spark, "sketches"), tuple(_PROFILED))
    store.refresh()
    return store.statistics(10, 5)


@_query(
    """SELECT value.o_orderstatus AS o_orderstatus, value.o_orderpriority AS o_orderpriority, n, round(n / (SELECT count(*) FROM orders), 9) AS share FROM
(SELECT {o_orderstatus: o_orderstatus, o_orderpriority: o_orderpriority} AS value, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1)"""
)
def src7_joint_statistics(spark, sf_dir):
    """Joint counts of two columns from sketches by file, of which half the files are added by a second run."""
    path, orders = _copy_path(spark, "orders"), _table(spark, sf_dir, "orders")
    group = ("o_orderstatus", "o_orderpriority")
    store = sketches.Store(spark, path, _copy_path(spark, "sketches"), (), (group,))
    for part in (0, 1):
        orders.where(F.pmod("o_orderkey", F.lit(2)) == part).write.mode("append").parquet(path)
        store.refresh()
    rows = store.statistics().select("n_rows", F.inline("common"))
    return rows.select(*(F.get_json_object("value", f"$.{c}").alias(c) for c in group), "n", F.round(F.col("n") / F.col("n_rows"), 9).alias("share"))


_PROBE_SQL = f"""p AS (SELECT query_id, count(*) AS sample_size, count(*) FILTER ({_PASSES_SQL}) AS passing FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM near) WHERE place <= {PROBE} GROUP BY query_id),
s AS (SELECT *, passing / sample_size AS s_local, 1 / sample_size AS floor, least(1.0::DOUBLE, sample_size / least({PROBE}, 200)) * least(1.0::DOUBLE, passing / 5) AS confidence FROM p)"""


@_query(f"WITH {_NEAR.format(distance=_L2, where='')}, {_PROBE_SQL} SELECT query_id, sample_size, passing, round(s_local, 9) AS s_local, round(floor, 9) AS floor, round(confidence, 9) AS confidence FROM s")
def loc1_probes(spark, sf_dir):
    """The share of each query's 50 nearest neighbours that passes, all in one search."""
    base = _base(spark, sf_dir)
    found = local.probes(base, _queries(base), PROBE, _passes())
    return found.select("query_id", "sample_size", "passing", *(F.round(c, 9).alias(c) for c in ("s_local", "floor", "confidence")))


@_query(
    f"""WITH {_NEAR.format(distance=_L2, where='')}, {_PROBE_SQL},
g AS (SELECT avg(({_PASSES_SQL})::INT) AS s_global FROM embeddings),
a AS (SELECT quantile_cont(s_local, 0.1) AS s_local_p10, quantile_cont(s_local, 0.5) AS s_local_median, least(1.0, count(*) / 16.0) * quantile_cont(confidence, 0.5) AS confidence,
sum(sample_size)::BIGINT AS sample_size, sum(passing)::BIGINT AS passing_rows, max(floor) AS resolution_floor FROM s)
SELECT round(s_local_p10, 9) AS s_local_p10, round(s_local_median, 9) AS s_local_median, round(confidence, 9) AS confidence, sample_size, passing_rows, round(resolution_floor, 9) AS resolution_floor,
round(s_global, 9) AS s_global, round(greatest(-1.0, least(1.0, (s_local_p10 / greatest(s_global, 1e-12) - 1) / (s_local_p10 / greatest(s_global, 1e-12) + 1))), 9) AS rho FROM a, g"""
)
def loc4_local_selectivity(spark, sf_dir):
    """The tenth percentile and median of local selectivity, and how it relates to the global one."""
    base = _base(spark, sf_dir)
    found = local.local_selectivity(base, _queries(base), PROBE, _passes())
    return found.select(*(c if c in ("sample_size", "passing_rows") else F.round(c, 9).alias(c) for c in found.columns))


_FILTERS = {
    "equal": "l_returnflag = 'R'",
    "turned": "30 < l_quantity",
    "range_and": "l_quantity >= 10 AND l_quantity < 20 AND l_discount <= 0.05",
    "between": "l_extendedprice BETWEEN 10000 AND 20000",
    "in_list": "l_linenumber IN (1, 3, 5)",
    "dates": "l_shipdate >= '1995-01-01' AND l_linestatus = 'O'",
}



@_query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({f}) AS n, round(avg(({f})::INT), 9) AS share FROM lineitem" for n, f in _FILTERS.items()))
def flt_filters(spark, sf_dir):
    """Rows and shares of parsed filters of every kind, counted in one pass over lineitem."""
    df = _table(spark, sf_dir, "lineitem")
    conditions = {n: filters.to_column(filters.parse_filter(spark, f, df.columns)) for n, f in _FILTERS.items()}
    one = df.agg(F.count("*").alias("all"), *(F.count_if(c).alias(n) for n, c in conditions.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n"), F.round(F.col(n) / F.col("all"), 9).alias("share")) for n in conditions))))


_PROFILED = ["o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"]


@_query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, round(1 - count({c}) / count(*), 9) AS null_frac, count(DISTINCT {c}) AS n_distinct FROM orders" for c in _PROFILED
    )
)
def sel_column_profile(spark, sf_dir):
    """Null fraction and distinct values of several columns in one pass."""
    return statistics.profile(_table(spark, sf_dir, "orders"), _PROFILED).select("column_name", "n_rows", F.round("null_frac", 9).alias("null_frac"), "n_distinct")


@_query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, rank::INT AS rank, value, n, round(n / (SELECT count(*) FROM orders), 9) AS share FROM
(SELECT {c}::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY 1, {c} HAVING count(*) >= 2) WHERE rank <= 5"""
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
    )
)
def sel_most_common(spark, sf_dir):
    """The five most common values of three columns with their shares."""
    found = statistics.most_common(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], 5)
    return found.withColumn("share", F.round("share", 9))


@_query("SELECT unnest(range(0, 11))::INT AS bound_no, round(unnest(quantile_cont(o_totalprice, [i / 10 for i in range(0, 11)])), 4) AS bound FROM orders")
def sel_histogram(spark, sf_dir):
    """Bounds of ten bins of equal counts."""
    found = statistics.histogram_bounds(_table(spark, sf_dir, "orders"), "o_totalprice", 10)
    return found.select("bound_no", F.round("bound", 4).alias("bound"))


@_query(
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS share FROM orders
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8"""
)
def sel_joint_shares(spark, sf_dir):
    """The most common pairs of two columns: statistics for filters that are not independent."""
    return statistics.joint_shares(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], 8).withColumn("share", F.round("share", 9))


@_query()
def sel_estimates(spark, sf_dir):
    """Estimated against measured selectivity of each filter, and how far they are apart."""
    df = _table(spark, sf_dir, "lineitem")
    parsed = {n: filters.parse_filter(spark, f, df.columns) for n, f in _FILTERS.items()}
    stats = statistics.analyze(df, list(dict.fromkeys(c for p in parsed.values() for c in filters.filter_columns(p))))
    counts = df.agg(F.count("*").alias("all"), *(F.count_if(filters.to_column(p)).alias(n) for n, p in parsed.items())).first()
    rows = []
    for n, p in parsed.items():
        estimated, measured = statistics.conjunction_selectivity(stats, p), counts[n] / max(1, counts["all"])
        rows.append((n, estimated, measured, statistics.severity(estimated, measured)))
    return spark.createDataFrame(rows, "name string, estimated double, measured double, severity string")


@_query(
    """SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"""
)
def agg4_latency_percentiles(spark, sf_dir):
    """Exact, interpolated percentiles by group, as for latencies."""
    found = metrics.latency_summary(_table(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_type", F.round("total", 4).alias("total"), *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")))


_CAL = costs.Calibration(0.15, 0.15, 4.4, 0.2, ((20, 0.6), (40, 0.9), (80, 0.97)))
_POINTS = [(s / 1000, c / 10) for s in (5, 10, 20, 50, 100, 200, 400, 800) for c in (-6, 0, 6)]
_POINTS_SQL = "points(selectivity, correlation) AS (VALUES " + ", ".join(f"({s}::DOUBLE, {c}::DOUBLE)" for s, c in _POINTS) + ")"
_CASES_SQL = f"""{_POINTS_SQL},
c AS (SELECT *, (SELECT count(*) FROM lineitem) AS n, selectivity AS s_global, greatest(1e-6, least(1.0, selectivity * exp(1.5 * correlation))) AS s_local FROM points),
r AS (SELECT *, 0.9 AS at_ef FROM c),
e AS (
SELECT selectivity, correlation, 'exact' AS strategy, 0 AS priority, 0.3 * greatest(1.0, n * s_global) + 0.15 * greatest(1.0, n * s_global) * log2(10) AS latency_us, 1.0 AS recall, true AS returns_k FROM r UNION ALL
SELECT selectivity, correlation, 'partial', 2, 0.15 * 4.4 * 40 * ln(greatest(2.0, greatest(1.0, n * s_global))), at_ef, true FROM r WHERE selectivity <= 0.01 UNION ALL
SELECT selectivity, correlation, 'postfilter', 3, 0.15 * 4.4 * 40 * ln(n), at_ef * least(1.0, s_local * 40 / 10), s_local * 40 >= 10 FROM r UNION ALL
SELECT selectivity, correlation, 'iterative_relaxed', 4, 0.15 * 4.4 * ln(n) * 10 / s_local, at_ef * CASE WHEN 10 / s_local > 800 THEN least(1.0, s_local * 800 / 10) ELSE 1.0 END, 10 / s_local <= 800 FROM r UNION ALL
SELECT selectivity, correlation, 'iterative_strict', 5, 1.2 * 0.15 * 4.4 * ln(n) * 10 / s_local, at_ef * CASE WHEN 10 / s_local > 800 THEN least(1.0, s_local * 800 / 10) ELSE 1.0 END, 10 / s_local <= 800 FROM r),
w AS (SELECT p.selectivity, p.correlation, coalesce((SELECT strategy FROM e WHERE e.selectivity = p.selectivity AND e.correlation = p.correlation AND returns_k AND recall >= 0.9 ORDER BY round(latency_us, 9), priority LIMIT 1), 'exact') AS winner FROM points p)"""


def _cases(spark, sf_dir) -> DataFrame:
    points = spark.createDataFrame(_POINTS, "selectivity double, correlation double")
    near = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col("selectivity") * F.exp(F.lit(1.5) * F.col("correlation"))))
    n = _table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows"))
    return points.crossJoin(F.broadcast(n)).select(
        "*", F.col("selectivity").alias("s_global"), near.alias("s_local"), F.when(F.col("selectivity") <= 0.01, F.col("selectivity")).alias("s_index"),
        F.lit(None).cast("double").alias("s_partition"), F.lit(10).alias("k"), F.lit(40).alias("ef"), F.lit(800).alias("max_scan"),
    )


def _winners(spark, sf_dir) -> DataFrame:
    return costs.best(costs.estimates(_cases(spark, sf_dir), _CAL), ["selectivity", "correlation"], 0.9)


@_query(f"WITH {_CASES_SQL} SELECT selectivity, correlation, strategy, round(latency_us, 4) AS latency_us, round(recall, 6)::DOUBLE AS recall, returns_k FROM e")
def cst_estimates(spark, sf_dir):
    """Costs of all strategies over a grid of selectivity and correlation."""
    found = costs.estimates(_cases(spark, sf_dir), _CAL)
    return found.select("selectivity", "correlation", "strategy", F.round("latency_us", 4).alias("latency_us"), F.round("recall", 6).alias("recall"), "returns_k")


@_query(f"WITH {_CASES_SQL} SELECT * FROM w")
def cst6_choose_best(spark, sf_dir):
    """The recommended strategy at each point of the grid."""
    return _winners(spark, sf_dir)


@_query(
    f"""WITH {_CASES_SQL}, m AS (SELECT *, CASE WHEN lag(winner) OVER a IS NOT DISTINCT FROM winner AND row_number() OVER a > 1 THEN 0 ELSE 1 END AS changed FROM w WINDOW a AS (PARTITION BY correlation ORDER BY selectivity)),
g AS (SELECT *, sum(changed) OVER (PARTITION BY correlation ORDER BY selectivity)::BIGINT AS region FROM m)
SELECT correlation, region, min(winner) AS strategy, min(selectivity) AS low, max(selectivity) AS high, count(*) AS n_points FROM g GROUP BY correlation, region"""
)
def xov_winner_regions(spark, sf_dir):
    """Runs of one winner along selectivity."""
    return sweeps.winner_regions(_winners(spark, sf_dir))


@_query(
    f"""WITH {_CASES_SQL}, p AS (SELECT *, lead(selectivity) OVER a AS upper, lead(winner) OVER a AS to_strategy FROM w WINDOW a AS (PARTITION BY correlation ORDER BY selectivity))
SELECT correlation, selectivity AS lower, upper, round(sqrt(selectivity * upper), 9) AS estimated, winner AS from_strategy, to_strategy FROM p WHERE winner <> to_strategy"""
)
def xov_crossovers(spark, sf_dir):
    """Where the winner changes between neighbouring selectivities."""
    return sweeps.crossovers(_winners(spark, sf_dir)).withColumn("estimated", F.round("estimated", 9))


@_query(f"WITH {_CASES_SQL} SELECT winner, count(*) AS wins FROM w GROUP BY winner")
def agg11_win_counts(spark, sf_dir):
    """How often each strategy wins."""
    return sweeps.win_counts(_winners(spark, sf_dir))


#: What a machine of dearer index steps would have been told; its predictions differ from the winners.
_OTHER = costs.Calibration(0.15, 0.15, 13.0, 0.2, ((20, 0.6), (40, 0.9), (80, 0.97)))
_OK_SQL = "coalesce((SELECT bool_or(returns_k AND recall >= 0.9) FROM e WHERE e.selectivity = p.selectivity AND e.correlation = p.correlation AND e.strategy = {which}), false)"


@_query(
    f"""WITH {_CASES_SQL}, e2 AS (SELECT selectivity, correlation, strategy, priority, CASE WHEN strategy = 'exact' THEN latency_us ELSE latency_us * 13.0 / 4.4 END AS latency_us, recall, returns_k FROM e),
p AS (SELECT w.*, coalesce((SELECT strategy FROM e2 WHERE e2.selectivity = w.selectivity AND e2.correlation = w.correlation AND returns_k AND recall >= 0.9 ORDER BY round(latency_us, 9), priority LIMIT 1), 'exact') AS predicted FROM w),
o AS (SELECT p.*, {_OK_SQL.format(which="p.predicted")} AS predicted_ok, {_OK_SQL.format(which="'postfilter'")} AS postfilter_ok FROM p),
s AS (SELECT count(*)::DOUBLE AS points, count(DISTINCT selectivity)::DOUBLE AS bins, count(DISTINCT correlation)::DOUBLE AS correlations, count(predicted)::DOUBLE AS predictions, avg((predicted = winner)::INT)::DOUBLE AS match,
count(*) FILTER (NOT postfilter_ok)::DOUBLE AS failures, count(*) FILTER (NOT postfilter_ok AND predicted <> 'postfilter' AND predicted_ok)::DOUBLE AS safe FROM o)
SELECT 'minimum_points' AS name, points >= 3 AS passed, points AS actual, 3.0::DOUBLE AS required FROM s UNION ALL SELECT 'selectivity_bins', bins >= 3, bins, 3.0 FROM s UNION ALL SELECT 'correlation_bins', correlations >= 3, correlations, 3.0 FROM s
UNION ALL SELECT 'predictions_present', predictions = points, predictions, points FROM s UNION ALL SELECT 'prediction_match_rate', match >= 0.8, round(match, 9), 0.8 FROM s
UNION ALL SELECT 'postfilter_failures', failures >= 1, failures, 1.0 FROM s UNION ALL SELECT 'safe_when_postfilter_fails', safe = failures, safe, failures FROM s"""
)
def prf_checks(spark, sf_dir):
    """The proof's checks on the grid: winners by one calibration, predictions by another."""
    by = ["selectivity", "correlation"]
    estimated = costs.estimates(_cases(spark, sf_dir), _CAL)
    ok = F.col("returns_k") & (F.col("recall") >= 0.9)
    viable = estimated.groupBy(*by).agg(F.max(F.when(F.col("strategy") == "postfilter", ok)).alias("postfilter_ok"), F.collect_set(F.when(ok, F.col("strategy"))).alias("viable"))
    predicted = costs.best(costs.estimates(_cases(spark, sf_dir), _OTHER), by, 0.9).withColumnRenamed("winner", "predicted")
    points = _winners(spark, sf_dir).join(predicted, by).join(viable, by).withColumn("predicted_ok", F.array_contains("viable", F.col("predicted")))
    return sweeps.proof(points).withColumn("actual", F.round("actual", 9))


@_query(
    f"""WITH {_NEAR.format(distance=_L2, where='')}, d AS (SELECT vec_id, min(distance) AS least FROM near GROUP BY vec_id)
SELECT vec_id, round(least, 6) AS least FROM d ORDER BY least DESC, vec_id LIMIT 25"""
)
def dsg2_far_from_queries(spark, sf_dir):
    """The rows farthest from all queries: an anti-correlated filter."""
    return _nearest_query(spark, sf_dir).orderBy(F.desc("least"), "vec_id").limit(25).withColumn("least", F.round("least", 6))


def _nearest_query(spark, sf_dir) -> DataFrame:
    """(vec_id, least): the distance of each row to its nearest query."""
    base = _base(spark, sf_dir)
    return search.nearest_query(base, _queries(base))


@_query(
    f"""WITH {_NEAR.format(distance=_L2, where='')}, top AS (SELECT DISTINCT vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near) WHERE rank <= {K}),
d AS (SELECT vec_id, min(distance) AS least FROM near GROUP BY vec_id)
SELECT vec_id, round(least, 6) AS least FROM d WHERE vec_id NOT IN (SELECT vec_id FROM top) ORDER BY least, vec_id LIMIT 25"""
)
def dsg3_band(spark, sf_dir):
    """The nearest rows that are in no query's top k: a band just outside."""
    base = _base(spark, sf_dir)
    top = search.top_k(base, _queries(base), K).select("vec_id").distinct()
    return _nearest_query(spark, sf_dir).join(top, "vec_id", "left_anti").orderBy("least", "vec_id").limit(25).withColumn("least", F.round("least", 6))


@_query(
    f"""WITH v AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS score FROM embeddings)
SELECT vec_id, round(score, 6) AS score FROM v ORDER BY score DESC, vec_id LIMIT 25"""
)
def dsg1_projection_tail(spark, sf_dir):
    """The rows with the largest projection on a vector."""
    base = _base(spark, sf_dir)
    row = base.where("vec_id = 3").select("embedding").first()
    scored = base.where(F.lit(row is not None)).select("vec_id", vectors.inner_product("embedding", F.array(*(F.lit(float(x)) for x in row[0])) if row else F.col("embedding")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(25).withColumn("score", F.round("score", 6))


#: A statement of one of five forms for each order, with the order's own values in it.
_STATEMENTS = (
    "SELECT id FROM docs WHERE tenant_id = %1$s AND price BETWEEN 1 AND %2$s ORDER BY embedding <-> $1 LIMIT 10",
    "select * from app.items where region in ('this and that', '%3$s') and active order by vec <=> $1 limit $2;",
    "SELECT id FROM docs WHERE (tenant_id = %1$s OR price > %2$s) AND state >= '%3$s' ORDER BY embedding <#> '[1,2]' LIMIT 20",
    "SELECT count(*) FROM docs WHERE tenant_id = %1$s",
    "SELECT id FROM docs d WHERE lower(body) = '%3$s' AND id IN (SELECT doc_id FROM picks WHERE day = %1$s ORDER BY n) AND kind = 2 ORDER BY d.embedding <-> $1",
)
_LOG_SQL = "log AS (SELECT left(o_orderpriority, 1)::INT AS form, o_orderkey % 5 + 1 AS calls, 10 * (o_orderkey % 5 + 1) AS \"rows\", floor(o_totalprice) AS total FROM orders)"
_SUMS_SQL = "count(*) AS n_statements, sum(calls)::BIGINT AS calls, sum(\"rows\")::BIGINT AS \"rows\", sum(total)::DOUBLE AS total_exec_time_ms"


def _log(spark, sf_dir) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, _STATEMENTS)), F.left("o_orderpriority", F.lit(1)).cast("int"))
    calls = (F.col("o_orderkey") % 5 + 1).cast("long")
    text = F.expr("format_string(form, o_custkey, cast(floor(o_totalprice) as long), o_orderstatus)")
    orders = _table(spark, sf_dir, "orders").withColumn("form", form)
    return orders.select(F.col("o_orderkey").cast("string").alias("queryid"), text.alias("query"), calls.alias("calls"), (calls * 10).alias("rows"), F.floor("o_totalprice").cast("double").alias("total_exec_time_ms"))


@_query(
    f"""WITH {_LOG_SQL}, shape(form, "table", vector_column, operator, template) AS (VALUES (1, 'docs', 'embedding', '<->', 'tenant_id = <value> AND price BETWEEN <value> AND <value>'),
(2, 'app.items', 'vec', '<=>', 'region IN (<value>) AND active'), (3, 'docs', 'embedding', '<#>', 'state >= <value>'), (5, 'docs', 'embedding', '<->', 'kind = <value>'))
SELECT "table", vector_column, operator, template, {_SUMS_SQL} FROM log JOIN shape USING (form) GROUP BY ALL"""
)
def wrk_shapes(spark, sf_dir):
    """Shapes of the vector searches of a log with one statement for each order, rolled up."""
    return workload.roll_up(workload.shapes(_log(spark, sf_dir))).drop("fingerprint")


@_query(
    f"""WITH {_LOG_SQL}, told(form, outcome, reason) AS (VALUES (1, 'complete', ''), (2, 'complete', ''), (3, 'partial', 'or'), (4, 'rejected', 'no_vector_order'), (5, 'partial', 'function'), (5, 'partial', 'subquery'))
SELECT outcome, reason, {_SUMS_SQL} FROM log JOIN told USING (form) GROUP BY ALL"""
)
def wrk_report(spark, sf_dir):
    """How many statements of that log have a shape, whole or in part, and why the others have none."""
    return workload.report(_log(spark, sf_dir))


@_query(
    f"""WITH {_frontier_sql(EF)}, {_TRUTH_SQL} SELECT query_id, count(*) AS hits FROM (SELECT query_id, vec_id FROM t INTERSECT SELECT query_id, vec_id FROM found WHERE rank <= {K}) GROUP BY query_id"""
)
def set1_common_ids(spark, sf_dir):
    """The ids that truth and postfilter share, by query, as a set operation."""
    base = _base(spark, sf_dir)
    q = _queries(base)
    pairs = [x.select("query_id", "vec_id") for x in (search.exact(base, q, K, _passes()), search.postfilter(base, q, K, _passes(), ef=EF))]
    return pairs[0].intersect(pairs[1]).groupBy("query_id").agg(F.count("*").alias("hits"))


@_query()
def src15_clustered(spark, sf_dir):
    """Observed selectivity by cluster of a generated table, four times the vectors, with a filter that follows its clusters."""
    made = sources.clustered(spark, max(200, 4 * _base(spark, sf_dir).count()), 12, clusters=9, selectivity=0.15, correlation=0.4)
    return made.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg(F.col("passes_filter").cast("double")).alias("share"))


@_query()
def ann_by_centre(spark, sf_dir):
    """Recall of approximate search over lists by nearest centre, against the truth."""
    base = _base(spark, sf_dir)
    q = _queries(base)
    centres = layouts.fit_centres(base, 8)
    path = _copy_path(spark, "lists")
    layouts.write_by_centre(base, centres, path)
    found = layouts.search_by_centre(spark, path, centres, q, K, probes=6)
    return metrics.summary(metrics.per_query(search.top_k(base, q, K), found, q, K))


@_query()
def ann_graph(spark, sf_dir):
    """Recall of postfilter on a neighbour graph, and the share of all rows that it compares, against the truth."""
    base = _base(spark, sf_dir)
    q = _queries(base)
    made = graph.write_graph(base, _copy_path(spark, "graph"))
    found, compared = graph.search_graph(made, q, K, ef=EF)
    quality = metrics.summary(metrics.per_query(search.top_k(base, q, K), found, q, K))
    share = compared.agg((F.avg("compared") / F.lit(float(max(1, made.size.sum())))).alias("compared_share"))
    return quality.crossJoin(F.broadcast(share))  # one row each


#: Filters of growing share and the frontiers that the measured sweep tries for each.
_SWEPT = {"one": "label = 3", "three": _PASSES_SQL, "half": "label < 5", "most": "label < 9"}
_EFS, _TARGET = [10, 20, 40, 80, 160], 0.9
_SWEEP_SQL = f"""{_NEAR.format(distance=_L2, where='')}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM near),
flagged AS ({" UNION ALL ".join(f"SELECT '{n}' AS filter, query_id, place FROM placed WHERE {c}" for n, c in _SWEPT.items())}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY filter, query_id ORDER BY place) AS r FROM flagged),
share AS ({" UNION ALL ".join(f"SELECT '{n}' AS filter, avg(({c})::INT) AS selectivity FROM embeddings" for n, c in _SWEPT.items())}),
cells AS (SELECT filter, selectivity, unnest({_EFS})::INT AS ef, query_id FROM share, q),
by_query AS (SELECT c.filter, c.selectivity, c.ef, c.query_id, count(*) FILTER (r <= {K}) AS n_truth, count(*) FILTER (place <= ef) AS passing, count(*) FILTER (place <= ef AND r <= {K}) AS hits
FROM cells c LEFT JOIN ranked USING (filter, query_id) GROUP BY ALL),
swept AS (SELECT filter, ef, selectivity, avg(CASE WHEN n_truth = 0 THEN 1.0 ELSE hits::DOUBLE / n_truth END) AS recall, bool_and(hits >= least(n_truth, {K})) AS returns_k, avg(hits) AS mean_results, avg(passing / ef) AS s_local FROM by_query GROUP BY ALL),
cheapest AS (SELECT filter, selectivity, selectivity * (SELECT count(*) FROM embeddings) AS exact, min(ef) FILTER (returns_k AND recall >= {_TARGET}) AS ef FROM swept GROUP BY ALL),
won AS (SELECT filter, selectivity, CASE WHEN ef < exact THEN 'postfilter' ELSE 'exact' END AS winner, CASE WHEN ef < exact THEN ef END AS ef, CASE WHEN ef < exact THEN ef ELSE exact END AS cost FROM cheapest)"""


def _sweep(spark, sf_dir) -> DataFrame:
    base = _base(spark, sf_dir)
    return measured.sweep(base, _queries(base), {n: F.expr(c) for n, c in _SWEPT.items()}, _EFS, K)


def _measured_best(spark, sf_dir) -> DataFrame:
    return measured.best(_sweep(spark, sf_dir), F.lit(_base(spark, sf_dir).count()), _TARGET)


@_query(f"WITH {_SWEEP_SQL} SELECT filter, ef, round(selectivity, 9) AS selectivity, round(recall, 6) AS recall, returns_k, round(mean_results, 6) AS mean_results, round(s_local, 6) AS s_local FROM swept")
def swp1_measured_sweep(spark, sf_dir):
    """Postfilter measured at five frontiers for four filters, all frontiers from one scan."""
    return _sweep(spark, sf_dir).select("filter", "ef", F.round("selectivity", 9).alias("selectivity"), "returns_k", *(F.round(c, 6).alias(c) for c in ("recall", "mean_results", "s_local")))


@_query(f"WITH {_SWEEP_SQL} SELECT filter, round(selectivity, 9) AS selectivity, winner, ef, round(cost, 6)::DOUBLE AS cost FROM won")
def top9_measured_best(spark, sf_dir):
    """The strategy that examines the fewest rows for the target recall, as measured, by filter."""
    return _measured_best(spark, sf_dir).select("filter", F.round("selectivity", 9).alias("selectivity"), "winner", "ef", F.round("cost", 6).alias("cost"))


@_query(
    f"""WITH {_SWEEP_SQL}, m AS (SELECT *, CASE WHEN lag(winner) OVER a = winner THEN 0 ELSE 1 END AS changed FROM won WINDOW a AS (ORDER BY selectivity)),
g AS (SELECT *, sum(changed) OVER (ORDER BY selectivity)::BIGINT AS region FROM m)
SELECT region, min(winner) AS strategy, round(min(selectivity), 9) AS low, round(max(selectivity), 9) AS high, count(*) AS n_points FROM g GROUP BY region"""
)
def xov_measured_regions(spark, sf_dir):
    """Runs of one measured winner along the selectivity of the filters."""
    found = sweeps.winner_regions(_measured_best(spark, sf_dir).withColumn("correlation", F.lit(0.0)))
    return found.select("region", "strategy", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "n_points")


@_query(f"WITH {_SWEEP_SQL} SELECT ef, round(max(recall) OVER (ORDER BY ef ROWS UNBOUNDED PRECEDING), 6) AS recall FROM swept WHERE filter = 'three'")
def win2_measured_curve(spark, sf_dir):
    """The measured recall curve of one filter, made non-decreasing: what a calibration keeps."""
    return sweeps.monotone(_sweep(spark, sf_dir).where("filter = 'three'")).withColumn("recall", F.round("recall", 6))


@_query(f"WITH {_SWEEP_SQL} SELECT filter, ef, round(max(recall) OVER (PARTITION BY filter ORDER BY ef ROWS UNBOUNDED PRECEDING), 6) AS recall FROM swept")
def win2_monotone_recall(spark, sf_dir):
    """The measured recall curve of each filter, made non-decreasing."""
    return sweeps.monotone(_sweep(spark, sf_dir), "filter").withColumn("recall", F.round("recall", 6))


@_query(
    f"""WITH {_SWEEP_SQL}, p AS (SELECT filter, 'postfilter ' || ef AS strategy, round(recall, 6) AS recall, round(1e6 / ef, 6) AS qps FROM swept
UNION ALL SELECT filter, 'exact', 1.0, round(1e6 / greatest(1.0, exact), 6) FROM cheapest)
SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.filter = a.filter AND b.recall >= a.recall AND b.qps >= a.qps AND (b.recall > a.recall OR b.qps > a.qps))"""
)
def win6_pareto(spark, sf_dir):
    """By filter, the measured strategies that no other beats in both recall and queries for a million rows examined."""
    swept = _sweep(spark, sf_dir)
    rows = F.greatest(F.lit(1.0), F.col("selectivity") * F.lit(_base(spark, sf_dir).count()))
    post = swept.select("filter", F.concat(F.lit("postfilter "), F.col("ef")).alias("strategy"), F.round("recall", 6).alias("recall"), F.round(F.lit(1e6) / F.col("ef"), 6).alias("qps"))
    exact = swept.select("filter", F.lit("exact").alias("strategy"), F.lit(1.0).alias("recall"), F.round(F.lit(1e6) / rows, 6).alias("qps")).distinct()
    return sweeps.pareto(post.unionAll(exact), "filter")


@_query(
    f"""WITH {_SWEEP_SQL}, v AS (SELECT filter, ef, round(least(1.0, selectivity * ef / {K}), 9) AS p, round(recall, 9) AS r FROM swept), g AS (SELECT *, greatest(p, 1e-12) / greatest(r, 1e-12) AS ratio, abs(p - r) AS apart FROM v)
SELECT filter, ef, p AS predicted, r AS measured, CASE WHEN ratio <= 0.1 OR ratio >= 10 OR apart >= 0.25 THEN 'critical' WHEN ratio <= 0.5 OR ratio >= 2 OR apart >= 0.05 THEN 'warning' ELSE 'ok' END AS severity FROM g"""
)
def val1_predicted_recall(spark, sf_dir):
    """Recall expected from the overall share of each filter beside the measured one."""
    return measured.predictions(_sweep(spark, sf_dir), K)


_GRID = grid.Grid()
_LIST = lambda values: ", ".join(f"({v}::DOUBLE)" for v in values)
_EFS_SQL = "[" + ", ".join(map(str, _GRID.efs)) + "]"
_GRID_SQL = f"""{_NEAR.format(distance=_L2, where='')}, placed AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM near) WHERE place <= {_GRID.max_scan}),
hot AS (SELECT DISTINCT vec_id FROM placed WHERE place <= {_GRID.hot}), cells AS (SELECT * FROM (VALUES {_LIST(_GRID.selectivities)}) s(selectivity), (VALUES {_LIST(_GRID.correlations)}) c(correlation)),
drawn AS (SELECT vec_id, (((vec_id % {grid.PRIME}) * {grid.STEP} + {grid.START}) % {grid.PRIME})::DOUBLE / {grid.PRIME}::DOUBLE AS draw, vec_id IN (SELECT vec_id FROM hot) AS hot FROM embeddings),
flagged AS (SELECT vec_id, selectivity, correlation FROM drawn, cells WHERE draw < selectivity * (1 + CASE WHEN hot THEN correlation ELSE -correlation END)),
sizes AS (SELECT selectivity, correlation, count(*) AS n_pass FROM flagged GROUP BY ALL),
first AS (SELECT selectivity, correlation, query_id, place, row_number() OVER (PARTITION BY selectivity, correlation, query_id ORDER BY place) AS r FROM flagged JOIN placed USING (vec_id)),
measured AS (SELECT c.selectivity, c.correlation, q.query_id, coalesce(any_value(n_pass), 0) AS n_pass, least(coalesce(any_value(n_pass), 0), {_GRID.k}) AS want,
(SELECT count(*) FROM placed p WHERE p.query_id = q.query_id AND p.place <= {_GRID.probe}) AS depth, count(*) FILTER (place <= {_GRID.probe}) AS probed, count(*) FILTER (r <= {_GRID.k}) AS found,
{", ".join(f"count(*) FILTER (r <= {_GRID.k} AND place <= {e}) AS found_{e}" for e in _GRID.efs)},
CASE WHEN count(*) FILTER (r <= {_GRID.k}) >= least(coalesce(any_value(n_pass), 0), {_GRID.k}) AND coalesce(any_value(n_pass), 0) > 0 THEN max(place) FILTER (r <= {_GRID.k}) ELSE {_GRID.max_scan} END::DOUBLE AS examined
FROM cells c CROSS JOIN q LEFT JOIN sizes USING (selectivity, correlation) LEFT JOIN first f ON f.selectivity = c.selectivity AND f.correlation = c.correlation AND f.query_id = q.query_id GROUP BY c.selectivity, c.correlation, q.query_id),
runs AS (SELECT selectivity, correlation, 'exact' AS strategy, NULL::INT AS ef, 1.0::DOUBLE AS recall, true AS returns_k, max(n_pass)::DOUBLE AS cost FROM measured GROUP BY ALL UNION ALL
SELECT selectivity, correlation, 'iterative', NULL, avg(CASE WHEN want = 0 THEN 1.0 ELSE found::DOUBLE / want END), bool_and(found >= want), quantile_cont(examined, 0.95) FROM measured GROUP BY ALL UNION ALL
{" UNION ALL ".join(f"SELECT selectivity, correlation, 'postfilter', {e}, avg(CASE WHEN want = 0 THEN 1.0 ELSE found_{e}::DOUBLE / want END), bool_and(found_{e} >= want), {e}::DOUBLE FROM measured GROUP BY ALL" for e in _GRID.efs)}),
ranked AS (SELECT *, returns_k AND recall >= {_GRID.target} AS viable, list_position(['exact', 'postfilter', 'iterative'], strategy) AS priority FROM runs),
won AS (SELECT selectivity, correlation, coalesce(arg_min(strategy, (round(cost, 9), priority)) FILTER (viable), 'exact') AS winner, bool_or(viable) FILTER (strategy = 'postfilter' AND ef = {_GRID.default_ef}) AS postfilter_ok,
max(cost) FILTER (strategy = 'postfilter' AND ef = {_GRID.default_ef}) AS postfilter_cost FROM ranked GROUP BY ALL),
shares AS (SELECT selectivity, correlation, max(n_pass)::DOUBLE / (SELECT count(*) FROM embeddings) AS share, avg(probed::DOUBLE / depth) AS local FROM measured GROUP BY ALL),
walks AS (SELECT *, list_filter({_EFS_SQL}, lambda e: local * e >= {1.5 * _GRID.k})[1]::INT AS ef, {_GRID.k} / greatest(local, 1e-12) AS walk, (SELECT count(*) FROM embeddings) AS n FROM shares),
options AS (SELECT selectivity, correlation, 'exact' AS strategy, 1 AS priority, share * n AS cost, NULL::INT AS ef FROM walks UNION ALL SELECT selectivity, correlation, 'postfilter', 2, ef, ef FROM walks WHERE ef IS NOT NULL
UNION ALL SELECT selectivity, correlation, 'iterative', 3, walk, NULL FROM walks WHERE walk * 1.5 <= {_GRID.max_scan}),
guess AS (SELECT selectivity, correlation, arg_min(strategy, (round(cost, 9), priority)) AS predicted FROM options GROUP BY ALL),
points AS (SELECT w.selectivity, w.correlation, s.share, s.local, winner, predicted, CASE WHEN predicted = 'postfilter' THEN s.ef END AS predicted_ef, r.viable AS predicted_ok, postfilter_ok, postfilter_cost / nullif(r.cost, 0) AS speedup
FROM won w JOIN walks s USING (selectivity, correlation) JOIN guess g USING (selectivity, correlation)
JOIN ranked r ON r.selectivity = w.selectivity AND r.correlation = w.correlation AND r.strategy = predicted AND r.ef IS NOT DISTINCT FROM CASE WHEN predicted = 'postfilter' THEN s.ef END)"""


def _kept(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back."""
    path, schema = _copy_path(df.sparkSession, "kept"), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _grid_measured(spark, sf_dir) -> DataFrame:
    base = _base(spark, sf_dir)
    return _kept(grid.measured_grid(base, _queries(base), _GRID, keep=_kept))


def _grid_points(spark, sf_dir) -> DataFrame:
    return grid.points(_grid_measured(spark, sf_dir), _base(spark, sf_dir).count(), _GRID)


@_query(f"WITH {_GRID_SQL} SELECT selectivity, correlation, strategy, ef, round(recall, 6) AS recall, returns_k, round(cost, 6) AS cost FROM runs")
def swp1_grid(spark, sf_dir):
    """Recall and rows examined of every strategy and frontier over a grid of selectivity and correlation, from one search."""
    found = grid.runs(_grid_measured(spark, sf_dir), _GRID)
    return found.withColumn("recall", F.round("recall", 6)).withColumn("cost", F.round("cost", 6))


@_query(
    f"""WITH {_GRID_SQL} SELECT selectivity, correlation, round(share, 6) AS share, round(local, 6) AS local, winner, predicted, predicted_ef, predicted_ok, postfilter_ok, round(speedup, 6) AS speedup FROM points"""
)
def prf2_grid_points(spark, sf_dir):
    """Each cell's measured winner beside the predicted one, and the rows that postfilter examines for one of the prediction."""
    found = _grid_points(spark, sf_dir)
    return found.select(*(F.round(c, 6).alias(c) if c in ("share", "local", "speedup") else c for c in found.columns))


@_query(
    f"""WITH {_GRID_SQL}, m AS (SELECT *, CASE WHEN lag(winner) OVER a = winner THEN 0 ELSE 1 END AS changed FROM points WINDOW a AS (PARTITION BY correlation ORDER BY selectivity)),
g AS (SELECT *, sum(changed) OVER (PARTITION BY correlation ORDER BY selectivity)::BIGINT AS region FROM m)
SELECT correlation, region, min(winner) AS strategy, min(selectivity) AS low, max(selectivity) AS high, count(*) AS n_points FROM g GROUP BY correlation, region"""
)
def xov_grid_regions(spark, sf_dir):
    """Runs of one measured winner along selectivity, by correlation."""
    return sweeps.winner_regions(_grid_points(spark, sf_dir))


@_query(
    f"""WITH {_GRID_SQL}, p AS (SELECT *, lead(selectivity) OVER a AS upper, lead(winner) OVER a AS to_strategy FROM points WINDOW a AS (PARTITION BY correlation ORDER BY selectivity))
SELECT correlation, selectivity AS lower, upper, round(sqrt(selectivity * upper), 9) AS estimated, winner AS from_strategy, to_strategy FROM p WHERE winner <> to_strategy"""
)
def xov_grid_crossovers(spark, sf_dir):
    """Where the measured winner changes between neighbouring selectivities."""
    return sweeps.crossovers(_grid_points(spark, sf_dir)).withColumn("estimated", F.round("estimated", 9))


@_query(f"WITH {_GRID_SQL} SELECT winner, count(*) AS wins FROM points GROUP BY winner")
def agg11_grid_wins(spark, sf_dir):
    """How many cells each strategy wins as measured."""
    return sweeps.win_counts(_grid_points(spark, sf_dir))


_PROOF_SQL = f"""{_GRID_SQL}, s AS (SELECT count(*)::DOUBLE AS points, count(DISTINCT selectivity)::DOUBLE AS bins, count(DISTINCT correlation)::DOUBLE AS correlations, count(predicted)::DOUBLE AS predictions, avg((predicted = winner)::INT)::DOUBLE AS match,
count(*) FILTER (NOT postfilter_ok)::DOUBLE AS failures, count(*) FILTER (NOT postfilter_ok AND predicted <> 'postfilter' AND predicted_ok)::DOUBLE AS safe, avg(speedup) AS speedup FROM points),
checks AS (SELECT 'minimum_points' AS name, points >= 3 AS passed, points AS actual, 3.0::DOUBLE AS required FROM s UNION ALL SELECT 'selectivity_bins', bins >= 3, bins, 3.0 FROM s UNION ALL SELECT 'correlation_bins', correlations >= 3, correlations, 3.0 FROM s
UNION ALL SELECT 'predictions_present', predictions = points, predictions, points FROM s UNION ALL SELECT 'prediction_match_rate', match >= 0.8, round(match, 9), 0.8 FROM s
UNION ALL SELECT 'postfilter_failures', failures >= 1, failures, 1.0 FROM s UNION ALL SELECT 'safe_when_postfilter_fails', safe = failures, safe, failures FROM s)"""


@_query(f"WITH {_PROOF_SQL} SELECT * FROM checks")
def prf_grid_checks(spark, sf_dir):
    """The proof's checks on the measured grid."""
    return sweeps.proof(_grid_points(spark, sf_dir)).withColumn("actual", F.round("actual", 9))


@_query(
    f"""WITH {_PROOF_SQL} SELECT (SELECT bool_and(passed) FROM checks) AS passed, points::BIGINT AS n_points, round(match, 6) AS match_rate, failures::BIGINT AS failures, safe::BIGINT AS safe, round(speedup, 6) AS mean_speedup FROM s"""
)
def agg17_grid_proof(spark, sf_dir):
    """Whether all checks pass, the rate of right predictions and the mean speed-up over the default postfilter."""
    found = _grid_points(spark, sf_dir)
    one = grid.report(found, sweeps.proof(found))
    return one.select(*(F.round(c, 6).alias(c) if c in ("match_rate", "mean_speedup") else c for c in one.columns))


_RECOMMEND_SQL = f"""WITH b AS (SELECT count(*)::DOUBLE AS n, avg(({_PASSES_SQL})::INT) AS s FROM embeddings), f AS (SELECT *, greatest(40, ceil({K} / s)) AS least FROM b),
p AS (SELECT *, CASE WHEN least <= 40 THEN 40 WHEN least <= 80 THEN 80 WHEN least <= 160 THEN 160 ELSE least END AS ef FROM f),
e AS (SELECT 'exact' AS strategy, 0 AS priority, 0.2 * n * s + 0.1 * n * s * log2({K}) AS latency_us, 1.0::DOUBLE AS recall, true AS returns_k, 0.65::DOUBLE AS confidence FROM p UNION ALL
SELECT 'partition', 1, 16 * ln(greatest(2.0, n * s)), 0.95, true, 0.5 FROM p UNION ALL SELECT 'partial', 2, 16 * ln(greatest(2.0, n * s)), 0.95, true, 0.5 FROM p UNION ALL
SELECT 'postfilter', 3, 0.4 * ef * ln(n), CASE WHEN ef = 40 THEN 0.95 WHEN ef = 80 THEN 0.98 ELSE 0.99 END * least(1.0, s * ef / {K}), s * ef >= {K}, 0.35 FROM p UNION ALL
SELECT 'iterative_relaxed', 4, 0.4 * ln(n) * {K} / s, 0.95, {K} / s <= 20000, 0.35 FROM p UNION ALL SELECT 'iterative_strict', 5, 0.4 * ln(n) * {K} / s, 0.95, {K} / s <= 20000, 0.35 FROM p),
v AS (SELECT *, returns_k AND recall >= 0.95 AS viable FROM e)
SELECT row_number() OVER (ORDER BY viable DESC, round(latency_us, 9), priority)::INT AS place, strategy, round(latency_us, 4) AS latency_us, round(recall, 6) AS recall, returns_k, viable, confidence FROM v"""


@_query(_RECOMMEND_SQL)
def rec_recommend(spark, sf_dir):
    """All strategies ranked for one filter, with a filtered copy and a partitioned one at hand."""
    base = _base(spark, sf_dir)
    predicates = filters.parse_filter(spark, _PASSES_SQL, base.columns)
    at_hand = (advice.Layout("filtered", "filtered", predicates=predicates), advice.Layout("partitioned", "partitioned", column="label"))
    found = advice.recommend(spark, statistics.analyze(base, ["label"]), predicates, k=K, layouts=at_hand)
    return found.drop("note").withColumn("latency_us", F.round("latency_us", 4)).withColumn("recall", F.round("recall", 6))


def _recommended(spark, sf_dir) -> DataFrame:
    """As rec_recommend, with its notes."""
    base = _base(spark, sf_dir)
    predicates = filters.parse_filter(spark, _PASSES_SQL, base.columns)
    at_hand = (advice.Layout("filtered", "filtered", predicates=predicates), advice.Layout("partitioned", "partitioned", column="label"))
    return advice.recommend(spark, statistics.analyze(base, ["label"]), predicates, k=K, layouts=at_hand)


_DECISION_SQL = f"""WITH ranked AS ({_RECOMMEND_SQL}), one AS (SELECT max(strategy) FILTER (place = 1) AS winner, bool_or(viable) FILTER (place = 1) AS winner_viable, max(strategy) FILTER (place = 2) AS runner_up,
bool_or(viable) FILTER (place = 2) AS runner_up_viable, count(*) AS n_candidates, count(*) FILTER (viable) AS n_viable, max(latency_us) FILTER (place = 2) / max(latency_us) FILTER (place = 1) AS ratio, max(confidence) FILTER (place = 1) AS confidence FROM ranked)"""


@_query(
    f"""{_DECISION_SQL} SELECT winner, winner_viable, runner_up, runner_up_viable, n_candidates, n_viable, round(ratio, 4) AS ratio, confidence,
CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS confidence_level FROM one"""
)
def rec14_decision(spark, sf_dir):
    """The recommended strategy beside the next one, as one row."""
    return advice.decision(_recommended(spark, sf_dir)).drop("note").withColumn("ratio", F.round("ratio", 4))


@_query(
    f"""{_DECISION_SQL}, local AS ({ORACLE_SQL["loc4_local_selectivity"]}),
reasons AS (SELECT list_filter([CASE WHEN winner_viable THEN 'cheapest_viable ' || winner ELSE 'fallback_none_viable ' || winner END,
CASE WHEN runner_up IS NULL THEN 'no_runner_up' WHEN NOT runner_up_viable THEN 'runner_up_not_viable ' || runner_up ELSE 'runner_up_costs_more ' || runner_up || ' ' || format('{{:,.3f}}', ratio) END,
CASE WHEN winner IN ('partial', 'partition') THEN 'copy_at_hand ' || winner END, CASE WHEN winner <> 'exact' THEN 'plan_differs exact' END,
CASE WHEN rho <= -0.25 THEN 'filter_avoids_queries' WHEN rho >= 0.25 THEN 'filter_gathers_near_queries' END, CASE WHEN one.confidence < 0.45 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS r FROM one, local)
SELECT (unnest(range(1, len(r) + 1)) - 1)::INT AS reason_no, unnest(r) AS reason FROM reasons"""
)
def rec15_reasons(spark, sf_dir):
    """Why that strategy is recommended, with local selectivity measured and the plan that Spark has for the search."""
    base = _base(spark, sf_dir)
    rho = loc4_local_selectivity(spark, sf_dir).first()["rho"]
    observed = observe.strategy_of(search.nearest_to(base, [0.0], K, where=_passes()))
    return advice.reasons(_recommended(spark, sf_dir), rho=rho, observed=observed)


_BOUNDED = ("o_orderpriority", "o_custkey")


@_query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, bound_no::INT AS bound_no, v::VARCHAR AS bound FROM (SELECT unnest(range(0, 11)) AS bound_no) JOIN
(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS pos, count(*) OVER () AS n FROM orders WHERE {c} IS NOT NULL) ON pos = bound_no * (n - 1) // 10"""
        for c in _BOUNDED
    )
)
def sel9_ranked_bounds(spark, sf_dir):
    """Histogram bounds of a text and a number column by ranks, without a buffer of all values."""
    orders = _table(spark, sf_dir, "orders")
    return reduce(DataFrame.unionAll, (statistics.ranked_bounds(orders, c, 10).select(F.lit(c).alias("column_name"), "bound_no", F.col("bound").cast("string").alias("bound")) for c in _BOUNDED))


@_query("SELECT unnest(['o_custkey', 'o_totalprice']) AS column_name, round(unnest([corr(o_orderkey, o_custkey), corr(o_orderkey, o_totalprice)]), 6) AS correlation FROM orders")
def sel_order_correlation(spark, sf_dir):
    """How two columns follow the column that the table is stored by."""
    found = statistics.order_correlation(_table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey", "o_totalprice"])
    return found.withColumn("correlation", F.round("correlation", 6))


@_query(ORACLE_SQL["vec_functions"].replace("round(sqrt(list_inner_product(a.e, a.e)), 6) AS norm,\n", ""))
def udf4_sql_functions(spark, sf_dir):
    """The vector functions called by name from SQL, between each vector and the one with the next id."""
    vectors.register(spark)
    a = _base(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    names = {"l2": "vector_l2", "l2_squared": "vector_l2_squared", "ip": "vector_inner_product", "cosine": "vector_cosine", "l1": "vector_l1"}
    return a.join(b, "vec_id").selectExpr(
        "vec_id", *(f"round({f}(a, b), 6) AS {n}" for n, f in names.items()), "CAST(bits_hamming(vec_id, 85) AS TINYINT) AS hamming", "round(bits_jaccard(vec_id, 85), 6) AS jaccard"
    )


@_query(_ranked_sql(where=f"WHERE {_PASSES_SQL}"))
def udf4_sql_topk(spark, sf_dir):
    """The k nearest that pass by a table function called from SQL, a block of query vectors at a time."""
    base = _base(spark, sf_dir)
    base.createOrReplaceTempView("udf4_vectors")
    found = []
    for i, (ids, block) in enumerate(search.query_blocks(_queries(base), search.BLOCK)):
        topk.register_block(spark, f"udf4_block_{i}", block, K)
        names = spark.createDataFrame([(n, int(q)) for n, q in enumerate(ids)], "query_no int, query_id long")
        rows = spark.sql(topk.top_k_sql("udf4_vectors", k=K, function=f"udf4_block_{i}", where=_PASSES_SQL))
        found.append(rows.join(F.broadcast(names), "query_no"))  # at most a block
    return _rounded(reduce(DataFrame.unionAll, found) if found else search.exact(base, _queries(base), K, _passes()))


@_query(ORACLE_SQL["loc4_local_selectivity"])
def loc11_cached_selectivity(spark, sf_dir):
    """Local selectivity from a cache keyed by the table's files, the filter and the query vectors: computed once, then read."""
    base = _base(spark, sf_dir)
    held = cache.ResultCache(spark, _copy_path(spark, "cache"))
    key = cache.cache_key(table=cache.table_fingerprint(spark, f"{sf_dir}/embeddings.parquet"), queries=cache.vectors_fingerprint(_queries(base)), filter=_PASSES_SQL, probe=PROBE)
    for _ in range(2):
        found, hit = held.get(key, lambda: loc4_local_selectivity(spark, sf_dir))
    if not hit:
        raise RuntimeError("a result that was just kept is not found")
    return found


@_query("SELECT vec_id, embedding[1]::FLOAT AS first, embedding[-1]::FLOAT AS last, len(embedding)::INT AS n FROM embeddings")
def snk9_npy_round_trip(spark, sf_dir):
    """All vectors written as .npy parts with a manifest and read back by ranges of rows."""
    npy.register(spark)
    path, base = _copy_path(spark, "npy"), _base(spark, sf_dir)
    # parts are read in the order of the manifest, one part here for each range of ids
    base.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select("vec_id", "embedding").write.format(npy.FORMAT).mode("append").save(path)
    ids = base.select("vec_id", F.hash("embedding").alias("h"), F.col("embedding").alias("own"))
    back = spark.read.format(npy.FORMAT).load(path).select(F.hash("embedding").alias("h"), "embedding")
    # rows of the array are numbered anew, so they are found again by what they hold
    same = ids.join(back.dropDuplicates(["embedding"]), "h").where(F.col("own") == F.col("embedding"))
    return same.select("vec_id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"), F.size("embedding").alias("n"))
