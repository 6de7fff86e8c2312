import math

import pytest

from farsight.functions import filters
from farsight.operators import statistics, sweeps, workload
from farsight.plans import costs, recommend
from farsight.streaming.workload import rolling_shapes

COLUMNS = ["o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_urgent"]


def test_filter_of_every_kind(spark):
    text = "o_orderstatus IN ('F', 'it''s') AND o_urgent AND o_totalprice BETWEEN 1.5 AND 2000 AND o_orderkey < 77 AND o_orderdate >= '1995-03-15'"
    found = filters.parse_filter(spark, text, COLUMNS)
    assert [(p.column, p.op, p.values) for p in found] == [
        ("o_orderstatus", "in", ("F", "it's")), ("o_urgent", "true", (True,)), ("o_totalprice", "between", (1.5, 2000)), ("o_orderkey", "<", (77,)), ("o_orderdate", ">=", ("1995-03-15",)),
    ]
    assert [(p.op, p.values) for p in filters.parse_filter(spark, "12 >= o_orderkey AND -3 < o_totalprice AND o_orderkey = 4", COLUMNS)] == [("<=", (12,)), (">", (-3,)), ("=", (4,))]
    assert [p.to_sql() for p in found[:3]] == ["\"o_orderstatus\" IN ('F', 'it''s')", '"o_urgent"', '"o_totalprice" BETWEEN 1.5 AND 2000']
    assert [filters.sql_literal(x) for x in (True, 0.1, -7, 1e300, "")] == ["true", "0.1", "-7", "1e+300", "''"]
    with pytest.raises(filters.FilterError):
        filters.sql_literal(math.inf)


@pytest.mark.parametrize(
    "text",
    ["  ", "o_orderkey < 5 OR o_urgent", "NOT (o_orderkey = 5)", "o_orderstatus LIKE 'F%'", "year(o_orderdate) = 1995", "o_orderdate IS NOT NULL", "o_orderkey = o_totalprice", "orders.o_orderkey = 5", "o_comment = 'x'", "o_orderkey > NULL", "o_orderkey = ?", "o_orderkey = 5; DROP TABLE orders", "o_orderkey <> 5"],
)
def test_refused_filters(spark, text):
    with pytest.raises(filters.FilterError):
        filters.parse_filter(spark, text, COLUMNS)


def test_statistics_and_selectivity(spark):
    df = spark.range(64).selectExpr("int(id % 4) AS tenant_id", "int(id) AS score", "id % 2 = 0 AS active")
    stats = statistics.analyze(df, ["tenant_id", "score", "active"])
    of = lambda text: statistics.conjunction_selectivity(stats, filters.parse_filter(spark, text, df.columns))
    assert stats.columns["tenant_id"].n_distinct == 4 and stats.columns["tenant_id"].shares == (0.25,) * 4
    assert of("tenant_id = 1") == 0.25 and of("tenant_id IN (1, 2)") == 0.5 and of("active") == 0.5
    assert abs(of("score < 32") - 0.5) < 0.02 and abs(of("score BETWEEN 16 AND 47") - 0.5) < 0.03
    assert of("tenant_id = 1 AND active") == 0.125
    assert statistics.suggest_joint_statistics(stats, filters.parse_filter(spark, "tenant_id = 1 AND active", df.columns), 0.0)[0]["confidence"] == 0.75


def test_health_and_severity():
    assert [statistics.health(*x) for x in ((-1, 5), (10_000, 10_100), (10_000, 13_000))] == ["never_analyzed", "fresh", "stale"]
    assert [statistics.severity(*x) for x in ((0.5, 0.5), (0.02, 0.04), (0.01, 0.2))] == ["ok", "warning", "critical"]


def test_costs_by_hand(spark):
    cal = costs.Calibration(0.5, 0.25, 4.0, 0.5, ((20, 0.8), (40, 0.9)))
    assert cal.recall_at(30) == pytest.approx(0.85) and cal.recall_at(10) == 0.8 and cal.recall_at(99) == 0.9
    cases = spark.createDataFrame([(1000, 0.1, 0.05, 0.1, None, 10, 40, 100)], "n_rows long, s_global double, s_local double, s_index double, s_partition double, k int, ef int, max_scan int")
    found = {r["strategy"]: r for r in costs.estimates(cases, cal).collect()}
    assert found["exact"]["latency_us"] == pytest.approx(0.75 * 100 + 0.25 * 100 * math.log2(10))
    assert found["postfilter"]["latency_us"] == pytest.approx(2 * 40 * math.log(1000)) and found["postfilter"]["recall"] == pytest.approx(0.9 * 0.2) and not found["postfilter"]["returns_k"]
    assert found["iterative_strict"]["latency_us"] == pytest.approx(1.5 * found["iterative_relaxed"]["latency_us"]) and not found["iterative_relaxed"]["returns_k"]
    assert found["partial"]["latency_us"] == pytest.approx(2 * 40 * math.log(100)) and "partition" not in found


def test_calibration_round_trip(tmp_path):
    cal = costs.fit(2048, 0.1, 10, 100.0, [(20, 50.0, 0.6), (40, 100.0, 0.5), (80, 200.0, 0.9)])
    assert [r for _, r in cal.recall_curve] == [0.6, 0.6, 0.9]
    cal.save(str(tmp_path / "c" / "cal.json"))
    assert costs.Calibration.load(str(tmp_path / "c" / "cal.json")) == cal
    with pytest.raises(ValueError):
        costs.Calibration(recall_curve=((40, 0.9), (20, 0.8)))


def test_recommendation_prefers_a_fitting_copy(spark):
    df = spark.range(2000).selectExpr("int(id % 50) AS tenant_id")
    stats = statistics.analyze(df, ["tenant_id"])
    wanted = filters.parse_filter(spark, "tenant_id = 1", df.columns)
    plain = recommend.recommend(spark, stats, wanted, k=10).collect()
    assert plain[0]["place"] == 1 and plain[0]["viable"] and {r["strategy"] for r in plain} >= {"exact", "postfilter", "iterative_relaxed", "iterative_strict", "partial"}
    layout = recommend.Layout("/x", "filtered", wanted)
    assert "frontier" in next(r for r in recommend.recommend(spark, stats, wanted, k=10, layouts=(layout,)).collect() if r["strategy"] == "partial")["note"]


def test_regions_and_crossovers(spark):
    points = spark.createDataFrame([(0.0, s, w) for s, w in ((0.01, "a"), (0.02, "a"), (0.08, "b"), (0.3, "a"))], "correlation double, selectivity double, winner string")
    assert [(r["strategy"], r["n_points"]) for r in sweeps.winner_regions(points).orderBy("region").collect()] == [("a", 2), ("b", 1), ("a", 1)]
    assert sorted(round(r["estimated"], 6) for r in sweeps.crossovers(points).collect()) == [0.04, round(math.sqrt(0.024), 6)]


LOG = "queryid string, query string, calls long, rows long, total_exec_time_ms double"


def test_workload_shapes(spark):
    rows = [
        ("1", "SELECT id FROM docs WHERE a = 1 AND b BETWEEN 2 AND 3 ORDER BY v <-> $1 LIMIT 5", 2, 10, 4.0),
        ("2", "select id from docs where a = $2 and b between 7 and 8 order by v <-> $1 limit 5;", 1, 5, 1.0),
        ("3", "SELECT id FROM s.docs WHERE a = 1 OR b = 2 ORDER BY v <=> $1", 1, 1, 1.0),
        ("4", "SELECT 1; SELECT id FROM docs ORDER BY v <-> $1", 1, 1, 1.0),
        ("5", "SELECT id FROM docs ORDER BY id", 1, 1, 1.0),
    ]
    found = {r["queryid"]: r for r in workload.shapes(spark.createDataFrame(rows, LOG)).collect()}
    assert set(found) == {"1", "2", "3"}
    assert found["1"]["template"] == found["2"]["template"] == "a = <value> AND b BETWEEN <value> AND <value>"
    assert [p["value_kind"] for p in found["2"]["predicates"]] == ["parameter", "constant"] and found["3"]["n_unsupported"] == 1
    assert found["1"]["limit"]["value"] == 5 and found["3"]["limit"]["kind"] == "absent"


def test_workload_brackets_quotes_and_report(spark):
    search = "SELECT id FROM t WHERE {} ORDER BY v <-> $1 LIMIT 5"
    conditions = {
        "quoted": "a = 'x and y or z' AND b = 'it''s; -- (' AND c = 1", "brackets": "(a = 1) AND (b = 2 AND c = 3) AND d IN (1, 2)", "disjunction": "a = 1 AND b = 2 OR c = 3", "inner": "(a = 1 OR b = 2) AND c = 3",
        "subquery": "a IN (SELECT x FROM s WHERE y = 1 AND z IN (SELECT max(w) FROM u) ORDER BY x) AND c = 3", "forms": "lower(a) = 'x' AND b IS NOT NULL AND c LIKE 'y%' AND d <> 4 AND NOT e",
        "comment": "a = 1 /* AND b = 2 */ AND c BETWEEN 1 AND 2",
    }
    rows = [(k, search.format(c), 1, 1, 1.0) for k, c in conditions.items()]
    rows += [("two", "SELECT 1; SELECT 2", 2, 1, 1.0), ("update", "UPDATE t SET a = 1", 3, 1, 1.0), ("plain", "SELECT id FROM t ORDER BY v", 4, 1, 1.0), ("null", None, 5, 1, 1.0), ("no where", "select * from t order by v <=> $1", 6, 1, 1.0)]
    log = spark.createDataFrame(rows, LOG)
    found = {r["queryid"]: (r["template"], r["unsupported"]) for r in workload.shapes(log).collect()}
    assert found == {
        "quoted": ("a = <value> AND b = <value> AND c = <value>", []), "brackets": ("a = <value> AND d IN (<value>)", ["nested_and"]), "disjunction": ("", ["or"]), "inner": ("c = <value>", ["or"]),
        "subquery": ("c = <value>", ["subquery"]), "forms": ("", ["function", "negation", "negation", "null_test", "pattern"]), "comment": ("a = <value> AND c BETWEEN <value> AND <value>", []), "no where": ("", []),
    }
    told = {(r["outcome"], r["reason"]): (r["n_statements"], r["calls"]) for r in workload.report(log).collect()}
    assert told == {
        ("complete", ""): (3, 8), ("partial", "nested_and"): (1, 1), ("partial", "or"): (2, 2), ("partial", "subquery"): (1, 1), ("partial", "function"): (1, 1), ("partial", "negation"): (1, 1),
        ("partial", "null_test"): (1, 1), ("partial", "pattern"): (1, 1), ("rejected", "several_statements"): (1, 2), ("rejected", "no_select"): (2, 8), ("rejected", "no_vector_order"): (1, 4),
    }
    assert workload.report(log.limit(0)).count() == 0


def test_fronts_and_curves_by_group(spark):
    points = [("a", "p", 0.9, 10.0), ("a", "q", 0.9, 10.0), ("a", "r", 0.8, 10.0), ("a", "s", 0.9, 5.0), ("a", "t", 1.0, 1.0), ("b", "u", 0.1, 1.0)]
    front = sweeps.pareto(spark.createDataFrame(points, "filter string, strategy string, recall double, qps double"), "filter")
    assert {r["strategy"] for r in front.collect()} == {"p", "q", "t", "u"}
    curve = sweeps.monotone(spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("b", 2, 0.3)], "filter string, ef int, recall double"), "filter")
    assert {tuple(r) for r in curve.collect()} == {("a", 1, 0.5), ("a", 2, 0.5), ("b", 2, 0.3)}


def test_streaming_shapes(spark, tmp_path):
    rows = [("1", LOG_QUERY, 2, 10, 4.0, "2026-01-01 00:01:00"), ("2", LOG_QUERY, 3, 10, 4.0, "2026-01-01 00:02:00"), ("3", LOG_QUERY, 1, 1, 1.0, "2026-01-01 00:07:00")]
    spark.createDataFrame(rows, LOG + ", ts string").selectExpr("queryid", "query", "calls", "rows", "total_exec_time_ms", "timestamp(ts) AS ts").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "log")).schema).parquet(str(tmp_path / "log"))
    run = rolling_shapes(stream).writeStream.format("memory").queryName("shapes").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["calls"] for r in spark.table("shapes").collect()) == [1, 5]


LOG_QUERY = "SELECT id FROM docs WHERE a = 1 ORDER BY v <-> $1 LIMIT 5"


def _ranking(spark, *rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "place int, strategy string, latency_us double, viable boolean, confidence double, note string")


def test_decisions_and_their_reasons(spark):
    from farsight.plans import recommend as advice

    told = lambda ranked, **known: [r["reason"] for r in advice.reasons(ranked, **known).orderBy("reason_no").collect()]
    two = _ranking(spark, ("partial", 10.0, True, 0.45, "needs a filtered copy"), ("exact", 25.0, True, 0.9, "frontier 40"), ("postfilter", 1.0, False, 0.35, ""))
    row = advice.decision(two).first()
    assert (row["winner"], row["runner_up"], row["ratio"], row["n_candidates"], row["n_viable"], row["confidence_level"]) == ("partial", "exact", 2.5, 3, 2, "medium")
    assert told(two) == ["cheapest_viable partial", "local_selectivity_not_measured", "runner_up_costs_more exact 2.500", "copy_to_be_built partial"]
    alone = _ranking(spark, ("exact", 0.0, False, 0.2, ""))
    assert told(alone, rho=-0.5, observed="postfilter") == ["fallback_none_viable exact", "no_runner_up", "plan_differs postfilter", "filter_avoids_queries", "low_confidence"]
    worse = _ranking(spark, ("partition", 3.0, True, 0.8, "frontier 40"), ("exact", 2.0, False, 0.9, ""))
    assert told(worse, rho=0.3, observed="partition") == ["cheapest_viable partition", "runner_up_not_viable exact", "copy_at_hand partition", "filter_gathers_near_queries"]
    assert told(_ranking(spark).limit(0)) == [] and advice.decision(_ranking(spark).limit(0)).first()["winner"] is None
