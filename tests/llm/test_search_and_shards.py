"""Shards, ranked lexical search and hard negatives against plain versions."""

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from farsight.llm import hard_negatives, lexical, sharding

# --- shards


def _differenced(sizes, shards):
    """Sums by differencing, on plain tuples."""
    heap = [(-s, i, (s,) + (0,) * (shards - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = tuple(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
        heapq.heappush(heap, (both[-1] - both[0], n, both))
        n += 1
    return sorted(heap[0][2]) if heap else []


@pytest.mark.parametrize("n, shards", [(0, 3), (1, 3), (2, 3), (9, 2), (200, 7), (1000, 40), (30, 1)])
def test_differencing_gives_the_sums_of_plain_tuples(n, shards):
    sizes = np.random.default_rng(n).integers(1, 5000, n)
    shard = sharding.difference(sizes, shards)
    assert len(shard) == n
    if n:
        assert sorted(np.bincount(shard, weights=sizes, minlength=shards).astype(int)) == _differenced(sizes.tolist(), shards)


def test_a_giant_stands_alone_and_the_rest_is_even():
    sizes = np.array([10**6, *np.random.default_rng(3).integers(50, 100, 3000)])
    sums = np.bincount(sharding.difference(sizes, 8), weights=sizes, minlength=8)
    assert sums[0 if sums[0] == 10**6 else int(sums.argmax())] == 10**6
    rest = np.sort(sums)[:-1]
    assert rest.max() - rest.min() <= 100


def _law_holds(rows, texts, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < shards for s in slots)


def test_awkward_documents_are_sharded(corpus):
    texts = corpus.awkward() + [(100 + i, "same words here") for i in range(30)]
    rows = sharding.shard_documents(corpus.frame(texts, extra=True), 5).collect()
    _law_holds(rows, texts, 5)
    by_crc = defaultdict(set)
    for r in rows:
        by_crc[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_crc.values())
    assert sharding.shard_documents(corpus.frame([])).count() == 0


def test_bundles_of_small_groups_are_even(spark, corpus):
    texts = [(i, corpus.text(corpus.random.randrange(1, 40)) + f" {i}") for i in range(3000)] + [(9000 + i, "a copy " * 20) for i in range(200)]
    docs = corpus.frame(texts)
    made, digests = sharding.plan_documents(docs, 4, parts=50)
    assert made.n_bundles and made.large.count() <= 4 * 50 and made.bundles.count() <= 4 * 50
    rows = sharding.shard_documents(docs, 4, parts=50).collect()
    _law_holds(rows, texts, 4)
    loads = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows], minlength=4)
    assert loads.max() - loads.min() < 0.01 * loads.mean()


def test_shards_are_written_whole(spark, corpus, tmp_path):
    docs = corpus.frame([(i, corpus.text(20)) for i in range(60)] + corpus.awkward())
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 3)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert back.groupBy("text").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0] == 1


# --- lexical search


def _terms(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(lexical.TERM, text or "")]


def _ranked(docs, items, k=10):
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    holding = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(_terms(t))
    out = set()
    for item, terms in asked.items():
        scored = []
        for i, c, n in counted:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out |= {(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)}
    return out


def _found(df):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()}


def test_ranks_match_brute_force(spark, corpus):
    docs = corpus.awkward() + [(100 + i, corpus.text(corpus.random.randrange(1, 60))) for i in range(300)] + [(900, "Straße ÀB x9 İ"), (901, "straße àb x9 i")]
    items = [(i, corpus.text(8)) for i in range(12)] + [(50, "STRASSE Straße ÀB X9"), (51, None), (52, ""), (53, "?! --"), (54, "nowhere-to-be-found-7"), (None, "the café of one"), (3, "the that with")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(1)).withColumn("rank", F.lit(2))
    expected = _ranked(docs, items)
    frame = corpus.frame(docs, extra=True)
    assert _found(lexical.rank_documents(frame, df, block_docs=7, first=2, growth=2)) == expected
    assert _found(lexical.rank_documents(frame, df, item_block=60)) == expected


def test_no_documents_or_no_items(spark, corpus):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert lexical.rank_documents(corpus.frame([]), items).count() == 0
    assert lexical.rank_documents(corpus.frame([(1, None), (2, "")]), items).count() == 0
    assert lexical.rank_documents(corpus.frame([(1, "some words")]), items.limit(0)).count() == 0


def test_blocks_below_the_bound_are_never_scored(spark, corpus):
    """Documents that hold a rare term stand in few blocks; with these the k-th score passes what common terms can reach."""
    docs = [(i, corpus.text(40)) for i in range(2000)] + [(5000 + i, "zanzibar quokka xylem " + corpus.text(10)) for i in range(20)]
    forward = lexical.written(lexical.forward_index(corpus.frame(docs).coalesce(1), lexical.Vocabulary(["quokka", "the", "zanzibar"])), "forward")
    blocks = lexical.written(lexical.blocks_of(forward, 2020, 81_000, 16), "blocks")
    n = blocks.count()
    queries = lexical.Queries([np.array([0, 1, 2])], np.array([4600, 900, 4600], np.int64))
    found, rounds = lexical.search_blocks(blocks, queries, 5, first=1, growth=2)
    assert all(r["doc_id"] >= 5000 for r in found.collect()) and n > 10 and sum(rounds) <= 4


def test_terms_of_one_hash_are_told_apart():
    vocabulary = lexical.Vocabulary(["alpha", "beta"])
    hashes, order, data, at = vocabulary.by_hash
    texts = np.frombuffer(b"alpha gamma beta", np.uint8)
    start, end = np.array([0, 6, 12]), np.array([5, 11, 16])
    assert vocabulary.find(texts, start, end).tolist() == [0, -1, 1]
    same = np.sort(lexical.ranges(lexical._BYTE[texts], start, end))[:2]  # hashes that belong to other bytes
    vocabulary.__dict__["by_hash"] = (same, np.array([1, 0]), data, at)
    assert set(vocabulary.find(texts, start, end).tolist()) <= {0, -1, 1} and vocabulary.find(texts, start[1:2], end[1:2]).tolist() == [-1]


# --- hard negatives


def _mined(rows, k=5, n=10, low=30, high=90):
    fine = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    anchors = {}
    for i, lab, v in fine:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    dot = lambda a, b: min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(a, b, strict=False))))
    for anchor, (label, v) in anchors.items():
        scored = sorted((-dot(v, w), i, lab) for i, lab, w in fine if i != anchor)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            picked = [(i, -t) for t, i, lab in scored if lab != label and 30 * -s <= 100 * -t <= 90 * -s][:n]
            out.update((anchor, p, r, i, -s, t) for r, (i, t) in enumerate(picked, 1))
    return out


def _rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for c in ("pivot", "distance", "shelf", "segment", "v", "score", "rank", "kind", "done"):
        df = df.withColumn(c, F.lit(1))
    return df


def _negatives(df, **options):
    return Counter(map(tuple, hard_negatives.mine(df, F.expr("vec_id % 100 = 0"), **options).collect()))


def test_negatives_match_brute_force(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 12))
    rows = [(i, int(r.integers(0, 4)), (centres[i % 6] + 0.4 * r.normal(size=12)).tolist()) for i in range(900)]
    rows += [(2000 + i, i % 3, rows[100][2]) for i in range(150)]  # copies of an anchor's vector under three labels
    rows += [(None, 1, [0.1] * 12), (3000, None, [0.1] * 12), (3001, 1, None), (3002, 1, [float("nan")] * 12), (3003, 1, [None] * 12), (3100, 2, [math.inf] * 12), (3200, 1, [0.5, 0.5]), (3300, 2, []), (3201, 3, [0.5] * 12)]
    rows += [rows[200], rows[200], (200, 9, [0.3] * 12), (201, 2, [0.0] * 12)]
    expected = _mined(rows)
    assert len(expected) > 300
    assert _negatives(_rows(spark, rows), shelf_rows=64, segment_rows=16, first=2, growth=3) == expected
    assert _negatives(_rows(spark, rows)) == expected


def test_huge_components_and_empty_tables(spark):
    rows = [(i, i % 2, [float(i) * 1e30, -1.0, 2.0]) for i in range(0, 300, 20)]
    assert _negatives(_rows(spark, rows), segment_rows=4, shelf_rows=8) == _mined(rows)
    rows = [(i, i % 2, [float(i) * 1e5, 1e6 - i, 1.0 * i]) for i in range(0, 300, 20)]
    assert _negatives(_rows(spark, rows), segment_rows=4, shelf_rows=8) == _mined(rows)
    assert not _negatives(_rows(spark, [(100, 1, [1.0])])) and not _negatives(_rows(spark, []))


def test_far_segments_are_never_scanned(spark):
    """Tight clusters: what certifies the nearest rows lies near one pivot."""
    r = np.random.default_rng(8)
    centres = 20 * np.eye(8)
    rows = [(i, 1, (centres[i % 8] + 0.01 * r.normal(size=8)).tolist()) for i in range(4000)]
    index = hard_negatives.build(_rows(spark, rows), shelf_rows=128, segment_rows=32)
    whole = lambda x: F.array(F.lit(x).cast("long"))
    queries = hard_negatives.asks_of(index, index.rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", "v"))
    queries = hard_negatives.written(queries.withColumn("lows", whole(-(1 << 63))).withColumn("highs", whole((1 << 63) - 1)), "queries")
    found, rounds = hard_negatives.search(index, queries, 5, same_label=True)
    assert found.count() == 5 * 40 and sum(rounds) < 0.5 * 40 * len(index.segments)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_lexical_search"])
def test_registered_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    from farsight.llm import registry

    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = c.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in r.description]
    assert Counter(map(tuple, registry.QUERIES[name](spark, sf_dir).select(columns).collect())) == Counter(r.fetchall())
