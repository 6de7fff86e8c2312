"""Near-duplicates, repeated passages and lines, and fingerprints, against brute force."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from farsight.llm import components, fingerprints, line_dedup, linking, minhash_dedup, shared, substring_dedup
from farsight.llm.textnum import Words


def _roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _shingles(text):
    w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", text.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _weighted(a, b):
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least)


def test_components(spark):
    r = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(60, 99)]
    found = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = _roots(100, links)
    assert found == {i: roots[i] for i in {x for p in links if p[0] != p[1] for x in p}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_classes_match_brute_force(spark, corpus):
    texts = []
    for _ in range(12):
        base = corpus.text(corpus.random.randrange(30, 300))
        texts += [base, base.upper() + "!"] + [corpus.edited(base, corpus.random.randrange(1, 8)) for _ in range(5)]
    sets = [_shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if _weighted(sets[a], sets[b]) >= 0.8]
    found = {r["doc_id"]: r["class_id"] for r in minhash_dedup.duplicate_classes(corpus.frame(list(enumerate(texts)))).collect()}
    assert [found[i] for i in range(len(texts))] == _roots(len(texts), links)


def test_a_large_group_of_near_copies_stays_whole(spark, corpus):
    base = corpus.text(200)
    rows = [(i, corpus.edited(base, 1 + i % 3)) for i in range(150)] + [(1000 + i, corpus.text(100)) for i in range(20)]
    found = minhash_dedup.duplicate_classes(corpus.frame(rows)).collect()
    assert {r["class_id"] for r in found if r["doc_id"] < 150} == {0}
    assert all(r["class_id"] == r["doc_id"] and r["class_size"] == 1 for r in found if r["doc_id"] >= 1000)


def test_signatures_estimate_weighted_likeness():
    r = np.random.default_rng(5)
    h = r.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = r.integers(1, 9, 300).astype(float), r.integers(1, 9, 300).astype(float)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    k = 4000
    s = minhash_dedup.dart_minhash(np.concatenate([h, h]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, k)
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5


def test_signatures_do_not_depend_on_the_batch():
    r = np.random.default_rng(6)
    short = r.integers(1, 1 << 62, 5).astype(np.uint64)
    alone = minhash_dedup.dart_minhash(short, np.ones(5), np.zeros(5, np.int64), 1, 120)
    for others in (700, 2000, 4000, 9000):
        hashes = np.concatenate([short, r.integers(1, 1 << 62, others).astype(np.uint64)])
        text = np.concatenate([np.zeros(5, np.int64), 1 + np.arange(others) // 9])
        batch = minhash_dedup.dart_minhash(hashes, np.ones(len(hashes)), text, int(text[-1]) + 1, 120)
        assert (batch[0] == alone[0]).all()


def test_minhash_awkward_rows(spark, corpus):
    rows = corpus.awkward()
    df = corpus.frame(rows, extra=True)
    found = minhash_dedup.duplicate_classes(df)
    assert found.count() == len(rows)
    kept = minhash_dedup.deduplicate(df)
    assert kept.columns == df.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count(rows[3][1]) == 1 and sum(t is None or not t.strip() for t in texts) == 4
    assert minhash_dedup.duplicate_classes(df.limit(0)).count() == 0 and minhash_dedup.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [13, 100, 1000])
def test_families_with_several_centres_stay_whole(spark, corpus, size):
    # chains: each text is alike to its neighbours but not to those far off, and all share one bucket
    base = corpus.text(300).split(" ")
    rows = []
    for i in range(size):
        words = list(base)
        words[: i % 13 * 4] = [f"n{k}" for k in range(i % 13 * 4)]
        words.append(f"end{i}")
        rows.append((i, " ".join(words)))
    df = corpus.frame(rows)
    sketched = {r["key"]: r["bands"][0] for r in minhash_dedup.sketch(df.selectExpr("doc_id AS key", "text"), 1, 1).collect()}
    sets = [_shingles(t) for _, t in rows]
    by_bucket = {}
    for i in range(size):
        by_bucket.setdefault(sketched[i], []).append(i)
    links = [(a, b) for m in by_bucket.values() for k, a in enumerate(m) for b in m[:k] if _weighted(sets[a], sets[b]) >= 0.8]
    found = {r["doc_id"]: r["class_id"] for r in minhash_dedup.duplicate_classes(df, bands=1, rows=1).collect()}
    assert [found[i] for i in range(size)] == _roots(size, links)


def test_no_pair_of_a_bucket_is_left_out(spark, corpus):
    rows, base = [], corpus.text(400).split(" ")
    for i in range(15):
        near = base[: 200 + 10 * i] + corpus.text(24).split(" ") + base[224 + 10 * i :]
        far = near[:140] + corpus.text(24).split(" ") + near[164:]
        rows += [(len(rows), " ".join(near)), (len(rows) + 1, " ".join(far))]
    df = corpus.frame(rows)
    sketched = {r["key"]: r["bands"][0] for r in minhash_dedup.sketch(df.selectExpr("doc_id AS key", "text"), 1, 1).collect()}
    sets = [_shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sketched[a] == sketched[b] and _weighted(sets[a], sets[b]) >= 0.8]
    found = {r["doc_id"]: r["class_id"] for r in minhash_dedup.duplicate_classes(df, bands=1, rows=1).collect()}
    assert [found[i] for i in range(len(rows))] == _roots(len(rows), links)


@pytest.mark.parametrize("block", [2, 256])
@pytest.mark.parametrize("size", [4, 20])
def test_the_last_round_compares_every_pair_that_is_left(spark, monkeypatch, block, size):
    monkeypatch.setattr(linking, "BLOCK", block)
    centred = spark.createDataFrame([(7, n, size, 1) for n in range(1, size + 1)], "bucket long, node long, size long, centre long")
    component = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {n: n for n in range(6, size + 1)}
    known = spark.createDataFrame(list(component.items()), "node long, component long")
    signatures = spark.createDataFrame([(n, n) for n in range(1, size + 1)], "node long, signature long")
    split = linking.split_buckets(centred, known)
    alike = F.abs(F.col("signature_a") - F.col("signature_b")) <= 2
    expected = {(a, b) for a in range(2, size + 1) for b in range(a + 1, min(a + 3, size + 1)) if component[a] != component[b]}
    assert {r[0] for r in linking.hopeful(split, signatures, alike).collect()} == {n for p in expected for n in p}
    finer = {tuple(r) for r in linking.finer_pairs(split, signatures, [F.col("signature") % 2]).collect()}
    assert finer and all(component[a] != component[b] and a % 2 == b % 2 for a, b in finer)


def test_early_shingles_meet_in_every_alike_pair(spark):
    r = np.random.default_rng(11)
    base, sets = list(range(60)), {}
    for n in range(1, 90):  # around one original, some around its copies
        own = dict.fromkeys(r.choice(base, int(r.integers(40, 60)), replace=False).tolist(), 1) if n % 3 else dict(sets[n - 1])
        own |= {int(x): int(r.integers(1, 3)) for x in r.integers(100, 900, int(r.integers(0, 9)))}
        sets[n] = own
    rows = [(n, s, w) for n, own in sets.items() for s, w in own.items()]
    early = linking.early_shingles(spark.createDataFrame(rows, "node long, shingle long, weight long"), 0.8)
    split = spark.createDataFrame([(7, n, n, n > 40) for n in sets], "bucket long, node long, component long, away boolean")
    found = [tuple(sorted(x)) for x in linking.rest_pairs(split, early, 0.8).collect()]
    like = lambda a, b: sum(min(a[k], b[k]) for k in a.keys() & b.keys()) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
    alike = {(a, b) for a in sets for b in sets if a < b and b > 40 and like(sets[a], sets[b]) >= 0.8}
    assert len(found) == len(set(found)) and alike <= set(found) and 10 < len(alike) < len(found) < 89 * 88 / 4


def _repeats(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            if first.setdefault(tuple(w[j : j + 20]), (i, j)) != (i, j):
                gone[j : j + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_passages_match_brute_force(spark, corpus):
    shared = [corpus.text(n) for n in (19, 20, 21, 33, 70)]
    rows = []
    for i in range(60):
        parts = [corpus.text(corpus.random.randrange(0, 40))]
        for _ in range(corpus.random.randrange(3)):
            parts += [corpus.random.choice(shared), corpus.text(corpus.random.randrange(0, 15))]
        rows.append((i * 3, " \n".join(parts)))
    rows += [(500, "echo " * 90), (501, shared[4] + "  " + shared[4])]
    found = {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeats(corpus.frame(rows), keep_text=False).collect()}
    assert found == _repeats(rows)
    assert substring_dedup.COVER and {(a - b) % 13 for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(13))


def test_repeats_awkward_rows(spark, corpus):
    rows = corpus.awkward()
    found = substring_dedup.remove_repeats(corpus.frame(rows, extra=True)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert sorted(r["n_removed"] for r in by[4]) == [0, 80, 80] and by[7][0]["n_removed"] == 160 and by[1][0]["n_words"] == 0
    assert sorted(r["n_removed"] for r in by[None]) == [0, 0]
    assert substring_dedup.remove_repeats(corpus.frame(rows).limit(0)).count() == 0


def test_words_split_at_ascii_blanks_only():
    texts = ["a b c\x1cd\te", "", "x"]
    words = Words([t.encode() for t in texts])
    assert words.count.tolist() == [3, 0, 1]


def _line_shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def test_lines_match_brute_force(spark, corpus):
    pool = [corpus.text(n) for n in (2, 4, 12, 25, 40)]
    rows = []
    for i in range(40):
        lines = [corpus.text(corpus.random.randrange(1, 30)) for _ in range(3)] + [corpus.edited(corpus.random.choice(pool[2:]), corpus.random.randrange(3)) for _ in range(2)] + ["", "The end", corpus.random.choice(pool)]
        corpus.random.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    places = {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            if len(x := line.strip(" ").lower()) >= line_dedup.MIN_CHARS:
                places.setdefault(x, (i, k))
    names = sorted(places, key=places.get)
    sets = [_line_shingles(n) for n in names]
    links = [(a, b) for a in range(len(names)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = dict(zip(names, _roots(len(names), links), strict=True))
    expected = {}
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for k, x in enumerate(lines) if (y := x.strip(" ").lower()) not in root or places[names[root[y]]] == (i, k)]
        expected[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(corpus.frame(rows)).select("row.doc_id", "text", "n_lines", "n_removed").collect()}
    assert found == expected and links


def test_unlike_lines_that_begin_alike_stay(spark, corpus):
    lines = [
        "https://example.org/a/first", "https://other.net/zzz", "- https://a.org/x", "- https://b.net/y", "user_id=1001", "user_id=2002",
        "internationalization responsibilities", "internationalism responsibleness", "\u4e2d\u6587\u7684\u4e00\u884c\u6587\u5b57\u5f00\u59cb\u7532\u4e59\u4e19", "\u4e2d\u6587\u7684\u4e00\u884c\u6587\u5b57\u5f00\u5b50\u4e11\u5bc5\u536f\u8fb0",
    ]
    copy = "a line of some length that stands twice but for its last charactes"
    found = line_dedup.dedup_lines(corpus.frame([(1, "\n".join([*lines, copy, copy[:-1]]))])).first()
    assert found["text"] == "\n".join([*lines, copy]) and found["n_removed"] == 1


def test_line_shingles_stand_at_every_position(spark):
    texts = ["abcdefghij", "short", "abcdefgh", "\U0001f600" * 3 + "abcdefg", "a\rb", *("".join(chr(97 + (i * i + n) % 26) for i in range(n)) for n in (15, 16, 23, 24, 31, 32, 39, 200))]
    rows = spark.createDataFrame([(t,) for t in texts], "line string")
    for at_once in (8, 16):
        cut = rows.select("line", F.explode(line_dedup._segments(F.col("line"), at_once)).alias("s"))
        cut = cut.select("line", F.explode(F.array(*(line_dedup._shingle(F.col("s"), i) for i in range(at_once)))).alias("shingle"))
        found = {r["line"]: set(r["s"]) for r in cut.groupBy("line").agg(F.collect_set("shingle").alias("s")).collect()}
        assert found == {t: _line_shingles(t) for t in texts}
    sizes = {r[0]: r[1] for r in rows.select("line", F.size(line_dedup._shingle_set(F.col("line")))).collect()}
    assert sizes == {t: len(_line_shingles(t)) for t in texts}


@pytest.mark.parametrize(("shared", "least"), [(4, 0.97), (8, 0.97), (16, 0.97), (64, 0.97)])
def test_lines_at_the_least_likeness_share_a_band(spark, shared, least):
    # pairs of lines with `shared` shingles in common of shared / 0.8
    r = np.random.default_rng(shared)
    draw = lambda n: "".join(map(chr, 97 + r.integers(0, 26, n)))
    rows, n = [], 2000
    for k in range(n):
        x = draw(shared + 7)
        rows += [(2 * k, x), (2 * k + 1, x + draw(shared // 4))]
    bands = {i: set(b) for i, b in line_dedup._signed(spark.createDataFrame(rows, "node long, line string")).select("node", "bands").collect()}
    recall = sum(bool(bands[2 * k] & bands[2 * k + 1]) for k in range(n)) / n
    print(f"pair recall at likeness 0.8, {shared} shared shingles: {recall:.4f}")
    assert recall >= least


def test_lines_are_signed_without_texts_in_a_shuffle(spark):
    lines = ["abcdefghij", "short", "\U0001f600" * 3 + "abcdefg", "a\rb" * 9, "x" * 100]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines) for _ in range(i + 1)], "node long, line string")
    signed = line_dedup._signed(df)
    assert {r["node"]: r["n"] for r in signed.collect()} == {i: i + 1 for i in range(len(lines))}
    plan = signed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan
    # all shingles of a line, and no others, are hashed
    hashed = line_dedup._hashed(df.distinct()).select("node", F.explode(F.array(*(f"h{j}_0" for j in range(8)))).alias("h"))
    assert {r["node"]: r["n"] for r in hashed.groupBy("node").agg(F.count_distinct("h").alias("n")).collect()} == {i: len(_line_shingles(x)) for i, x in enumerate(lines)}


def test_lines_awkward_rows(spark, corpus):
    rows = corpus.awkward()
    found = line_dedup.dedup_lines(corpus.frame(rows, extra=True)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["row"]["doc_id"], []).append((r["text"], r["n_removed"]))
    assert by[1] == [(None, 0)] and by[2] == [("", 0)] and by[7] == [("", 2)]
    assert line_dedup.dedup_lines(corpus.frame(rows).limit(0)).count() == 0


def test_edited_texts_and_neighbours(spark, corpus):
    rows = [(i * 7 % 101, corpus.text(corpus.random.randrange(0, 50)) + "\U0001f600é") for i in range(101)]
    found = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(corpus.frame(rows).select("doc_id", "text")).collect()}
    down = sorted(rows, reverse=True)
    assert found == {i: down[(k + 1) % len(down)][1] for k, (i, _) in enumerate(down)}
    one = corpus.frame([(3, "abcde")]).select("doc_id", "text")
    row = fingerprints.with_next(one).withColumn("e", fingerprints.edited("text", "next_text")).first()
    assert row["next_text"] == "abcde" and row["e"] == "abcab"


def test_fingerprints_by_hand(spark, corpus):
    rows = [(i, corpus.text(n)) for i, n in enumerate((0, 1, 2, 50, 50))]
    df = corpus.frame(rows)
    terms = df.selectExpr("doc_id", "explode_outer(regexp_extract_all(text, '(?<!\\\\S)(?=(\\\\S+(?:\\\\s+\\\\S+)?))', 1)) AS term").selectExpr("doc_id", "term", "xxhash64(term) AS h").collect()
    expected = {}
    for r in terms:
        votes = expected.setdefault(r["doc_id"], [0] * 64)
        if r["term"] is not None:
            for i in range(64):
                votes[i] += min(len(r["term"]), 64) * (1 if (r["h"] >> i) & 1 else -1)
    found = {r["doc_id"]: r["fingerprint"] & (1 << 64) - 1 for r in fingerprints.fingerprint(df.select("doc_id", "text"), "doc_id").collect()}
    assert found == {i: sum(1 << b for b in range(64) if v[b] > 0) for i, v in expected.items()}


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (0, 1), (2, 4)])
def test_block_tables_find_all_within_the_radius(spark, radius, blocks):
    r = np.random.default_rng(9)
    base = r.integers(-(1 << 63), 1 << 63, 12)
    values = {int(b) for b in base}
    for b in base.tolist():
        for n in (1, 2, 3, 4):
            x = b
            for bit in r.choice(64, n, replace=False).tolist():
                x ^= 1 << bit if bit < 63 else -(1 << 63)
            values.add(x)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "fingerprint long")
    found = [tuple(x) for x in fingerprints.near_pairs(df, radius, blocks).collect()]
    expected = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert len(found) == len(set(found)) and set(found) == expected


def test_fingerprints_awkward_rows(spark, corpus):
    rows = corpus.awkward()
    df = corpus.frame(rows, extra=True).select("doc_id", "text").fillna("", ["text"])
    found = fingerprints.with_next(df).collect()
    assert len(found) == len(rows) and all(r["next_text"] is not None for r in found)
    assert fingerprints.with_next(df.limit(0)).count() == 0


def test_texts_are_dealt_out_once_and_unsorted(spark, corpus):
    found = line_dedup.dedup_lines(corpus.frame([(i, "a line that stands in both\n" + corpus.text(9)) for i in range(2)]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # below the join stand the row and its key only
    assert "shuffle_hash" in plan and re.search(r" AS row#\d+, coalesce\(doc_id#\d+L?, \S+\) AS key#\d+L?\]", plan)
    assert sorted(r["n_removed"] for r in found.collect()) == [0, 1]


def _tables(spark):
    folder = Path(shared.shared_dir(spark).removeprefix("file:"))
    return {p.name for p in folder.iterdir() if any(p.iterdir())} if folder.exists() else set()


def test_of_many_tables_one_stays(spark, corpus):
    # chains of near texts, so that components take some rounds and no round of the linking is left out
    lines = [corpus.text(40) for _ in range(4)]
    rows = [(i, "\n".join(corpus.edited(x, i % 3) for x in lines)) for i in range(12)]
    for result, stays in ((line_dedup.dedup_lines, "line-drops"), (minhash_dedup.duplicate_classes, "classes")):
        before = _tables(spark)
        found = result(corpus.frame(rows))
        assert [x.rpartition("-")[0] for x in _tables(spark) - before] == [stays]
        assert found.count() == 12  # which reads no table that went


def test_scratch_tables_go_with_their_block(spark):
    before = _tables(spark)
    one = lambda: spark.range(3).toDF("n")
    with shared.scratch() as outlives:
        shared.written(one(), "outer")
        with shared.scratch() as inner:
            shared.written(one(), "gone")
            stays = inner(one(), "inner")
        assert {x.rpartition("-")[0] for x in _tables(spark) - before} == {"outer", "inner"} and stays.count() == 3
        last = outlives(stays.selectExpr("n + 1 AS n"), "last")
    with pytest.raises(ZeroDivisionError), shared.scratch():
        shared.written(one(), "failed")
        raise ZeroDivisionError
    assert {x.rpartition("-")[0] for x in _tables(spark) - before} == {"last"} and last.count() == 3
    shared.removed(last, last)
    assert _tables(spark) == before
