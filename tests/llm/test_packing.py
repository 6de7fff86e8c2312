"""Packing and decontamination against plain versions, and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from farsight.llm import decontamination, packing, shared


def _check(placed, capacity):
    """Whether rows (sequence, offset, length) fill sequences without gaps; their number."""
    by = defaultdict(list)
    for s, o, n in placed:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(8))
def test_plans_place_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([12, 30, 100])
    counts = {n: r.randrange(1, 40) for n in r.sample(range(1, capacity + 1), min(capacity, 12))}
    plan = packing.plan(counts, capacity)
    placed = []
    for x in plan.itertuples():
        placed += [(x.sequence + i, x.offset + k * x.length, x.length) for i in range(x.n) for k in range(x.each)]
    assert {n: sum(1 for p in placed if p[2] == n) for n in counts} == counts
    used = _check(placed, capacity)
    total = sum(n * c for n, c in counts.items())
    bins = []  # plain best-fit decreasing
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [b for b in bins if b[0] >= n]
        b = min(fits, default=None, key=lambda b: b[0])
        if b is None:
            bins.append([capacity - n])
        else:
            b[0] -= n
    assert -(-total // capacity) <= used <= len(bins) * 1.05 + 1


def test_documents_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    rows = corpus.awkward()[:3] + [(i + 10, corpus.text(corpus.random.randrange(1, 400))) for i in range(40)] + [(60, "x\x01y <|endoftext|> ΑΣ İ ﬁ")]
    found = packing.pack_documents(corpus.frame(rows, extra=True), capacity=256, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) <= 256 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, text in rows:
        parts = sorted(by[i], key=lambda r: r["piece"])
        ids = [x for p in parts for x in p["ids"]]
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert [p["start"] for p in parts] == [256 * k for k in range(len(parts))]
    _check([(r["sequence_id"], r["offset"], r["length"]) for r in found], 256)


def test_encoder_agrees_with_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "_CACHED", 60)
    monkeypatch.setattr(packing, "_AT_ONCE", 2000)
    encoder = packing._Encoder(packing.tokenizer_path())
    r = random.Random(7)
    odd = ["", " ", "\n\t", "\x01", "\x1c", "\x85", "\u00a0", "\u3000", "<|endoftext|>", "don't", "I'LL", "'s", "ab.", "ab,", ".", ",,", "\u0130", "\u0131", "\ufb01", "e\u0301", "\u00e9", "\u00df", "\u03a3\u03a3", "\u4e2d\u6587", "\U0001f600", "12.5", "a1b2", "x_y", "\u200d", "\ufeff", "\x00", "NA\u00cfVE"]
    texts = odd + [c * n for c in map(chr, r.sample(range(1, 0x3000), 600)) for n in (1, 3)]
    for _ in range(1500):
        parts = [r.choice(odd) if r.random() < 0.3 else "".join(r.choice("abcdeTHEin.,!\u00e9\u00f1\u00d6 ") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 12))]
        texts.append(r.choice(["", " ", "\n"]).join(parts))
    for _ in range(2):  # the second time from the cache
        for text, code in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(code, "<u4").tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1], repr(text)
    assert 0 < len(encoder.known) <= 60


def test_a_word_is_learned_once_in_all_its_forms():
    encoder = packing._Encoder(packing.tokenizer_path())
    text = "Straw straw, STRAW. (straw) straw!!! \u00c9t\u00e9 \u00e9t\u00e9.%%% it's its'. straw_ <straw> |"
    (code,) = encoder.encode([text])
    assert np.frombuffer(code, "<u4").tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert encoder._parts(text)[:5] == ["straw", "straw", ",", "straw", "."]
    assert {"(straw", "<straw", "straw", "\u00e9t\u00e9"} >= {p for p in encoder._parts(text) if "straw" in p or "t\u00e9" in p}
    assert encoder._parts("A <|endoftext|> B.") == ["A", "<|endoftext|>", "B."] and encoder._parts("\u4e2d. B.") == ["\u4e2d.", "B."]


def test_merges_of_many_words_agree_with_the_tokenizer():
    encoder, r = packing._Encoder(packing.tokenizer_path()), random.Random(11)
    letters = "etaoinshrdlu\u00e9\u00f1\u00f6\u00df\u0153\u0101"
    words = ["a", "\u00e9", "aaaaaaaaaaaaa", *("".join(r.choice(letters) for _ in range(r.randrange(1, 30))) for _ in range(4000)), "thethethethe" * 40]
    expected = [np.array(encoder.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert encoder.merges.ids(words) == expected and encoder.merges.ids([]) == []


def test_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(5000).selectExpr("id AS doc_id", "'some text' AS text").coalesce(1)
    try:
        for given, then in (("10000", "1000"), ("0", "1000"), ("70", "70")):
            spark.conf.set(key, given)
            packing.tokenize(docs, packing.tokenizer_path())
            assert spark.conf.get(key) == then
        spark.conf.set(key, "10000")
        shared.small_batches(spark)
        sizes = docs.mapInArrow(lambda it: (b.slice(0, 1).set_column(0, "doc_id", pa.array([b.num_rows])) for b in it), "doc_id long, text string")
        assert [r[0] for r in sizes.collect()] == [1000] * 5
    finally:
        spark.conf.set(key, before)


def test_pieces_of_any_table_are_placed(spark):
    lengths = [3, 3, 5, 12, 7, 7, 1, 1, 1, 4] * 9
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "name long, length long").repartition(3)
    found = packing.pack(df, 12).collect()
    assert sorted(r["name"] for r in found) == list(range(90))
    assert _check([(r["sequence_id"], r["offset"], r["length"]) for r in found], 12) <= -(-sum(lengths) // 12) + 2


def test_packing_awkward_rows(spark, corpus):
    rows = corpus.awkward()
    found = packing.pack_documents(corpus.frame(rows, extra=True)).collect()
    assert sum(r["piece"] == 0 for r in found) == len(rows)
    _check([(r["sequence_id"], r["offset"], r["length"]) for r in found], packing.CAPACITY)
    assert packing.pack_documents(corpus.frame(rows).limit(0)).count() == 0


def _distance(item, text):
    """Least edits of the item against any passage of the text."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text])
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))])
        row = np.minimum.accumulate(new - steps) + steps
    return row.min()


def _normal(text):
    import re

    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def test_leaks_match_brute_force(spark, corpus):
    r = corpus.random
    items = [(i, corpus.text(r.randrange(3, 40))) for i in range(25)] + [(90, "short one"), (91, "")]
    docs = []
    for i in range(60):
        parts = [corpus.text(r.randrange(0, 60))]
        if i % 3 == 0:
            passage = list(r.choice(items[:25])[1])
            for _ in range(r.randrange(0, 9)):
                at = r.randrange(len(passage))
                passage[at : at + r.choice((0, 1, 1))] = r.choice(("", "q", "qz"))
            parts += ["".join(passage).upper() if i % 2 else "".join(passage).replace(" ", " \n")]
        docs.append((i, " ".join([*parts, corpus.text(r.randrange(0, 60))])))
    docs += [(100, "only a short one here"), (101, "a shortish one")]
    index = decontamination.build_index([i for i, _ in items], [t for _, t in items])
    expected = set()
    for d, text in docs:
        for k, (i, t) in enumerate(items):
            n = _normal(t)
            if len(n) >= decontamination.Q:
                if _distance(n, _normal(text)) <= index.budget[k]:
                    expected.add((d, i))
            elif n and f" {n} " in f" {_normal(text)} ":
                expected.add((d, i))
    found = decontamination.find_leaks(corpus.frame(docs), spark.createDataFrame(items, "item_id long, text string"), block=800).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == expected and len(expected) > 8
    texts, names = dict(docs), dict(items)
    for x in found:
        assert _distance(_normal(names[x["item_id"]]), _normal(texts[x["doc_id"]][x["start"] : x["end"]])) <= x["edits"] + 2
    clean = decontamination.decontaminate(corpus.frame(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"] for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_leaks_of_repeated_words_and_of_many_texts_at_once(corpus):
    # as one batch, in any order: every text is judged by itself
    items = ["ab cd " * 12, "echo " * 20, corpus.text(12), "the long and winding road leads on and on"] + [f"common phrase of all items here {corpus.text(6)}" for _ in range(40)]
    index = decontamination.build_index(list(range(len(items))), items)
    texts = []
    for t in items:
        texts += [t, "x " + t, corpus.text(5) + " " + t + " " + corpus.text(3), t[: len(t) // 2]] * 2
    texts += ["common phrase of all items here " * 30, "", "ab cd " * 6, "echo " * 45, "echo " * 19, corpus.text(30)]
    expected = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if _distance(_normal(x), _normal(t)) <= index.budget[i]}
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
        for limit in (64, 1 << 21):
            found = decontamination.matches(index, [texts[d] for d in order], limit=limit)
            assert {(order[r[0]], r[1]) for r in found} == expected
    assert len(expected) >= 6 * len(items)
    for d, i, start, end, edits in decontamination.matches(index, texts):
        assert 0 <= start < end <= len(texts[d]) and _distance(_normal(items[i]), _normal(texts[d][start:end])) <= edits + 2
    twice = [r for r in decontamination.matches(index, [f"{items[2]} and then {corpus.text(9)} {items[2]}"]) if r[1] == 2]
    assert len(twice) == 2 and sum(r[1] == 1 for r in decontamination.matches(index, ["echo " * 45])) == 2


def test_leaks_of_items_that_share_phrases(corpus, monkeypatch):
    r, phrase = corpus.random, "answer the following question by choosing the best one of the four options given here"
    words = ["".join(r.choice("etaoinshrdlcump") for _ in range(r.randint(3, 8))) for _ in range(500)]

    def some(n):
        return " ".join(r.choice(words) for _ in range(n))

    items = [f"{phrase} {some(n)}" for n in [14] * 90 + [8] * 60 + [1] * 40]
    items += [items[3], items[3].upper(), items[-1], some(20), phrase]
    index = decontamination.build_index(list(range(len(items))), items)
    # of each kind: rare q-grams of several lengths, and items that the phrase fills nearly whole
    assert len({g.q for g in index.levels if len(g.least) and g.q < decontamination.Q}) >= 2 and sum(g.q == decontamination.Q for g in index.levels) >= 2
    texts = [" ".join([phrase] * 30), " ".join(f"{phrase} {some(10)}" for _ in range(20))]
    for i in (3, 100, 170, len(items) - 2):
        t = items[i]
        texts += [f"{phrase} {t[:40]}q{t[41:]} {phrase}", t[:-2] + "zz", f"{some(9)} {t[:20] + t[23:]} {some(4)}"]
    expected = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if _distance(_normal(x), _normal(t)) <= index.budget[i]}
    assert {(x[0], x[1]) for x in decontamination.matches(index, texts)} == expected and len(expected) >= 12
    assert {x[1] for x in decontamination.matches(index, [items[3]])} >= {3, len(items) - 5, len(items) - 4}
    # many items with one phrase against a text full of it: next to nothing is aligned
    many = decontamination.build_index(list(range(3000)), [f"{phrase} {some(14)}" for _ in range(3000)])
    aligned, whole = [], decontamination._aligned
    monkeypatch.setattr(decontamination, "_aligned", lambda a, b: aligned.append(len(a)) or whole(a, b))
    assert decontamination.matches(many, [" ".join([phrase] * 120)]) == [] and sum(aligned) < 100


def test_leaks_awkward_rows(spark, corpus):
    lowest = corpus.frame([(-(1 << 63), "the long and winding road leads on and on")])
    assert [x["doc_id"] for x in decontamination.find_leaks(lowest, spark.createDataFrame([(1, "the long and winding road")], "item_id long, text string")).collect()] == [-(1 << 63)]
    rows = corpus.awkward()
    df = corpus.frame(rows, extra=True)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, rows[3][1]), (None, rows[3][1])], "item_id long, text string")
    found = decontamination.find_leaks(df, items).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in found if r["doc_id"] != 7) == [(False, 4), (False, 4), (True, None)]
    kept = decontamination.decontaminate(df, items)
    assert kept.columns == df.columns and kept.count() == len(rows) - 4
    assert decontamination.find_leaks(df.limit(0), items).count() == 0 and decontamination.decontaminate(df, items.limit(0)).count() == len(rows)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf_dir)
        docs = docs.cache()
        seen.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == first.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert [n for n, _ in seen] == ["toxicity", "line_dedup", "minhash_dedup", "decontamination", "packing"]
    assert seen[0][1] == seen[1][1] >= seen[2][1] >= seen[3][1] > 0.7 * seen[0][1]
    assert docs.select("doc_id").distinct().count() == seen[3][1]
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[4][1]
