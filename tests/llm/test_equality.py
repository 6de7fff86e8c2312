"""Fingerprints of whole tables with awkward ids, and texts that differ only in what hashes may confuse."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from farsight.llm import fingerprints, minhash_dedup, substring_dedup
from farsight.llm.textnum import Words


def _fingerprint(text):
    sums, total = [0] * 64, 0
    for m in re.finditer(r"(?<!\S)(?=(\S+(?:\s+\S+)?))", text, re.ASCII):
        term = m.group(1)
        h, w = xxhash.xxh64(term.encode(), seed=42).intdigest(), min(64, len(term))
        total += w
        for i in range(64):
            sums[i] += w * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * sums[i] > total)


def _plain(rows):
    """The query's rows from lists: a row is (doc_id, text)."""

    def signed(text):
        h = xxhash.xxh64(text.encode(), seed=42).intdigest()
        return h - (1 << 64) if h >> 63 else h

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1] or "")))
    texts = [t or "" for _, t in order]
    own = [_fingerprint(t) for t in texts]
    out = []
    for i, (doc_id, _) in enumerate(order):
        t, nxt = texts[i], (i + 1) % len(texts)
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[nxt][:half]
        f = _fingerprint(edited)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        near = sum(1 for g in set(own) if g != own[i] and (g ^ own[i]).bit_count() <= fingerprints.RADIUS)
        out.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own[i]:016x}", f"{f:016x}", like(own[i], f), like(own[i], own[nxt]), near))
    return sorted(out, key=repr)


def _ids(kind, n):
    return {
        "hashed": [xxhash.xxh64(str(i).encode()).intdigest() - (1 << 63) for i in range(n)],
        "outlying": [*range(n - 3), 1 << 60, (1 << 63) - 1, -(1 << 63)],
        "null": [None] * n,
        "repeated": [7 if i % 3 else i for i in range(n)],
        "plain": list(range(n)),
    }[kind]


@pytest.mark.parametrize("kind", ["hashed", "outlying", "null", "repeated", "plain"])
def test_fingerprint_query_matches_brute_force(spark, corpus, tmp_path, kind):
    texts = [corpus.text(corpus.random.randrange(0, 30)) for _ in range(90)]
    texts[5] = texts[6] = texts[7] + " x"
    texts[20], texts[21], texts[22] = None, "", " \n"
    rows = list(zip(_ids(kind, 90), texts, strict=True))
    corpus.frame(rows, extra=True).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = fingerprints.op6_simhash(spark, f"file://{tmp_path}").collect()
    assert sorted((tuple(r) for r in found), key=repr) == _plain(rows)


def test_ranges_hold_few_rows_each(spark, corpus):
    for kind in ("hashed", "outlying", "null", "repeated"):
        docs = corpus.frame([(i, f"text {k}") for k, i in enumerate(_ids(kind, 2000))]).select("doc_id", "text")
        most = fingerprints._ranged(docs).groupBy("range").count().agg(F.max("count")).first()[0]
        assert most < 400, kind


def test_fingerprint_query_on_no_rows(spark, corpus, tmp_path):
    corpus.frame([]).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert fingerprints.op6_simhash(spark, f"file://{tmp_path}").count() == 0


def _turned(n, first, second):
    """Two sequences that polynomials modulo 2**64 cannot tell apart, whatever their base."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return [[first, second][b] for b in bits], [[second, first][b] for b in bits]


def test_words_that_polynomials_confuse_are_told_apart(spark, corpus):
    a, b = ("".join(x) for x in _turned(1024, "a", "b"))
    assert len(set(Words([a.encode(), b.encode()], by_place=True).hash.tolist())) == 2
    rest = corpus.text(19)
    docs = corpus.frame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")])
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 20}


def test_texts_that_polynomials_confuse_both_stay(spark, corpus):
    a, b = (" ".join(x) for x in _turned(1024, "left", "right"))
    kept = minhash_dedup.deduplicate(corpus.frame([(1, a), (2, b + " and " + corpus.text(2000)), (3, b), (4, a)])).collect()
    nodes = minhash_dedup._node(minhash_dedup._words([a, b, a]))
    assert nodes[0] != nodes[1] and nodes[0] == nodes[2]
    assert {1, 2} <= {r["doc_id"] for r in kept} and 4 not in {r["doc_id"] for r in kept}
