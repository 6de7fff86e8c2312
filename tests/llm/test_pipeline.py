"""The pipeline's rows against a plain version of its stages; only the scores of toxicity are the operator's own (its parts are tested apart)."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_dedup import _line_shingles, _roots, _shingles, _weighted
from test_packing import _check, _distance, _normal

import corpus_pipeline
from farsight.llm import decontamination, line_dedup, packing, toxicity


def _without_lines(rows):
    """The texts of {doc_id: text} without the lines that alike earlier ones make superfluous."""
    places = {}
    for i in sorted(rows):
        for k, line in enumerate((rows[i] or "").split("\n")):
            if len(x := line.strip(" ").lower()) >= line_dedup.MIN_CHARS:
                places.setdefault(x, (i, k))
    names = sorted(places, key=places.get)
    sets = [_line_shingles(n) for n in names]
    links = [(a, b) for a in range(len(names)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = dict(zip(names, _roots(len(names), links), strict=True))

    def stays(i, k, line):
        x = line.strip(" ").lower()
        return x not in root or places[names[root[x]]] == (i, k)

    return {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if stays(i, k, x)) for i, t in rows.items()}


def _one_of_each_class(rows):
    ids = sorted(rows)
    sets = [_shingles(rows[i] or "") for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and _weighted(sets[a], sets[b]) >= 0.8]
    return {i: rows[i] for i, r, k in zip(ids, _roots(len(ids), links), range(len(ids)), strict=True) if r == k}


def _without_leaks(rows, items):
    index = decontamination.build_index([i for i, _ in items], [t for _, t in items])
    normal = [(_normal(t), index.budget[k]) for k, (_, t) in enumerate(items)]
    assert all(len(n) >= decontamination.Q for n, _ in normal)
    return {i: t for i, t in rows.items() if not any(_distance(n, _normal(t or "")) <= most for n, most in normal)}


def _pieces(rows, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in rows.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            yield i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def test_pipeline_matches_a_plain_version(spark, corpus, sf_dir, tmp_path):
    r = corpus.random
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(70).collect()
    rows = {x["doc_id"]: x["text"] for x in given}
    items = [(i, corpus.text(r.randrange(12, 25))) for i in range(10)]
    lines = [corpus.text(12) for _ in range(4)]
    at = 10**6
    for k in range(12):
        base = "\n".join(corpus.text(r.randrange(10, 40)) for _ in range(4))
        # near copies whose lines break elsewhere, so that the line stage leaves them to the next one
        words = corpus.text(160).split(" ")
        near = ["\n".join(" ".join(words[x : x + n]) for x in range(0, 160, n)) for n in (160, 11, 19)]
        planted = [base, f"{corpus.text(30)}\n{corpus.edited(r.choice(lines), 1)}\n{r.choice(lines)}", near[0], corpus.edited(near[1], 2), near[2] + " " + corpus.text(k)]
        planted.append(f"{corpus.text(20)} {corpus.edited(r.choice(items)[1], k % 4)} {corpus.text(20)}")
        for text in planted:
            rows[at] = text
            at += 1
    rows |= {at: None, at + 1: "", at + 2: " \n ", at + 3: corpus.text(6000)}
    place = f"file://{tmp_path}"
    corpus.frame(list(rows.items())).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{place}/labels.parquet")

    docs = spark.read.parquet(f"{place}/documents.parquet")
    scored = toxicity.fit_from(spark, docs, place).score(docs.select("doc_id", "text"))
    toxic = {x["doc_id"] for x in scored.where(F.col("predicted") == 1).collect()}
    steps = [{i: t for i, t in rows.items() if i not in toxic}]
    steps.append(_without_lines(steps[-1]))
    steps.append(_one_of_each_class(steps[-1]))
    steps.append(_without_leaks(steps[-1], items))
    assert steps[0] != steps[1] and len(steps[1]) > len(steps[2]) > len(steps[3])
    expected = sorted(_pieces(steps[3]))
    found = corpus_pipeline.run(spark, place).collect()
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in found) == expected
    used = _check([(x["sequence_id"], x["offset"], x["length"]) for x in found], 4096)
    assert used <= -(-sum(x[3] for x in expected) // 4096) + 1 and max(Counter(x[0] for x in expected).values()) > 1
