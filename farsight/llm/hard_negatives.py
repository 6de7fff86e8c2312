"""Hard negatives by inner product, searched by one-dimensional distance keys.

Every vector gets one more component that makes all of the same norm, so that a larger inner product with a query
means a smaller distance to it. The augmented vectors are stored sorted by (pivot, distance to the pivot): by the
triangle inequality, what lies within r of a query stands, for each pivot, in the interval of keys within r of the query's
own distance to that pivot. The sorted rows are cut into short segments, of which only pivot, least and largest key
are held by every task. A query scans the segments in the order of their least possible distance, in rounds that grow by a
factor, and is done when that distance is beyond its k-th row's. A search may ask for scores within bounds too: these are annuli
around the query, and segments that lie inside the hole are passed over.

Segments stand on shelves of some thousand rows; a task holds one shelf and streams the queries that ask for it.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter vector
counts as filled up with zeros; scores beyond 64 bits saturate; a repeated id is several rows, of which the least by (label, vector)
is the anchor, and none is a positive or negative of it; a positive without negatives has no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farsight.llm.shared import shuffle_partitions, written

#: Vectors that the pivots are fitted on (a bounded sample, by hash), and the most pivots.
SAMPLE, MOST_PIVOTS = 4096, 256
#: Rows of a shelf, rows of a segment, and the number of segments from which on segments become longer instead.
SHELF, SEGMENT, MOST_SEGMENTS = 16_384, 512, 1 << 17
#: Segments of each query in the first round, and how many times more each further round takes.
FIRST, GROWTH = 8, 8
#: Rounding of distances, as a share of the norms that enter them.
SLACK = 1e-6
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors stored as bytes, filled up with zeros to `dim` components."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(np.float64)
    n = np.diff(at) // 8
    if (n == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of doubles as bytes."""
    rows = np.ascontiguousarray(rows, np.float64)
    at = pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1] * 8).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, at, pa.py_buffer(rows)])


def prepared(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, v, norm2, top) of the rows that take part (vec_id, label, embedding): v holds floor(scale * x)."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            of = np.repeat(np.arange(len(n)), n)
            fine = np.bincount(of[~np.isfinite(flat)], minlength=len(n)) == 0
            with np.errstate(all="ignore"):
                flat = np.floor(scale * np.where(np.isfinite(flat), flat, 0.0))
                norm2 = np.bincount(of, weights=flat * flat, minlength=len(n))
            top = np.zeros(len(n))
            np.maximum.at(top, of, np.abs(flat))
            at = pa.py_buffer(np.concatenate([[0], np.cumsum(8 * n)]).astype(np.int32))
            v = pa.Array.from_buffers(pa.binary(), len(n), [None, at, pa.py_buffer(np.ascontiguousarray(flat))])
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), v, pa.array(norm2), pa.array(top)], ["vec_id", "label", "v", "norm2", "top"])
            yield out.filter(pa.array(fine))

    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).dropna()
    return rows.mapInArrow(prepare, "vec_id long, label long, v binary, norm2 double, top double")


def fit_pivots(x: np.ndarray, n: int, rounds: int = 5, seed: int = 11) -> np.ndarray:
    """k-means centres of a sample."""
    x = np.unique(x, axis=0)
    pivots = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1)
        for c in np.unique(own):
            pivots[c] = x[own == c].mean(0)
    return pivots


@dataclass(frozen=True)
class DistanceIndex:
    """Rows sorted by (pivot, distance) in the shared folder, and what every task holds of them."""

    rows: DataFrame  # shelf, segment, pivot, distance, vec_id, label, v
    pivots: np.ndarray
    dim: int
    radius2: float  # the squared norm of all augmented vectors
    exact: bool  # whether inner products fit into the whole numbers of a double
    segments: np.ndarray  # in order
    shelf: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _to_pivots(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the augmented vectors (x, last) to each pivot."""
    return np.stack([np.sqrt(((x - p[:-1]) ** 2).sum(1) + (last - p[-1]) ** 2) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def build(rows: DataFrame, scale: float = 256.0, *, shelf_rows: int = SHELF, segment_rows: int = SEGMENT) -> DistanceIndex:
    """An index of rows (vec_id, label, embedding)."""
    table = written(prepared(rows, scale), "vectors")
    n, size, radius2, top = table.agg(F.count("*"), F.max(F.length("v")), F.max("norm2"), F.max("top")).first()
    dim, radius2 = (size or 0) // 8, radius2 or 0.0
    sample = table.orderBy(F.xxhash64("v", "vec_id")).limit(SAMPLE).select("v", "norm2").collect()
    x = np.zeros((len(sample), dim + 1))
    for i, r in enumerate(sample):
        v = np.frombuffer(r["v"], np.float64)
        x[i, : len(v)], x[i, dim] = v, np.sqrt(max(0.0, radius2 - r["norm2"]))
    pivots = fit_pivots(x, int(np.clip(round(n**0.5 / 16), 16, MOST_PIVOTS))) if n else np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = np.sqrt(np.maximum(0.0, radius2 - batch.column("norm2").to_numpy()))
            far = _to_pivots(matrix(batch.column("v"), dim), last, pivots)
            own = far.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(far[np.arange(len(own)), own]), *(batch.column(c) for c in ("vec_id", "label", "v"))], ["pivot", "distance", "vec_id", "label", "v"])

    segment_rows = max(segment_rows, -(-n // MOST_SEGMENTS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, segment, filled, before = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            numbers = np.empty(len(pivot), np.int64)
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if before is not None and pivot[a] != before:
                    segment, filled = segment + 1, 0
                steps = filled + np.arange(b - a)
                numbers[a:b] = segment + steps // segment_rows
                segment, filled, before = segment + int(steps[-1] + 1) // segment_rows, int(steps[-1] + 1) % segment_rows, pivot[a]
            shelf = base + numbers // max(1, shelf_rows // segment_rows)
            yield pa.RecordBatch.from_arrays([pa.array(shelf), pa.array(base + numbers), *batch.columns], ["shelf", "segment", *batch.schema.names])

    keyed = table.mapInArrow(assign, "pivot int, distance double, vec_id long, label long, v binary")
    parts, key = max(shuffle_partitions(rows.sparkSession), -(-n // shelf_rows)), ("pivot", "distance", "vec_id")
    held = written(keyed.repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(cut, "shelf long, segment long, pivot int, distance double, vec_id long, label long, v binary"), "distance-keys")
    found = held.groupBy("segment", "shelf", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high")).orderBy("segment").collect()  # bounded by MOST_SEGMENTS
    return DistanceIndex(
        held, pivots, dim, radius2, dim * (top or 0.0) ** 2 < 2**53, *(np.array([r[c] for r in found], kind) for c, kind in (("segment", np.int64), ("shelf", np.int64), ("pivot", np.int64), ("low", float), ("high", float)))
    )


def asks_of(index: DistanceIndex, queries: DataFrame) -> DataFrame:
    """`queries` (query_id, label, v) with `gaps`, their distances to the pivots, computed once, and `norm2`."""
    dim, pivots = index.dim, index.pivots

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            far = _to_pivots(x, np.zeros(len(x)), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(far), pa.array((x * x).sum(1))], [*batch.schema.names, "gaps", "norm2"])

    return queries.select("query_id", "label", "v").mapInArrow(measure, "query_id long, label long, v binary, gaps binary, norm2 double")


def _lists(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix; what is missing, and nulls, are `fill`."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().fill_null(fill).to_numpy()
    out = np.full((len(n), width), fill, np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _widest(column: pa.Array) -> int:
    return max(1, int(column.value_lengths().to_numpy(zero_copy_only=False).max(initial=1)))


def _route(index: DistanceIndex, state: DataFrame, take: int) -> DataFrame:
    """(shelf, query_id, label, v, lows, highs, kth, segments, done): the next segments of each open query, by shelf.

    state: query_id, label, v, gaps, norm2, lows, highs, kth (null before k rows are found) and done, how many segments it has passed.
    """
    held = state.sparkSession.sparkContext.broadcast((index.segments, index.shelf, index.pivot, index.low, index.high))
    n_pivots, radius2 = len(index.pivots), index.radius2

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, shelf, pivot, low, high = held.value
        for whole in batches:
            for batch in (whole.slice(a, 32) for a in range(0, whole.num_rows, 32)):
                gaps, norm2 = matrix(batch.column("gaps"), n_pivots), batch.column("norm2").to_numpy()
                width = _widest(batch.column("lows"))
                lows, highs = _lists(batch.column("lows"), width, _MOST), _lists(batch.column("highs"), width, _LEAST)
                kth = _lists(batch.column("kth"), width, _LEAST)
                least = np.maximum(lows, kth)
                with np.errstate(all="ignore"):
                    slack = SLACK * (np.sqrt(radius2) + np.sqrt(norm2))
                    distance = lambda s: np.sqrt(np.maximum(0.0, norm2[:, None] + radius2 - 2.0 * s))  # noqa: B023, E731
                    near = distance(highs).min(axis=1) - slack  # no row that is asked for is nearer
                    far = np.where(least == _MOST, -np.inf, distance(least)).max(axis=1) + slack
                # scores of 2**53 and more are rounded in doubles, and sums may overflow: then everything is within reach
                near, far = np.where(np.isfinite(near), near, 0.0), np.where(np.isnan(far), np.inf, far)
                gap = gaps[:, pivot]
                nearest, farthest = np.maximum(0.0, np.maximum(low - gap, gap - high)), gap + high
                want = np.maximum(nearest, near[:, None])
                open_ = (nearest <= far[:, None]) & (farthest >= near[:, None]) | ~np.isfinite(gap)
                done = batch.column("done").to_numpy()
                asked: list[tuple[int, int, np.ndarray, int]] = []
                for i in range(batch.num_rows):
                    order = np.argsort(want[i], kind="stable")
                    ahead = np.flatnonzero(open_[i][order] & (np.arange(len(order)) >= done[i]))[:take]
                    if len(ahead):
                        chosen = np.sort(order[ahead])
                        for s in np.unique(shelf[chosen]):
                            asked.append((int(s), i, segments[chosen[shelf[chosen] == s]], int(ahead[-1]) + 1))
                rows = pa.array([a[1] for a in asked], pa.int64())
                columns = [pa.array([a[0] for a in asked], pa.int64()), *(batch.column(c).take(rows) for c in ("query_id", "label", "v", "lows", "highs", "kth"))]
                columns += [pa.array([a[2] for a in asked], pa.list_(pa.int64())), pa.array([a[3] for a in asked], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shelf", "query_id", "label", "v", "lows", "highs", "kth", "segments", "done"])

    return state.select("query_id", "label", "v", "gaps", "norm2", "lows", "highs", "kth", "done").mapInArrow(
        route, "shelf long, query_id long, label long, v binary, lows array<long>, highs array<long>, kth array<long>, segments array<long>, done long"
    )


def products(x: np.ndarray, y: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows of x with those of y, as whole numbers."""
    if exact:
        return (x @ y.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.array([[min(_MOST, max(_LEAST, v)) for v in row] for row in whole(x) @ whole(y).T], np.int64).reshape(len(x), len(y)) if x.shape[1] else np.zeros((len(x), len(y)), np.int64)


def _scan(index: DistanceIndex, routed: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(query_id, wish, vec_id, score): of each shelf, the k best rows for each query and each of its (low, high) wishes."""
    dim, exact = index.dim, index.exact
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    data = index.rows.join(F.broadcast(routed.select("shelf").distinct()), "shelf", "left_semi")
    data = data.select("shelf", F.lit(0).alias("kind"), "segment", F.col("vec_id").alias("id"), "label", "v", *(nothing("array<long>", c) for c in ("lows", "highs", "kth", "segments")))
    asks = routed.select("shelf", F.lit(1).alias("kind"), nothing("long", "segment"), F.col("query_id").alias("id"), "label", "v", "lows", "highs", "kth", "segments")
    n = shuffle_partitions(routed.sparkSession)

    def compare(rows: dict, asks: pa.RecordBatch) -> pa.RecordBatch:
        wide = _widest(asks.column("segments"))
        names, place = rows["names"], rows["place"]
        asked = _lists(asks.column("segments"), wide, -1)
        allowed = np.zeros((asks.num_rows, len(names)), bool)
        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        hit = names[at] == asked
        allowed[np.nonzero(hit)[0], at[hit]] = True
        some = np.flatnonzero(allowed.any(axis=0)[place])  # rows that any of these queries asks for
        ids, labels = rows["ids"][some], rows["labels"][some]
        own, label = asks.column("id").to_numpy(), asks.column("label").to_numpy()
        fits = allowed[:, place[some]] & ((labels[None] == label[:, None]) == same_label) & (ids[None] != own[:, None])
        score = products(matrix(asks.column("v"), dim), rows["x"][some], exact)
        wishes = _widest(asks.column("lows"))
        lows, highs, kth = _lists(asks.column("lows"), wishes, _MOST), _lists(asks.column("highs"), wishes, _LEAST), _lists(asks.column("kth"), wishes, _LEAST)
        out = []
        for w in range(wishes):
            good = fits & (score >= np.maximum(lows[:, w], kth[:, w])[:, None]) & (score <= highs[:, w][:, None])
            many = np.flatnonzero(good.sum(axis=1) > 4 * k)
            if len(many):
                edge = np.partition(np.where(good[many], score[many], _LEAST), -k, axis=1)[:, -k]
                good[many] &= score[many] >= edge[:, None]
            r, c = np.nonzero(good)
            s = score[r, c]
            order = np.lexsort((ids[c], -s, r))
            r, c, s = r[order], c[order], s[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((own[r[best]], np.full(int(best.sum()), w), ids[c[best]], s[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query_id", "wish", "vec_id", "score"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, parts, rows = None, [], None
        for batch in batches:
            at, kind = batch.column("shelf").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if kind[a] == 0:
                    if shelf != at[a]:
                        shelf, parts, rows = at[a], [], None
                    parts.append(batch.slice(a, b - a))
                    continue
                if rows is None:  # the shelf is complete
                    table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    names, place = np.unique(table.column("segment").to_numpy(), return_inverse=True)
                    rows = {"x": matrix(table.column("v"), dim), "ids": table.column("id").to_numpy(), "labels": table.column("label").to_numpy(), "names": names, "place": place}
                    parts = []
                step = max(1, (1 << 21) // len(rows["ids"]))  # so many scores at a time
                for i in range(a, b, step):
                    yield compare(rows, batch.slice(i, min(step, b - i)))

    both = data.unionAll(asks).repartition(n, "shelf").sortWithinPartitions("shelf", "kind", "segment")
    return both.mapInArrow(scan, "query_id long, wish int, vec_id long, score long")


def search(index: DistanceIndex, queries: DataFrame, k: int, *, same_label: bool, first: int = FIRST, growth: int = GROWTH) -> tuple[DataFrame, list[int]]:
    """(query_id, wish, rank, vec_id, score): the k best rows for each wish, and the segment scans of each round.

    queries: query_id, label, v, gaps, norm2 and arrays lows, highs: one wish for each pair, for scores within it. Rows are of
    the query's label or of other labels, and never of its id.
    """
    spark, found, routed, rounds = queries.sparkSession, None, None, []
    for number in count():
        if found is None:
            state = queries.withColumn("kth", F.transform("lows", lambda _: F.lit(None).cast("long"))).withColumn("done", F.lit(0).cast("long"))
        else:
            full = found.where(F.col("rank") == k).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("wish", "score"))).alias("full"))
            passed = routed.groupBy("query_id").agg(F.max("done").alias("done"))  # a query that asked for nothing is done
            state = queries.join(passed, "query_id").join(full, "query_id", "left").withColumn("kth", F.transform("lows", lambda _, i: F.col("full")[i]))
        routed = written(_route(index, state, first * growth**number), "routed")
        n = routed.agg(F.sum(F.size("segments"))).first()[0]
        if not n:
            schema = "query_id long, wish int, rank int, vec_id long, score long"
            return (spark.createDataFrame([], schema) if found is None else found), rounds
        rounds.append(n)
        rows = _scan(index, routed, k, same_label)
        if found is not None:
            rows = found.select("query_id", "wish", "vec_id", "score").unionAll(rows)
        order = Window.partitionBy("query_id", "wish").orderBy(F.desc("score"), "vec_id")
        found = written(rows.select("query_id", "wish", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k), "nearest")


def mine(rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, shelf_rows: int = SHELF, segment_rows: int = SEGMENT, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: vec_id, label, embedding; `anchors` is a condition on vec_id. The positives of an anchor are its best rows of the same label; the
    negatives of a pair are the best rows of other labels whose score is `low` to `high` percent of the positive's.
    """
    index = build(rows, scale, shelf_rows=shelf_rows, segment_rows=segment_rows)
    options = {"first": first, "growth": growth}
    own = index.rows.where(anchors).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "v")).alias("own")).select("query_id", "own.label", "own.v")
    asks = written(asks_of(index, own), "anchors")
    whole = lambda x: F.array(F.lit(x).cast("long"))
    near, _ = search(index, asks.withColumn("lows", whole(_LEAST)).withColumn("highs", whole(_MOST)), positives, same_label=True, **options)
    # p percent of a score, rounded up or down, without leaving 64 bits; only scores of at least 0 can have negatives
    part = lambda p, up: F.expr(f"(score div 100) * {p} + ((score % 100) * {p} + {99 if up else 0}) div 100")
    pairs = near.where("score >= 0").select("query_id", F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), part(low, True).alias("low"), part(high, False).alias("high")).alias("pair"))
    wishes = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list("pair")).alias("pairs"))  # at most `positives`
    wishes = written(wishes.withColumn("lows", F.col("pairs.low")).withColumn("highs", F.col("pairs.high")), "wishes")
    far, _ = search(index, asks.join(wishes.drop("pairs"), "query_id"), negatives, same_label=False, **options)
    return far.join(wishes.select("query_id", "pairs"), "query_id").withColumn("pair", F.expr("pairs[wish]")).select(
        F.col("query_id").alias("anchor_id"), "pair.positive_id", "rank", F.col("vec_id").alias("negative_id"), "pair.positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """The contract's negatives of every anchor and positive; labels of ids divisible by 7 are turned first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    turned = F.when(F.expr("vec_id % 7 = 0"), (label + 1) % 10).otherwise(label)
    return mine(rows.select("vec_id", turned.alias("label"), "embedding"), F.expr("vec_id % 100 = 0"))


ORACLE_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e a, e WHERE a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER pair)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW pair AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER pair <= 10"""
