"""A neighbour graph inside each shelf of a vector table, and best-first search of the shelves nearest to a query.

Building joins every row of a shelf with its own shelf alone (shelves are bounded), keeps its nearest rows that no kept one
is nearer to, adds the links back and a few far ones so that everything can be reached. Searching walks from the
shelf's entries to ever nearer rows with a frontier of `ef`; only rows met on the way are compared. Rows of a query's shelves
are merged by distance. The number of comparisons of each query and shelf is part of the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farsight.sources.shelves import Shelves, asked, routed, write_shelves

#: Links kept of each row before those back are added, the most after that, far links of each row, and entries of a shelf.
DEGREE, MOST_LINKS, FAR, ENTRIES = 12, 32, 2, 4
#: Nearest rows that links are chosen from.
CANDIDATES = 48
#: Walks whose rows are given out at once.
FRAMES = 256


def link_rows(x: np.ndarray, degree: int = DEGREE, most: int = MOST_LINKS, far: int = FAR, candidates: int = CANDIDATES, seed: int = 5) -> np.ndarray:
    """Links of each row of x by position, nearest first, filled up with -1."""
    n = len(x)
    out = np.full((n, most), -1, np.int32)
    if n < 2:
        return out
    norms = (x**2).sum(axis=1)
    candidates = min(candidates, n - 1)
    chosen: list[list[int]] = []
    for a in range(0, n, 512):
        d = norms[a : a + 512, None] + norms - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, candidates - 1, axis=1)[:, :candidates]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
        for i, row in enumerate(near):
            between = norms[row][:, None] + norms[row] - 2 * x[row] @ x[row].T
            own, kept = d[i][row], []
            for j in range(len(row)):
                if len(kept) == degree:
                    break
                if not kept or own[j] < between[j, kept].min():
                    kept.append(j)
            spare = [j for j in range(len(row)) if j not in kept]
            chosen.append([int(row[j]) for j in sorted(kept + spare[: max(0, degree // 2 - len(kept))])])
    back: list[list[int]] = [[] for _ in range(n)]
    for i, links in enumerate(chosen):
        for j in links:
            back[j].append(i)
    random = np.random.default_rng(seed).integers(0, n, (n, far))
    for i in range(n):
        links = list(dict.fromkeys([*chosen[i], *random[i].tolist(), *back[i]]))[:most]
        out[i, : len(links)] = links
    return out


def best_first(x: np.ndarray, links: np.ndarray, query: np.ndarray, ef: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and squared distances of the up to `ef` nearest rows met, nearest first, and how many rows were compared."""
    seen = np.zeros(len(x), bool)
    seen[entries] = True
    d = ((x[entries] - query) ** 2).sum(axis=1)
    compared = len(entries)
    ahead = list(zip(d.tolist(), entries.tolist(), strict=True))
    heapq.heapify(ahead)
    held = [(-a, -i) for a, i in ahead]
    heapq.heapify(held)
    while len(held) > ef:
        heapq.heappop(held)
    while ahead:
        a, i = heapq.heappop(ahead)
        if len(held) == ef and a > -held[0][0]:
            break
        near = links[i]
        near = near[near >= 0]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        compared += len(near)
        for b, j in zip(((x[near] - query) ** 2).sum(axis=1).tolist(), near.tolist(), strict=True):
            if len(held) < ef:
                heapq.heappush(held, (-b, -j))
            elif b < -held[0][0]:
                heapq.heapreplace(held, (-b, -j))
            else:
                continue
            heapq.heappush(ahead, (b, j))
    found = sorted((-b, -j) for b, j in held)
    return np.array([j for _, j in found], np.int64), np.array([b for b, _ in found]), compared


def write_graph(base: DataFrame, path: str, *, shelf_rows: int = 4096, degree: int = DEGREE, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> Shelves:
    """`base` as shelves whose rows hold `links`, positions within their shelf by id, written to `path`/graph."""
    shelves = write_shelves(base, f"{path}/shelves", shelf_rows=shelf_rows, id_col=id_col, vec_col=vec_col, **options)
    schema = T.StructType([*shelves.rows.schema.fields, T.StructField("links", T.ArrayType(T.IntegerType()))])

    def linked(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col).combine_chunks()
        flat = table.column(vec_col).combine_chunks()
        x = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        links = link_rows(x, degree)
        kept = links >= 0
        at = pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32))
        return table.append_column("links", pa.ListArray.from_arrays(at, pa.array(links[kept])))

    # a shelf is bounded, so its group is
    shelves.rows.groupBy("shelf").applyInArrow(linked, schema).write.mode("overwrite").parquet(f"{path}/graph")
    rows = base.sparkSession.read.schema(schema).parquet(f"{path}/graph")
    return Shelves(rows, *(getattr(shelves, c) for c in ("centres", "number", "centre", "low", "high", "size")))


def nearest_shelves(probes: int):
    """Picks the `probes` shelves of each query with the nearest centres, rings of one centre by their bounds."""

    def pick(known: Shelves, gaps: np.ndarray, some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        near = np.lexsort((known.bounds(gaps), gaps[:, known.centre]), axis=1)[:, :probes]
        return np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()

    return pick


def search_graph(graph: Shelves, queries: DataFrame, k: int, *, ef: int = 40, probes: int = 4, passes: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Approximate: (query_id, rank, vec_id, distance), the first k that pass among the `ef` nearest met; and (query_id, compared).

    A query walks the `probes` shelves with the nearest centres (rings of one centre by their bounds).
    """
    ok = F.coalesce(F.lit(True) if passes is None else passes, F.lit(False))
    flagged = Shelves(graph.rows.withColumn("passes_", ok), *(getattr(graph, c) for c in ("centres", "number", "centre", "low", "high", "size")))

    def walk(rows: dict, asks: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        if "graph" not in rows:
            order = np.argsort(rows[id_col].to_numpy(), kind="stable")  # positions are by id
            lists = rows["links"].take(pa.array(order))
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            links = np.full((len(n), max(1, int(n.max(initial=1)))), -1, np.int32)
            links[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
            x = rows["x"][order]
            middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
            entries = np.unique(np.concatenate([[middle], np.random.default_rng(len(x)).choice(len(x), min(len(x), ENTRIES - 1), replace=False)]))
            rows["graph"] = x, links, entries, rows[id_col].to_numpy()[order], rows["passes_"].to_numpy(zero_copy_only=False)[order]
        x, links, entries, ids, passing = rows["graph"]
        out = []
        for q, v in zip(asks.column("query_id").to_numpy(), asks.column("qvec"), strict=True):
            at, d, compared = best_first(x, links, v.values.to_numpy(), ef, entries)
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at], "distance": np.sqrt(d), "passes": passing[at], "compared": np.where(np.arange(len(at)) == 0, compared, 0)}))
            if len(out) == FRAMES:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    asks = queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec"))
    met = asked(flagged, routed(graph, asks, nearest_shelves(probes)), [id_col, "links", "passes_"], walk, "query_id long, vec_id long, distance double, passes boolean, compared long", vec_col=vec_col)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    frontier = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ef)
    found = frontier.where("passes").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
    return found, met.groupBy("query_id").agg(F.sum("compared").alias("compared"))
