"""Exact top-k inner products by best-first search in M-trees.

Maximum inner product becomes nearest neighbour: with M the largest norm, a candidate x is the point (x, sqrt(M^2 - |x|^2))
and a query q the point (q, 0), so that d^2 = |q|^2 + M^2 - 2 qx. Candidates are dealt into cells around pivots, which are
fitted on a bounded sample (``SAMPLE_ROWS``, ``CELLS``); every row is indexed. A cell is cut into rings by the distance to its
pivot, blocks of about ``BLOCK_ROWS`` rows, and a block is one M-tree: pages of vectors with their distances to the page's
pivot, under routing entries with covering radius, distance to the parent's pivot, and smallest id. The driver holds a row
for each block: its cell, the least and largest distance, and the smallest id.

A query first searches one block near it, which gives it a bound, then the ``NEXT_BLOCKS`` that may hold the best candidates,
which tightens it, and last all blocks that the bound does not rule out. Inside a tree, entries that the stored distances rule
out are never computed. Scores are exact integers; distances only rule out, with a margin above their rounding error.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import Staged, tidy

SAMPLE_ROWS = 4096  # the rows that the pivots are fitted on
CELLS = 16
BLOCK_ROWS = 4096
CHUNK_QUERIES = 4096  # the queries that meet a block in one task
NEXT_BLOCKS = 4
ROUTED_QUERIES = 256  # the queries whose bounds to all blocks are held at a time
PAGE = 256
FAN_OUT = 8
MARGIN = 1e-6
EXACT = 2.0**53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """``vec_id, v array<long>, norm2``: floor(scale * x) of every component.

    Left out: null ids, and vectors that are null, or hold a null or non-finite component.
    """
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(lists: list, dims: int) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    out = np.zeros((len(lists), dims), np.int64)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    x = v.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))[:, None]])


def _largest(v: np.ndarray) -> int:
    return max(int(v.max(initial=0)), -int(v.min(initial=0)))


def _distance(points: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = points - p
    return np.sqrt((d * d).sum(axis=1))


def _fit_pivots(sample: np.ndarray, cells: int) -> np.ndarray:
    """Farthest-first pivots, from the point nearest to the mean."""
    chosen = [int(np.argmin(_distance(sample, sample.mean(axis=0))))]
    near = _distance(sample, sample[chosen[0]])
    while len(chosen) < min(cells, len(sample)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, _distance(sample, sample[chosen[-1]]))
    return sample[chosen]


def build_tree(ids: np.ndarray, v: np.ndarray, top: float) -> dict[str, np.ndarray]:
    """The arrays of one M-tree over the lifted integer vectors ``v``. Node 0 is the root; a leaf owns rows first..first+count, else child nodes."""
    points = _lift(v, top)
    order = np.argsort(ids, kind="stable")
    nodes: list[list] = []  # pivot, radius, parent distance, smallest id, leaf, first, count
    rows: list[np.ndarray] = []
    to_pivot: list[np.ndarray] = []
    placed = 0

    def add(members: np.ndarray, slot: int, parent: np.ndarray | None) -> None:
        nonlocal placed
        mine = points[members]
        pivot = mine[int(np.argmin(_distance(mine, mine.mean(axis=0))))]
        d = _distance(mine, pivot)
        up = 0.0 if parent is None else float(np.sqrt(((pivot - parent) ** 2).sum()))
        if len(members) <= PAGE:
            nodes[slot] = [pivot, float(d.max()), up, int(ids[members].min()), True, placed, len(members)]
            rows.append(members)
            to_pivot.append(d)
            placed += len(members)
            return
        centres = _fit_pivots(mine[:: max(1, len(mine) // 512)], min(FAN_OUT, -(-len(members) // PAGE)))
        nearest = np.argmin(np.stack([_distance(mine, c) for c in centres]), axis=0)
        groups = [members[nearest == k] for k in range(len(centres))]
        groups = [g for g in groups if len(g)]
        if max(map(len, groups)) > 0.9 * len(members):  # as good as equal points: runs of ids prune better than distances
            groups = np.array_split(members, min(FAN_OUT, -(-len(members) // PAGE)))
        first = len(nodes)
        nodes[slot] = [pivot, float(d.max()), up, int(ids[members].min()), False, first, len(groups)]
        nodes.extend([None] * len(groups))
        for k, g in enumerate(groups):
            add(g, first + k, pivot)

    nodes.append([])
    add(order, 0, None)
    at = np.concatenate(rows)
    return {
        "pivot": np.stack([n[0] for n in nodes]), "radius": np.array([n[1] for n in nodes]), "up": np.array([n[2] for n in nodes]),
        "least": np.array([n[3] for n in nodes], np.int64), "leaf": np.array([n[4] for n in nodes]), "first": np.array([n[5] for n in nodes]),
        "count": np.array([n[6] for n in nodes]), "ids": ids[at], "v": v[at], "to_pivot": np.concatenate(to_pivot),
    }


class Search:
    """Best-first search in one tree for the k best scores; ties go to the smaller id."""

    def __init__(self, tree: dict[str, np.ndarray], top: float):
        self.t, self.top, self.computed = tree, top, 0
        self.whole, self.largest = tree["v"], _largest(tree["v"])
        self.floats = self.whole.astype(float)  # exact where their products are small enough
        self.objects: np.ndarray | None = None

    def _exact(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and query in a type whose inner products are exact."""
        if max(1, self.largest) * max(1, _largest(q)) * max(1, len(q)) < EXACT:
            return self.floats, q.astype(float)
        if self.objects is None:
            self.objects = self.whole.astype(object)
        return self.objects, q.astype(object)

    def run(self, own: int, query: np.ndarray, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
        """(score, id) pairs, best first; ``floor`` is a (score, id) that k known candidates reach, which spares what is worse."""
        t, q = self.t, query.astype(float)
        point = np.append(q, 0.0)
        rows, whole = self._exact(query)
        base = float(q @ q) + self.top
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        worst = (floor[0], -floor[1]) if floor else None

        def reach(distance: float) -> float:
            """The largest score at this distance or more."""
            low = max(0.0, distance * (1 - MARGIN) - MARGIN)
            return np.floor((base - low * low) / 2 + MARGIN * max(1.0, abs(base)))

        d0 = float(_distance(t["pivot"][:1], point)[0])
        heap = [(-reach(d0 - t["radius"][0]), int(t["least"][0]), 0, d0)]
        while heap:
            bound, least, node, d = heapq.heappop(heap)
            if worst is not None and (-bound, -least) < worst:
                if -bound < worst[0]:
                    break
                continue
            a, n = int(t["first"][node]), int(t["count"][node])
            apart = np.abs(d - (t["to_pivot"][a : a + n] if t["leaf"][node] else t["up"][a : a + n]))
            if not t["leaf"][node]:
                apart = apart - t["radius"][a : a + n]
            near: slice | np.ndarray = slice(a, a + n)
            if worst is not None:  # the stored distances alone
                low = np.maximum(0.0, apart * (1 - MARGIN) - MARGIN)
                may = np.floor((base - low * low) / 2 + MARGIN * max(1.0, abs(base))) >= worst[0]
                count = int(np.count_nonzero(may))
                if not count:
                    continue
                if count < n:
                    near, n = a + np.flatnonzero(may), count
            self.computed += n
            if t["leaf"][node]:
                scores, ids = rows[near] @ whole, t["ids"][near]
                if scores.dtype == object:
                    scores = np.clip(scores, _LEAST, _MOST)
                good = ids != own
                if worst is not None:
                    good &= (scores > worst[0]) | ((scores == worst[0]) & (-ids >= worst[1]))
                for s, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (int(s), -i))
                    elif (int(s), -i) > best[0]:
                        heapq.heapreplace(best, (int(s), -i))
                if len(best) == k and (worst is None or best[0] > worst):
                    worst = best[0]
            else:
                away = _distance(t["pivot"][near], point)
                names = range(a, a + n) if isinstance(near, slice) else near.tolist()
                for j, dj in zip(names, away.tolist(), strict=True):
                    heapq.heappush(heap, (-reach(dj - t["radius"][j]), int(t["least"][j]), j, dj))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _pack(tree: dict[str, np.ndarray]) -> bytes:
    np.savez(out := io.BytesIO(), **tree)
    return out.getvalue()


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


class Index:
    """``trees``: ``block, tree`` in a written table; ``blocks``: cell, least and largest distance and smallest id of each block."""

    def __init__(self, candidates: DataFrame):
        """``candidates``: ``vec_id, v, norm2`` from ``quantised``."""
        stats = candidates.agg(F.count("*").alias("n"), F.max("norm2").alias("top"), F.max(F.size("v")).alias("dims")).first()
        self.n, self.top, self.dims = stats["n"], float(stats["top"] or 0.0), int(stats["dims"] or 0)
        self.tables: list[Staged] = []
        if not self.n:
            return
        sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
        self.pivots = _fit_pivots(_lift(_matrix([r["v"] for r in sample], self.dims), self.top), CELLS)
        # a repeated row would take a second place among the k best of its block
        cells = Staged(self._with_cell(candidates.select("vec_id", "v").distinct()), "cells")
        # the last key splits rings of equal distance, as of many equal vectors
        rings = cells.df.repartitionByRange(-(-self.n // BLOCK_ROWS), "cell", "away", F.xxhash64("vec_id"))
        top, dims = self.top, self.dims

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, held = TaskContext.get().partitionId(), list(batches)
            if not held:
                return
            table = pa.Table.from_batches(held)
            cell, away, ids = (table.column(c).to_numpy() for c in ("cell", "away", "vec_id"))
            v = _matrix(table.column("v").to_pylist(), dims)
            for c in np.unique(cell).tolist():
                own = cell == c
                row = {"block": (part << 16) + c, "cell": c, "low": away[own].min(), "high": away[own].max(), "least": ids[own].min(), "tree": _pack(build_tree(ids[own], v[own], top))}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("cell", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("least", pa.int64()), ("tree", pa.binary())]))

        trees = Staged(rings.mapInArrow(tidy(build), "block long, cell long, low double, high double, least long, tree binary"), "mtree")
        cells.drop()
        self.tables.append(trees)
        self.trees = trees.df.select("block", "tree")
        found = trees.df.select("block", "cell", "low", "high", "least").orderBy("block").collect()  # a row for each block
        self.blocks = {c: np.array([r[c] for r in found]) for c in ("block", "cell", "low", "high", "least")}

    def _with_cell(self, rows: DataFrame) -> DataFrame:
        pivots, top, dims = self.pivots, self.top, self.dims

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = _lift(_matrix(batch.column(1).to_pylist(), dims), top)
                d = np.stack([_distance(points, p) for p in pivots], axis=1)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64()), pa.array(d[np.arange(len(cell)), cell])], names=["vec_id", "v", "cell", "away"])

        return rows.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<long>, cell long, away double")

    def _search(self, visits: DataFrame, n_queries: int, k: int) -> DataFrame:
        """``query_id, vec_id, score`` of the k best in each visited block. ``visits``: query_id, v, block, floored, score, vec_id (the floor)."""
        chunks = max(1, -(-n_queries // CHUNK_QUERIES))
        dealt = visits.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
        trees = self.trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")))
        top, dims = self.top, self.dims

        def find(queries: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(queries) and len(tree):
                search = Search(_unpack(tree["tree"].iloc[0]), top)
                columns = (queries[c].tolist() for c in ("query_id", "floored", "score", "vec_id"))
                for v, qid, floored, s, i in zip(_matrix(queries["v"].tolist(), dims), *columns, strict=True):
                    out += [(qid, j, score) for score, j in search.run(qid, v, k, (s, i) if floored else None)]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

        return dealt.groupBy("block", "chunk").cogroup(trees.groupBy("block", "chunk")).applyInPandas(find, "query_id long, vec_id long, score long")

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, rank, vec_id, score`` for ``queries(vec_id, v)``: the k largest inner products with other ids' vectors, ties to smaller ids."""
        spark = queries.sparkSession
        if not self.n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        queries = Staged(queries.groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v"), "queries").df
        n = queries.count()
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        unknown = queries.select("query_id", "v", F.lit(False).alias("floored"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("vec_id"))
        bounded, found, best = unknown, None, None
        for skip, take in ((0, 1), (1, NEXT_BLOCKS), (1 + NEXT_BLOCKS, None)):
            if skip >= len(self.blocks["block"]):
                break
            hits = self._search(self._visits(bounded, skip, take), n, k)
            best = hits if found is None else found.unionByName(hits)
            best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
            if take is not None and skip + take < len(self.blocks["block"]):
                found = Staged(best, "found").df.select("query_id", "vec_id", "score", "rank")
                floors = found.filter(F.col("rank") == k).select("query_id", "score", "vec_id")
                bounded = unknown.drop("floored", "score", "vec_id").join(floors, "query_id", "left")
                bounded = bounded.select(
                    "query_id", "v", F.col("score").isNotNull().alias("floored"), F.coalesce("score", F.lit(0)).alias("score"),
                    F.coalesce("vec_id", F.lit(0)).alias("vec_id"),
                )
                found = found.drop("rank")
        return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def _visits(self, bounded: DataFrame, skip: int, take: int | None) -> DataFrame:
        """``bounded`` with a row for each block that may hold a better candidate than the query's floor: of all blocks by promise, those from ``skip`` on, ``take`` at most."""
        pivots, blocks, top, dims = self.pivots, self.blocks, self.top, self.dims

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROUTED_QUERIES):
                    part = batch.slice(at, ROUTED_QUERIES)
                    q = _matrix(part.column(1).to_pylist(), dims).astype(float)
                    points = np.hstack([q, np.zeros((len(q), 1))])
                    base = ((q * q).sum(axis=1) + top)[:, None]
                    to_cell = np.stack([_distance(points, p) for p in pivots], axis=1)[:, blocks["cell"]]
                    low = np.maximum(0.0, np.maximum(to_cell - blocks["high"], blocks["low"] - to_cell) * (1 - MARGIN) - MARGIN * np.sqrt(base))
                    reach = np.floor((base - low * low) / 2 + MARGIN * np.maximum(1.0, base))
                    # by promise: the bound, then the distance to the middle of the ring, so that blocks whose bounds tie come nearest first
                    order = np.lexsort((blocks["block"] + np.zeros_like(low), np.abs(to_cell - (blocks["low"] + blocks["high"]) / 2), -reach), axis=1)
                    chosen = order[:, skip : None if take is None else skip + take]
                    floored, score, vec = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                    open_ = np.take_along_axis(reach, chosen, axis=1)
                    # a floor beyond 2^53 may round up
                    floor = score.astype(float) * (1 - np.sign(score) * 1e-12)
                    least = blocks["least"][chosen]
                    may = ~floored[:, None] | (open_ > floor[:, None]) | ((open_ == floor[:, None]) & (least <= vec[:, None])) | ((open_ >= floor[:, None]) & (np.abs(score) >= EXACT)[:, None])
                    rows, columns = np.nonzero(may)
                    kept = part.take(pa.array(rows))
                    block = pa.array(blocks["block"][chosen[rows, columns]], pa.int64())
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), block, *(kept.column(c) for c in (2, 3, 4))], names=["query_id", "v", "block", "floored", "score", "vec_id"])

        return bounded.mapInArrow(route, "query_id long, v array<long>, block long, floored boolean, score long, vec_id long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """The k best candidates of each query, exactly; both are ``vec_id, v, norm2`` from ``quantised``.

    A query's own id is no candidate; repeated rows count once (same id and vector); of a query id's several vectors the
    smallest counts. Shorter vectors count as ending in zeros. Fewer candidates than k give them all; an empty side gives no
    rows. Scores are exact; those beyond 64 bits count as the largest or smallest long.
    """
    return Index(candidates).top_k(queries, k)
