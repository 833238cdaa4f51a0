"""Exact cosine top-k in blocks, and ports for models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

BLOCK, SIDE = 8192, 16  # rows of a block, while a side has no more blocks than this
ROOM = 1 << 22  # components of a block at most, where SIDE blocks would hold more
ASKED, MET = 256, 4096  # queries and candidates whose scores are there at a time


def _blocks(df: DataFrame, vector: str, block: int) -> int:
    """Each row is sent to all blocks of the other side, so blocks of a large table are larger, as far as a task has room."""
    rows, dims = df.agg(F.count("*"), F.max(F.size(vector))).first()
    largest = max(block, ROOM // max(1, dims or 1))
    return max(1, -(-rows // min(largest, max(block, -(-rows // SIDE)))))


def _dealt(df: DataFrame, key: str, vector: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """``own, other, key, v``: a row for each block of the other side; a null or empty vector is left out."""
    kind = "array<float>" if df.schema[vector].dataType.elementType == FloatType() else "array<double>"  # as narrow as it is
    row = df.filter(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.col(vector).cast(kind).alias("v"))
    return row.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<bigint>")).alias(other), "key", "v")


def _unit(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, vectors = (rows.column(c).combine_chunks() for c in ("key", "v"))
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return keys.to_numpy(zero_copy_only=False), np.divide(v, norm, out=np.zeros_like(v), where=(norm > 0) & (norm < np.inf))


def _nearest(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of ``q``, the places in ``c`` and the scores of each query's k best; ``ci`` is sorted.

    Candidates come in slices, and after the first only those that beat a query's k-th score so far are taken up.
    """
    row, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    own, end = np.searchsorted(ci, qi), np.searchsorted(ci, qi, "right")
    low, step = np.full(len(q), -np.inf), 10.0**-digits
    for at in range(0, len(c), MET):
        scores = q @ c[at : at + MET].T
        width = scores.shape[1]
        for r in np.flatnonzero((own < end) & (own < at + MET) & (end > at)):
            scores[r, max(own[r] - at, 0) : end[r] - at] = -np.inf
        # a score that rounds to more than low is above this; in the first slice, one that rounds to its k-th best or more
        least = low + 0.4 * step if at or width <= k else np.partition(scores, width - k, axis=1)[:, width - k] - step
        r, p = np.divmod(np.flatnonzero(scores > least[:, None]), width)
        found = np.round(scores[r, p], digits) + 0.0
        more = found > low[r]
        row, place, score = np.concatenate((row, r[more])), np.concatenate((place, p[more] + at)), np.concatenate((score, found[more]))
        order = np.lexsort((place, -score, row))
        row, place, score = row[order], place[order], score[order]
        start = np.searchsorted(row, np.arange(len(q) + 1))
        full = np.flatnonzero(np.diff(start) >= k)
        low[full] = score[start[full] + k - 1]
        first = np.arange(len(row)) - start[row] < k
        row, place, score = row[first], place[first], score[first]
    return row, place, score


def cosine_top_k(queries: DataFrame, candidates: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6, block: int = BLOCK) -> DataFrame:
    """``qid, key, score, rank``: the k nearest by cosine, all rows against all queries, a block of one by a block of the other.

    A query is no candidate of its own. Scores are rounded, ties go to the smaller key. Vectors have one length; zero vectors score 0, as do those with a component
    that is null or not finite.
    """
    n, m = _blocks(candidates, vector, block), _blocks(queries, vector, block)
    # blocks meet in a shuffle by both numbers, whatever their sizes: nothing is broadcast, and a task holds two blocks
    asked = _dealt(queries, key, vector, "q_block", m, "c_block", n)
    met = _dealt(candidates, key, vector, "c_block", n, "q_block", m)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            (qi, q), (ci, c) = _unit(left), _unit(right)
            order = np.argsort(ci, kind="stable")  # ties go to the smaller key, which stands first
            ci, c = ci[order], c[order]
            for at in range(0, len(qi), ASKED):
                row, place, score = _nearest(qi[at : at + ASKED], q[at : at + ASKED], ci, c, k, digits)
                rows.append((qi[at : at + ASKED][row], ci[place], score))
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["qid", key, "score"])

    found = asked.groupBy("q_block", "c_block").cogroup(met.groupBy("q_block", "c_block")).applyInArrow(best, f"qid long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of a row, in built-in functions."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def hashed_embedding(dims: int = 64) -> Callable[[Column], Column]:
    """A stand-in for an embedding model: tokens hashed into ``dims`` signed counts, of unit length. Any ``string -> array<float>`` column function can take its place."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import re
        import zlib

        def one(text: str | None) -> np.ndarray:
            v = np.zeros(dims, np.float32)
            for token in re.findall(r"\w{2,}", (text or "").lower()):
                h = zlib.crc32(token.encode())
                v[h % dims] += 1 if h & 0x80000000 else -1
            n = float(np.linalg.norm(v))
            return v / n if n else v

        return texts.map(one)

    return embed


def lexical_rerank(question: Column, text: Column) -> Column:
    """A stand-in for a reranker: the share of the question's distinct words that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w{2,}"), F.lit(0)))
    q = words(question)
    return F.coalesce(F.size(F.array_intersect(q, words(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))
