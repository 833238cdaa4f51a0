"""Best-fit packing with certified bin counts.

Pieces are dealt into partitions of bounded size. Each partition runs best-fit decreasing and computes a lower bound on
its own bins from dual-feasible functions. Where bins and bound agree, the partition is certified: its bins are final, but
for the emptiest, which ends where the partition does. The others have a gap and keep only their full bins. The pieces of
all other bins go into a common pool, which is dealt anew, so that pieces of different partitions meet. No partition is ever
dealt more than its share. This goes on until the pool's bins meet the bound over all of it, or a turn saves no bin: then
the bins from before that turn stay.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Staged, free_name, tidy
from lodestone.llm.tokenizing import STORE_PIECES, encoder

CHUNK_ROWS = 1024  # documents that are encoded at a time
PART_PIECES = 40_000  # pieces that a partition packs at a time


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each size, and the room left in each bin.

    The open bins stand in one stack per amount of room; a bit mask of the amounts in use finds the tightest fit at once.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for k in order.tolist():
        size = int(sizes[k])
        fits = used >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                used ^= 1 << left
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[k], offsets[k] = b, capacity - left
        room[b] = left = left - size
        stacks[left].append(b)
        used |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def bin_bound(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins of a multiset of sizes; counts[s] is how many have size s.

    The largest of three families of dual-feasible functions: rounding up against a threshold (sizes above capacity - t
    count as whole bins, those below t as nothing), and rounding to multiples of 1/k of a bin, plain and after that.
    """
    s = np.arange(capacity + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    total = int((s * n).sum())
    if total == 0:
        return int(n.sum() > 0)
    best = -(-total // capacity)
    below = np.concatenate([[0], np.cumsum(s * n)])  # below[t]: the sizes under t together
    many = np.concatenate([[0], np.cumsum(n)])
    for t in range(1, capacity // 2 + 1):  # f(x) = 1 if x > 1 - t, x if t <= x <= 1 - t, else 0
        big = int(n.sum() - many[capacity - t + 1])
        mid = int(below[capacity - t + 1] - below[t])
        best = max(best, big + -(-mid // capacity))
    for k in range(1, 100):  # u(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k
        whole = ((k + 1) * s) % capacity == 0
        weight = np.where(whole, s * k, ((k + 1) * s // capacity) * capacity)  # in units of 1 / (capacity * k)
        best = max(best, -(-int((weight * n).sum()) // (capacity * k)))
    return best


def _pack_part(capacity: int, turn: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins, offsets, room = pack_sizes(sizes, capacity)
        bound = bin_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        part, emptiest = int(key[0]), int(np.argmax(room))
        return pd.DataFrame({
            "uid": pdf["uid"], "length": sizes, "part": part, "sequence_id": (turn << 56) | (part << 28) | bins, "offset": offsets,
            "open": room[bins] > 0 if len(room) > bound else bins == emptiest, "head": offsets == 0, "gap": len(room) - bound,
        })

    return run


PLACED = "uid long, length long, part long, sequence_id long, offset long, open boolean, head boolean, gap long"


def place(items: DataFrame, capacity: int, part_pieces: int = PART_PIECES, rounds: int | None = None) -> DataFrame:
    """``uid, sequence_id, offset`` for each row of ``items(uid long, length long)``; uids differ, lengths are 0 to ``capacity``.

    Each turn saves bins, so there are few; ``rounds`` ends them earlier. The shuffles carry 16 bytes a piece. The uid decides the partition, so equal lengths and one hot source spread evenly.
    """
    spark, done = items.sparkSession, []
    n = items.count()
    pool, held, bins_before = items, None, None
    for turn in itertools.count():
        parts = max(1, -(-n // part_pieces))
        dealt = pool.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(parts)))
        placed = Staged(dealt.groupBy("part").applyInPandas(_pack_part(capacity, turn), PLACED), f"packed{turn}").df
        heads = placed.filter("head").groupBy("open").agg(F.countDistinct("sequence_id").alias("n"))
        bins = {r["open"]: r["n"] for r in heads.collect()}  # two rows at most
        if bins_before is not None and sum(bins.values()) >= bins_before:
            done.append(held)
            break
        lengths = placed.filter("open").groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity + 1 rows at most
        counts = np.zeros(capacity + 1, np.int64)
        for r in lengths:
            counts[r["length"]] = r["n"]
        n, bins_before = int(counts.sum()), bins.get(True, 0)
        # a pool in as few bins as its bound is certified, and one partition cannot exchange
        if parts == 1 or turn == rounds or bins_before <= bin_bound(counts, capacity):
            done.append(placed)
            break
        done.append(placed.filter(~F.col("open")))
        held = placed.filter("open")
        pool = held.select("uid", "length")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("uid", "sequence_id", "offset")


def pack(df: DataFrame, capacity: int, length_col: str = "length", **how) -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset``: its rows packed into sequences of at most ``capacity``.

    ``df`` is a written table, or another plan that always gives the same rows in the same partitions. Repeated rows are
    packed each for itself. A null length counts as 0. Longer rows than ``capacity`` raise an error; cut them first.
    """
    uid = free_name(df, "uid")
    rows = Staged(df.withColumn(uid, F.monotonically_increasing_id()), "pieces").df
    length = F.coalesce(F.col(length_col).cast("long"), F.lit(0))
    checked = F.when(length.between(0, capacity), length).otherwise(F.raise_error(F.lit("a length does not fit a sequence")).cast("long"))
    places = place(rows.select(F.col(uid).alias("uid"), checked.alias("length")), capacity, **how)
    return rows.join(places.withColumnRenamed("uid", uid), uid).drop(uid)


def _cut(tokenizer: str, end_id: int, capacity: int, with_ids: bool, store_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, store_pieces)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK_ROWS):
                rows = batch.slice(k, CHUNK_ROWS)
                offsets, ids = enc.encode(rows.column(1), end_id)
                flat, n = ids.astype("<u4"), np.diff(offsets)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                at = offsets[doc] + start
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:  # the pieces lie one behind the other
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat.view("<i4"))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False, store_pieces: int = STORE_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): each text's ids and ``end_id``, cut where longer than ``capacity``.

    A null or empty text is the end id alone. Rows with the same doc_id, or a null one, are separate documents.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_cut(tokenizer, end_id, capacity, with_ids, store_pieces)), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, store_pieces: int = STORE_PIECES) -> DataFrame:
    """The pieces of ``docs`` with their ``sequence_id`` and ``offset``. The result of an empty table is empty."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids, store_pieces), capacity)
