"""Product codes of vectors: each of several equal parts of a vector becomes the number of the nearest entry of its codebook.

The nearest entry is found by slices and masks. For each coordinate the entries stand in order, and the prefix masks say, as
bits of uint64 words, which entries are among the first k. A first radius is the distance to the entry that is nearest in the
coordinate where entries are spread most; the nearest entry lies in the box of that radius, so in each coordinate a range of
the order, whose entries are the exclusive or of two prefix masks. The masks of all coordinates ANDed are the candidates, and
only their distances are computed. All arithmetic is on integers, so results do not depend on order or partitioning.

Training and coding are passes over one written table. A pass gives sums for each part and entry from each task, so what is
shuffled and sent to the driver does not grow with the vectors; the codebooks travel inside the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Staged, tidy

LARGEST = 1 << 28  # of a component as an integer: beyond, the error of a vector of 64 would not fit a long
FEW_LABELS = 65_536  # sums by label are broadcast up to this many


class Codebook:
    """The entries of one part, with the order and the prefix masks of each coordinate."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        count, dims = entries.shape
        self.words = -(-count // 64)
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [np.ascontiguousarray(entries[self.order[:, d], d]) for d in range(dims)]
        bits = np.zeros((count, self.words), np.uint64)
        bits[np.arange(count), np.arange(count) // 64] = np.uint64(1) << (np.arange(count, dtype=np.uint64) % np.uint64(64))
        nothing = np.zeros((1, self.words), np.uint64)
        self.prefix = [np.concatenate([nothing, np.bitwise_or.accumulate(bits[self.order[:, d]], axis=0)]) for d in range(dims)]
        self.widest = int(np.argmax(np.ptp(entries, axis=0)))

    def _first(self, x: np.ndarray) -> np.ndarray:
        """The entry that is nearest in the widest coordinate."""
        line, along = self.sorted[self.widest], x[:, self.widest]
        right = np.clip(np.searchsorted(line, along), 1, max(1, len(line) - 1))
        right = np.minimum(right, len(line) - 1)
        left = np.maximum(right - 1, 0)
        return self.order[np.where(along - line[left] <= line[right] - along, left, right), self.widest]

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The masks of the entries within ``radius`` of each row in every coordinate."""
        found = np.full((len(x), self.words), ~np.uint64(0))
        for d, line in enumerate(self.sorted):
            low, high = np.searchsorted(line, x[:, d] - radius, "left"), np.searchsorted(line, x[:, d] + radius, "right")
            found &= self.prefix[d][high] ^ self.prefix[d][low]
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row (ties to the lower number), its squared distance, and how many distances were computed."""
        best = self._first(x)
        least = ((x - self.entries[best]) ** 2).sum(axis=1)
        masks = self.candidates(x, np.sqrt(least.astype(np.float64)).astype(np.int64) + 1)
        computed = len(x)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            away = ((x[rows] - entry) ** 2).sum(axis=1)
            closer = (away < least[rows]) | ((away == least[rows]) & (e < best[rows]))
            best[rows[closer]], least[rows[closer]] = e, away[closer]
            computed += len(rows)
        return best, least, computed


def _whole(batch: pa.RecordBatch, scale: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows whose vectors take part, and their components as integers."""
    vectors = batch.column("vector")
    starts, ends = vectors.offsets.to_numpy()[:-1], vectors.offsets.to_numpy()[1:]
    rows = np.flatnonzero((ends - starts == dims) & vectors.is_valid().to_numpy(zero_copy_only=False))
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null is not a number
    values = np.floor(scale * flat[starts[rows][:, None] + np.arange(dims)])
    good = (np.abs(values) <= LARGEST).all(axis=1)
    return rows[good], values[good].astype(np.int32)


def _pack(scale: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = _whole(batch, scale, dims)
            kept = pa.array(rows)
            packed = pa.array([v.tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(kept), batch.column("label").take(kept), packed], names=["id", "label", "parts"])

    return run


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """rows x parts x components."""
    flat = np.frombuffer(b"".join(batch.column("parts").to_pylist()), np.int32).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def _sums(books: list[np.ndarray]):
    """``slot, value``: for each part and entry the count and the sums of components of what is nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed = [Codebook(b) for b in books]
        entries, width = books[0].shape
        total = np.zeros((len(books), entries, width + 1), np.int64)
        for batch in batches:
            x = _parts(batch, len(books))
            for p, book in enumerate(indexed):
                nearest = book.nearest(x[:, p])[0]
                total[p, :, 0] += np.bincount(nearest, minlength=entries)
                np.add.at(total[p, :, 1:], nearest, x[:, p])
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total.ravel()[slots])], names=["slot", "value"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed = [Codebook(b) for b in books]
        for batch in batches:
            x = _parts(batch, len(books))
            found = [book.nearest(x[:, p]) for p, book in enumerate(indexed)]
            numbers = np.stack([f[0] for f in found], axis=1).tolist()
            codes = pa.array(["".join(f"{n:02x}" for n in row) for row in numbers], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), codes, pa.array(sum(f[1] for f in found))], names=["id", "label", "code", "error"]
            )

    return run


def _start(vectors: DataFrame, entries: int, parts: int, scale: int) -> np.ndarray | None:
    """The vectors of the smallest ids, entries x components; at most ``entries`` rows come to the driver."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale <= LARGEST))
    whole = vectors.filter(F.col("id").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0) & finite)
    first = whole.agg(F.min_by(F.size("vector"), F.struct("id", F.size("vector"))).alias("dims")).first()
    if first is None or first.dims is None:
        return None
    same = whole.filter(F.size("vector") == first.dims)
    ids = [r.id for r in same.select("id").distinct().orderBy("id").limit(entries).collect()]
    # of repeated ids the vector that is least by its components
    rows = same.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    return np.floor(scale * np.array([list(r["vector"]) for r in rows], np.float64)).astype(np.int64)


def train(packed: DataFrame, start: np.ndarray, parts: int = 8, rounds: int = 6) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds: entries x components for each part."""
    entries, dims = start.shape
    books = [np.ascontiguousarray(x) for x in start.reshape(entries, parts, dims // parts).transpose(1, 0, 2)]
    for _ in range(rounds):
        sums = packed.select("parts").mapInArrow(tidy(_sums(books)), "slot int, value long").groupBy("slot").agg(F.sum("value").alias("value"))
        total = np.zeros(parts * entries * (dims // parts + 1), np.int64)
        for r in sums.collect():  # a row for each number of the codebooks at most
            total[r.slot] = r.value
        for book, both in zip(books, total.reshape(parts, entries, -1), strict=True):
            used = both[:, 0] > 0
            book[used] = both[used, 1:] // both[used, :1]
    return books


def compress(vectors: DataFrame, key: str, vector: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """``key, label, code, error`` for each vector that takes part, and the codebooks.

    code has two hex digits a part; error is the squared distance to the coded vector, in units of 1 / ``scale``. Vectors that
    are null or empty, hold null or non-finite components or ones beyond 2**28 / ``scale``, cannot be cut into ``parts``, or
    have another length than that of the smallest key take no part. Rows of one key are coded each; null keys are coded but start no entry. With fewer than ``entries`` keys
    the codebooks have that many entries; without any the result is empty.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    types = dict(rows.dtypes)
    schema = f"id {types['id']}, label {types['label']}"
    start = _start(rows, entries, parts, scale)
    if start is None:
        none = rows.filter("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumnsRenamed({"id": key, "label": label}), []
    packed = Staged(rows.mapInArrow(tidy(_pack(scale, start.shape[1])), f"{schema}, parts binary"), "vector-parts")
    books = train(packed.df, start, parts, rounds)
    codes = Staged(packed.df.mapInArrow(tidy(_codes(books)), f"{schema}, code string, error long"), "vector-codes").df
    packed.drop()
    return codes.withColumnsRenamed({"id": key, "label": label}), books


def digest(books: list[np.ndarray]) -> str:
    """The SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(codes: DataFrame, label: str) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over equal labels, nulls together."""
    sums = Staged(codes.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors").df
    # more labels than that meet in a join, where Spark splits the rows of a frequent one
    sums = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums.hint("merge")
    return codes.join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
