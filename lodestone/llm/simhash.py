"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into 32 segments of 2 bits. The bit counts of its segments are a point in a grid, and the
Manhattan distance of two points is never above the Hamming distance of the fingerprints. If that is at most r, then in
one half of the segments at most h = r // 2 bits differ. So each half is a grid of 16 axes: a fingerprint stands in its own
cell and visits the cells up to h steps away, of every two neighbours one visits the other, a join on the cell brings them
together, the Manhattan distance over all segments drops most pairs, and the exact bit difference decides. For h of 0 or 1
one quarter of the bits, of the two in that half, does not differ at all: its bits are part of the cell's name, and only the
other quarter is a grid, of 8 axes, so cells are smaller. Equal fingerprints are one point, so the size of a group of copies
plays no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Staged, text_bytes, tidy

SEGMENT_BITS = 2


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The SimHash of a UTF-8 text: a bit is set if more than half of its word shingles' XXH64 (seed 42) have it."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(begins[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    return _majority(np.frombuffer(raw, np.uint8).reshape(-1, 8))


def majority_bits(hashes: np.ndarray) -> int:
    """The SimHash of shingles' hashes, repeats included; 0 for none."""
    return _majority(hashes.astype(">u8").view(np.uint8).reshape(-1, 8))


def _majority(rows: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(rows), 65_536):
        counts += np.unpackbits(rows[k : k + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], names=["doc_id", "row", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id, row, fp`` for each row: the hash of its text, and the 64 bits as a signed long. A text without words has 0."""
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"), F.xxhash64("text").alias("row"))
    return rows.mapInArrow(tidy(_fingerprints(shingle)), "doc_id long, row long, fp long")


_PAIRS = 0x5555555555555555  # the lower bit of each segment


def popcounts(fp: Column) -> Column:
    """The bit counts of the 32 segments, each in the two bits where its segment was."""
    low, high = fp.bitwiseAND(F.lit(_PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_PAIRS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """The Manhattan distance of two points from ``popcounts``.

    In unary (0: 00, 1: 01, 2: 11) the distance of two counts is the number of bits in which they differ.
    """
    return F.bit_count(_unary(a).bitwiseXOR(_unary(b)))


def _unary(p: Column) -> Column:
    return p.bitwiseOR(F.shiftrightunsigned(p, 1).bitwiseAND(F.lit(_PAIRS)))


def _bits(x: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1)) if at else x.bitwiseAND(F.lit((1 << width) - 1))


def _moves(axes: int, steps: int) -> list[int]:
    """What to add to a cell for the cells up to ``steps`` unit steps away, itself first; from each pair of opposite moves, one."""
    moves = {0: None}
    for k in range(1, steps + 1):
        for along in itertools.combinations_with_replacement(range(axes), k):
            for signs in itertools.product((1, -1), repeat=k):
                move = sum(s << (2 * a) for a, s in zip(along, signs, strict=True))
                if -move not in moves:
                    moves[move] = None
    return list(moves)


def links(points: DataFrame, radius: int = 3) -> DataFrame:
    """``a, b``: the pairs of different fingerprints in ``points(fp long)``, all distinct, that differ in at most ``radius`` bits.

    A pair may come once for each half and quarter. Cells with many points are split by Spark's skew join.
    """
    steps = radius // 2
    # (exact bits or None, grid): each a bit to begin at; the grid's width follows
    parts = [(32 * half + 16 * q, 32 * half + 16 * (1 - q)) for half in (0, 1) for q in (0, 1)] if steps < 2 else [(None, 0), (None, 32)]
    width = 16 if steps < 2 else 32
    base = points.select("fp", popcounts(F.col("fp")).alias("point"))

    def named(part: int, cell: Column) -> Column:
        """The cell's name in the join: the part, its exact bits, the grid cell."""
        exact = parts[part][0]
        name = cell.bitwiseOR(F.lit(part << 48))
        return name if exact is None else name.bitwiseOR(F.shiftleft(_bits(F.col("fp"), exact, 16), 32))

    cells = [_bits(F.col("point"), grid, width) for _, grid in parts]
    home = base.select(F.col("fp").alias("a"), F.col("point").alias("pa"), F.explode(F.array(*[named(k, c) for k, c in enumerate(cells)])).alias("cell"))
    # a move that leaves the grid would carry into the next axis: a count of 2 cannot grow, and one of 0 cannot shrink
    moves = F.array(*[F.lit(m).cast("long") for m in _moves(width // 2, steps)])

    def reach(k: int, here: Column) -> Column:
        in_grid = lambda to: (to >= 0) & (to < (1 << width)) & (F.bit_count(_unary(here).bitwiseXOR(_unary(to))) <= steps) & (to.bitwiseAND(F.shiftrightunsigned(to, 1)).bitwiseAND(F.lit(_PAIRS)) == 0)
        return F.transform(F.filter(moves, lambda m: in_grid(here + m)), lambda m: F.struct(named(k, here + m).alias("cell"), (m == 0).alias("own")))

    visits = base.select(F.col("fp").alias("b"), F.col("point").alias("pb"), F.explode(F.concat(*[reach(k, c) for k, c in enumerate(cells)])).alias("to"))
    visits = visits.select("b", "pb", F.col("to.cell").alias("cell"), F.col("to.own").alias("own"))
    close = (manhattan(F.col("pa"), F.col("pb")) <= radius) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    ordered = F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(F.lit(True))
    joined = home.hint("merge").join(visits, (home["cell"] == visits["cell"]) & ordered & close)
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of the graph ``edges(a, b)``: root is the smallest node that is reachable; nodes without an edge are left out.

    Alternates large-star and small-star steps (Kiveris et al. 2014) on written tables; each halves long chains, and the
    work is joins and aggregates on node ids, with partial minima first, so a node with very many edges is no bottleneck.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = Staged(edges, "edges0")
    mark = None
    turn = 0
    while True:
        turn += 1
        e = now.df
        # large star: every larger neighbour of u points to the smallest of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = Staged(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large{turn}")
        # small star: every smaller neighbour of u, and u, point to the smallest of them
        e = large.df
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = Staged(small.filter(F.col("u") != F.col("v")).distinct(), f"edges{turn}")
        now.drop()
        large.drop()
        now = after
        seen = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if mark == seen:
            return (
                now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
                .unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            )
        mark = seen


_LAST = (1 << 63) - 1  # in the place of a null doc_id


def _classes(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and ``fp, least``: for each fingerprint the smallest (doc_id, row) of its component."""
    prints = Staged(fingerprints(docs, shingle), "fingerprints").df
    name = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "row")
    points = Staged(prints.groupBy("fp").agg(F.min(name).alias("first")), "points").df
    roots = components(links(points.select("fp"), radius))
    owned = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = owned.groupBy("root").agg(F.min("first").alias("least"))
    return prints, Staged(owned.join(smallest, "root").select("fp", "least"), "classes").df


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row: documents are linked when their fingerprints differ in at most ``radius`` bits.

    fingerprint: 16 hex digits. component_id: the smallest doc_id that links reach, the document's own included; null if
    all of them are null. Rows with the same or a null doc_id are separate documents. Null and empty texts have
    fingerprint 0 and link like any other.
    """
    prints, classes = _classes(docs, shingle, radius)
    component = F.when(F.col("least.id") < _LAST, F.col("least.id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component (null last, ties by the text's hash), one of repeated rows."""
    _, classes = _classes(docs, shingle, radius)
    return pick(docs, classes.select("least.id", "least.row").distinct())


def pick(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``chosen(id, row)``: doc_id, ``_LAST`` for null, and the hash of the text.

    Repeated rows are made one before the shuffle, so a row that fills a third of the table is no single task.
    """
    named = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("row"))
    return named.dropDuplicates(["id", "row"]).join(chosen, ["id", "row"], "left_semi").select("doc.*")
