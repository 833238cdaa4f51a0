"""Line dedup: key hashes in range partitions, sorted by document and position, streamed into keep bitmaps.

A line's key is hashed to 128 bits. The hashes are range-partitioned together with the document, so a line that fills a
third of the corpus spans many partitions, and sorted by (hash, document, position). One pass over each partition decides
every hash that lies inside it. Of the first and last hash of a partition, which may go on next door, a partition writes
one line of counts, and the few occurrences that it cannot decide alone; these are settled by a join on those counts.
What comes back is a compressed bitmap for each document that loses lines, not its text.

Documents are told apart by doc_id and text: a repeated row counts once and each of its rows gets the same result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._common import WHITE, Staged, shuffle_partitions, text_bytes, tidy

_BATCH_LINES = 100_000
_LINES = "hi long, lo long, doc_id long, row long, pos int"
_FOUND = "kind byte, hi long, lo long, part int, n long, head boolean, doc_id long, row long, pos int"
DROP, OPEN, EDGE = 0, 1, 2


def _explode_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hash_of = xxhash.xxh3_128_digest
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(o[0] for o in out), dtype=">i8").astype("<i8").reshape(-1, 2)
            n = [len(o[3]) for o in out]
            docs = pa.array([o[1] for o in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), n)))
            rows = np.repeat(np.array([o[2] for o in out], np.int64), n)
            pos = np.array([p for o in out for p in o[3]], np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy()), docs, pa.array(rows), pa.array(pos)],
                names=["hi", "lo", "doc_id", "row", "pos"],
            )

        held = 0
        for batch in batches:
            for doc, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys = [line.strip(WHITE).lower() for line in (text or b"").split(b"\n")]
                pos = [k for k, key in enumerate(keys) if key] if min_chars <= 1 else [k for k, key in enumerate(keys) if len(key) >= min_chars and len(key.decode()) >= min_chars]
                if pos:
                    out.append((b"".join([hash_of(keys[k]) for k in pos]), doc, row, pos))
                    held += len(pos)
                if held >= _BATCH_LINES:
                    yield flush()
                    out, held = [], 0
        if held:
            yield flush()

    return run


def _stream(min_docs: int, keep_first: bool):
    """Goes once through a partition that is sorted by hash, document, position; holds the lines of under min_docs documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        found: list[tuple] = []
        key, last_doc, n_docs, first_run, held = None, None, 0, True, []

        def to_batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                names=["kind", "hi", "lo", "part", "n", "head", "doc_id", "row", "pos"],
            )

        def close(edge: bool) -> None:
            """The run of ``key`` ends; at an edge of the partition, other partitions may have more of it."""
            if edge:
                found.append((EDGE, *key, part, n_docs, False, None, None, None))
                found.extend((OPEN, *key, part, 0, h[3], *h[:3]) for h in held)

        for batch in batches:
            for hi, lo, doc, row, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = False
                if (hi, lo) != key:
                    if key is not None:
                        close(first_run)
                        first_run = False
                    key, last_doc, n_docs, held, head = (hi, lo), None, 0, [], True
                if (doc, row) != last_doc:
                    last_doc = (doc, row)
                    n_docs += 1
                    if n_docs == min_docs:  # from here on the run is decided, but for its head at an edge
                        found.extend((DROP, None, None, part, 0, False, *h[:3]) for h in held if not (keep_first and h[3]))
                        held = [h for h in held if keep_first and h[3]]
                if n_docs >= min_docs and not (keep_first and head):
                    found.append((DROP, None, None, part, 0, False, doc, row, pos))
                else:
                    held.append((doc, row, pos, head))
                if len(found) >= _BATCH_LINES:
                    yield to_batch(found)
                    found = []
        if key is not None:
            close(True)
        if found:
            yield to_batch(found)

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """``doc_id, row, pos`` of each line that goes; ``row`` is xxhash64 of the text.

    A line goes if its key (white space stripped, A-Z lower-cased) has ``min_chars`` code points or more and is found in
    ``min_docs`` documents or more; ``keep_first`` spares its first occurrence by doc_id, text hash and position.
    """
    lines = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), text_bytes().alias("text"))
        .mapInArrow(tidy(_explode_lines(min_chars)), _LINES)
    )
    # written first: finding the ranges samples these rows, and would else hash all lines a second time
    hashes = Staged(lines, "line-hashes")
    ordered = (
        hashes.df.repartitionByRange(shuffle_partitions(docs.sparkSession), "hi", "lo", "doc_id", "row")
        .sortWithinPartitions("hi", "lo", "doc_id", "row", "pos")
    )
    found = Staged(ordered.mapInArrow(tidy(_stream(min_docs, keep_first)), _FOUND), "found-lines").df
    hashes.drop()
    # two rows a partition at most
    edges = (
        found.filter(F.col("kind") == EDGE).groupBy("hi", "lo").agg(F.sum("n").alias("total"), F.min("part").alias("from_part"))
        .filter(F.col("total") >= min_docs)
    )
    settled = found.filter(F.col("kind") == OPEN).join(edges, ["hi", "lo"])
    if keep_first:
        settled = settled.filter(~(F.col("head") & (F.col("part") == F.col("from_part"))))
    cols = ["doc_id", "row", "pos"]
    return found.filter(F.col("kind") == DROP).select(*cols).unionByName(settled.select(*cols))


def _bitmap(positions: list[int]) -> bytes:
    keep = np.ones(max(positions) + 8 & ~7, np.uint8)  # whole bytes, so that no padding reads as a dropped line
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def keep_bits(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of ``n_lines`` lines stay; lines after the bitmap's last bit stay, and so do all without a bitmap."""
    keep = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(bits)] = bits
    return keep


def _to_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [_bitmap(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "row", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """``doc_id, row, keep_bitmap`` for each document that loses a line: zlib over packed bits, 1 for a line that stays, up to the last that goes."""
    lists = dropped_lines(docs, min_docs, min_chars, keep_first).groupBy("doc_id", "row").agg(F.collect_list("pos").alias("pos"))
    return lists.mapInArrow(tidy(_to_bitmaps), "doc_id long, row long, keep_bitmap binary")


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, bitmap in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept = lines = (text or b"").split(b"\n")
                if bitmap:
                    kept = [line for line, keep in zip(lines, keep_bits(bitmap, len(lines)).tolist(), strict=True) if keep]
                rest = b"\n".join(kept)
                rows.append((len(lines), len(lines) - len(kept), (None if text is None else rest.decode()) if with_text else hashlib.sha256(rest).hexdigest()))
            out = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(2), *out], names=["doc", "n_lines", "n_dropped", "kept"])

    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc`` (a struct of the columns of ``docs`` but text), ``n_lines, n_dropped`` and ``kept``, the text that stays or its SHA-256.

    A document's bitmap is found by doc_id and the hash of its text; without one all lines stay. A null text stays null,
    and counts as one empty line.
    """
    none = F.lit(-(1 << 63))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    left = docs.select(
        rest.alias("doc"), text_bytes().alias("text"), F.coalesce(F.col("doc_id").cast("long"), none).alias("id"),
        F.xxhash64("text").alias("row"),
    )
    right = bitmaps.select(F.coalesce("doc_id", none).alias("id"), "row", "keep_bitmap")
    joined = left.join(right, ["id", "row"], "left").select("text", "keep_bitmap", "doc")
    schema = T.StructType([joined.schema["doc"], *T._parse_datatype_string("n_lines long, n_dropped long, kept string").fields])
    return joined.mapInArrow(tidy(_apply(with_text)), schema)


def line_digests(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for each row: the digest is of the text that ``keep_bitmaps(docs, **how)`` leaves."""
    docs = docs.select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs, **how), with_text=False).select("doc.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the text that ``keep_bitmaps(docs, **how)`` leaves; all rows and columns stay, n_chars follows the text if there is one."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, **how))
    length = F.coalesce(F.length("kept"), F.lit(0)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("kept").alias("text"), "n_chars": length}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"doc.`{c}`") for c in docs.columns])
