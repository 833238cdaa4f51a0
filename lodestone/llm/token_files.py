"""Token ids in ORC: run-length coded integer stripes, row indexes, and Bloom filters on document ids.

``write_tokens`` deals the documents into ranges of ascending id, encodes each range and writes one ORC file per range.
``read_tokens`` reads them back by stripe, in parallel; a filter on ids skips files and stripes by their statistics and
Bloom filters before any id is decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import shuffle_partitions, tidy
from lodestone.llm.tokenizing import encoder

SCHEMA = "doc_id long, part int, first long, n_tokens int, ids array<int>"
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
CHUNK_ROWS = 1024  # documents whose ids make one batch


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK_ROWS):
                piece = batch.slice(k, CHUNK_ROWS)
                offsets, ids = enc.encode(piece.column(1), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(lists), part, np.int32)), pa.array(first + offsets[:-1]), pa.array(np.diff(offsets), pa.int32()), lists],
                    names=["doc_id", "part", "first", "n_tokens", "ids"],
                )
                first += len(ids)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encodes each whole text (null: empty), appends ``end_id``, and writes the ids to ``path`` in ascending order of id.

    Rows with the same id are separate documents, next to each other in any order; a null id comes first. An empty table gives a
    folder without rows. Other columns, whatever their names, are left out.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    # the ranges come from the ids alone, so that texts are read once; a range's first id may also end the one before
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    bounds = F.lit(sorted(cuts or [])) if cuts else F.array().cast("array<long>")
    low, high = (F.coalesce(F.size(F.filter(bounds, f)), F.lit(0)) for f in (lambda x: x < F.col("doc_id"), lambda x: x <= F.col("doc_id")))
    # rows of one id that fill several ranges are spread over them by their numbers
    part = low + F.pmod(F.xxhash64("nth"), high - low + 1).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("nth"))
    ordered = rows.withColumn("range", part).repartitionById(n, "range").sortWithinPartitions("doc_id", "nth")
    (
        ordered.select("doc_id", "text").mapInArrow(tidy(_encode(tokenizer, end_id)), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(INDEX_ROWS)).option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.compress", "NONE").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: start counts the ids of all documents before. ``ids`` narrows the rows by metadata first.

    A start is the place inside the file, which is stored, plus the totals of the files before; those are one row per file.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    if ids is not None:
        rows = rows.filter(F.col("doc_id").isin(ids))
    # a row of two numbers for each range that was written: their number is a parameter of the write, not of the data
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        flat = lists.values.to_numpy(zero_copy_only=False).view("<u4")
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the ids that were read."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
