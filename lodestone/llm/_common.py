"""Plumbing that the operators share: staged tables in the shared folder, and per-worker caches."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.staging import new_path, remove

WHITE = b" \t\n\x0b\x0c\r"  # [\x20\x09-\x0D], which is also what bytes.split() and bytes.strip() take as white space


class Staged:
    """A written table: ``df`` reads it, ``drop()`` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: its lineage ends there, and a lost executor costs a reread."""
    return Staged(df, name).df


def slices(batches: Iterator, rows: int = 1024) -> Iterator:
    """The batches in smaller ones, so that a kernel holds few rows as Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def tidy(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``kernel`` for mapInArrow, with few rows at a time, giving back their memory when it ends: workers live on, and stages follow each other."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from kernel(slices(batches))
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, over tasks."""
    return sys.__dict__.setdefault("_lodestone_cache", {})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str = "text"):
    """The text as UTF-8 binary, so that kernels get bytes without a second copy; null stays null."""
    return F.encode(F.col(column), "UTF-8")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
