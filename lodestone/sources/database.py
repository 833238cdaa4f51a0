"""Tables of a relational database, read in parts from its replicas."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession


class Database:
    """A primary and its read replicas: reads go to the replicas in turn, or to the primary if there are none; writes go to the primary."""

    def __init__(self, spark: SparkSession, primary: str, replicas: list[str] | None = None, **options: str):
        self.spark, self.primary, self.options = spark, primary, options
        self._turn = itertools.cycle(replicas or [primary])

    def read(self, table: str, key: str | None = None, parts: int = 16) -> DataFrame:
        """A table or a query in brackets with an alias. With a numeric ``key`` it is read in ``parts`` ranges of it, in parallel; filters and columns are pushed into the database."""
        source = {"url": next(self._turn), **self.options}
        reader = self.spark.read.format("jdbc").options(**source).option("dbtable", table)
        if key is not None:
            ends = (
                self.spark.read.format("jdbc").options(**source)
                .option("query", f'SELECT MIN("{key}") AS lo, MAX("{key}") AS hi FROM {table}')
                .load()
                .first()
            )
            if ends[0] is not None:
                reader = reader.options(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(ends[1] + 1), numPartitions=str(parts))
        return reader.load()

    def write(self, rows: DataFrame, table: str, mode: str = "append") -> None:
        rows.write.format("jdbc").options(url=self.primary, dbtable=table, **self.options).mode(mode).save()
