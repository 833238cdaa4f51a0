"""Two tables compared by digests of ranges: only ranges of hashed keys whose digests differ are read, shuffled and joined.

A leaf is a range of key hashes of about ``LEAF_KEYS`` keys; its digest counts and adds up the hashes of its rows, so it
does not depend on their order and follows additions and removals without a reread. The levels above add up ``FAN`` bits at
a time. A comparison goes from the top level down, and at each level only into nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.staging import new_path, read_text, write_text_once

LEAF_KEYS = 16
FAN = 6  # bits from one level to the next
BROADCAST_LEAVES = 500_000  # as many leaf numbers, 8 bytes each, go to every task; more are joined by a shuffle
PARTS = ["n", "low", "high", "mixed"]


def bits_for(rows: int) -> int:
    """Bits of the leaf numbers of a table of so many rows."""
    return max(1, min(56, (max(1, rows) // LEAF_KEYS).bit_length()))


def leaf_of(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - bits)


def _row_hash(columns: list[str]) -> Column:
    """A null is no empty value and takes its place, as ``xxhash64`` alone would leave it out."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def _added_up(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("mixed").alias("mixed"))


def leaves(df: DataFrame, key: str, columns: list[str], bits: int, sign: int = 1) -> DataFrame:
    """``node, n, low, high, mixed`` for each leaf that has rows; ``sign`` -1 for rows that are taken away. Rows without a key have no place."""
    h = F.col("_h")
    rows = df.filter(F.col(key).isNotNull()).select(leaf_of(key, bits).alias("node"), _row_hash([key, *columns]).alias("_h"))
    halves = ((h.bitwiseAND(0xFFFFFFFF)) * sign).alias("low"), (F.shiftrightunsigned(h, 32) * sign).alias("high")
    return _added_up(rows.select("node", F.lit(sign).cast("long").alias("n"), *halves, h.alias("mixed")), "node")


class DigestTree:
    """The levels of a table's digests at ``path``, one folder each, sorted by node; ``bits`` are those of the leaves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.bits = spark, path, int(read_text(spark, f"{path}/bits"))

    @staticmethod
    def _levels(bits: int) -> list[int]:
        return [*range(bits % FAN or FAN, bits, FAN), bits]

    @classmethod
    def _write(cls, spark: SparkSession, bottom: DataFrame, path: str, bits: int) -> DigestTree:
        below = None
        for level in reversed(cls._levels(bits)):
            nodes = bottom if below is None else _added_up(below[1].withColumn("node", F.shiftright("node", below[0] - level)), "node")
            nodes.filter("n <> 0 OR low <> 0 OR high <> 0 OR mixed <> 0").repartitionByRange("node").sortWithinPartitions("node").write.parquet(f"{path}/level={level}")
            below = level, spark.read.parquet(f"{path}/level={level}")
        write_text_once(spark, f"{path}/bits", str(bits))
        return cls(spark, path)

    @classmethod
    def build(cls, df: DataFrame, key: str, columns: list[str], path: str, bits: int | None = None) -> DigestTree:
        bits = bits or bits_for(df.count())
        return cls._write(df.sparkSession, leaves(df, key, columns, bits), path, bits)

    def nodes(self, level: int) -> DataFrame:
        """``node, n, low, high, mixed``; a level that is not stored is added up from the next one below."""
        stored = min(x for x in self._levels(self.bits) if x >= level)
        df = self.spark.read.parquet(f"{self.path}/level={stored}")
        return df if stored == level else _added_up(df.withColumn("node", F.shiftright("node", stored - level)), "node")

    def changed(self, path: str, key: str, columns: list[str], added: DataFrame | None = None, removed: DataFrame | None = None) -> DigestTree:
        """The tree of the table with rows added and removed, from this tree and these rows alone."""
        rows = self.nodes(self.bits)
        for df, sign in ((added, 1), (removed, -1)):
            if df is not None:
                rows = rows.unionByName(leaves(df, key, columns, self.bits, sign))
        return self._write(self.spark, _added_up(rows, "node"), path, self.bits)

    def differing(self, other: DigestTree) -> tuple[int, DataFrame]:
        """The bits and the numbers (``node``) of the leaves in which the two differ, from the top level down."""
        bits, found, above = min(self.bits, other.bits), None, 0
        for level in self._levels(bits):
            left, right = self.nodes(level), other.nodes(level)
            if found is not None:
                parent = F.shiftright("node", level - above)
                left, right = (_within(x.withColumn("_parent", parent), found.withColumnRenamed("node", "_parent"), "_parent").drop("_parent") for x in (left, right))
            both = left.select("node", F.struct(*PARTS).alias("l")).join(right.select("node", F.struct(*PARTS).alias("r")), "node", "full_outer")
            path = new_path(self.spark, "differing")
            both.filter(~F.col("l").eqNullSafe(F.col("r"))).select("node").write.parquet(path)
            found, above = self.spark.read.parquet(path), level
        return bits, found


def _within(df: DataFrame, few: DataFrame, by: str) -> DataFrame:
    """The rows of ``df`` with a value in the stored table ``few``, without a shuffle of ``df`` unless that is large."""
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_LEAVES else few, by, "left_semi")


def candidates(df: DataFrame, key: str, bits: int, differing: DataFrame) -> DataFrame:
    """The rows of ``df`` in leaves that differ."""
    return _within(df.filter(F.col(key).isNotNull()).withColumn("_leaf", leaf_of(key, bits)), differing.select(F.col("node").alias("_leaf")), "_leaf").drop("_leaf")


def reconcile(left: DataFrame, right: DataFrame, key: str, columns: list[str] | None = None, trees: tuple[DigestTree, DigestTree] | None = None) -> DataFrame:
    """``key, difference``: ``left`` or ``right`` for keys that this side does not have, ``changed`` where ``columns`` differ.

    Keys have the same type on both sides. ``trees`` are stored digests of both tables over the same columns; without them
    they are built in one pass over each. A null is a value of a column; rows with a null key have no place on any side. A
    key in several rows is changed if the sets of its rows differ; repeated equal rows count once.
    """
    columns, spark = columns or [], left.sparkSession
    if trees is None:
        bits = bits_for(max(left.count(), right.count()))
        trees = tuple(DigestTree.build(df, key, columns, new_path(spark, f"digests-{side}"), bits) for side, df in (("left", left), ("right", right)))
    bits, found = trees[0].differing(trees[1])

    def rows(df: DataFrame, name: str) -> DataFrame:
        few = candidates(df.select(key, *columns), key, bits, found)
        return few.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias(name)) if columns else few.distinct().withColumn(name, F.lit(True))

    both = rows(left, "_l").join(rows(right, "_r"), key, "full_outer")
    how = F.when(F.col("_l").isNull(), "left").when(F.col("_r").isNull(), "right").when(F.col("_l") != F.col("_r"), "changed")
    return both.select(key, how.alias("difference")).filter("difference IS NOT NULL")
