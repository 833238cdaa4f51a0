"""A stored index for exact cosine search: cells of vectors with radii, in folders that access filters skip.

Vectors are dealt to the nearest of a bounded number of centres. For each folder (the values of ``parted_by``) and cell the
index knows how many vectors it has and its radius, the largest angle between one of them and the centre. The cosine of a
query and any vector there is at most that of its angle to the centre less the radius. A search visits the cells of highest
bound first, takes the k-th score found there as a threshold, and then only the cells whose bound reaches it; what is found
is what comparing everything finds. Rows are a ``VersionedTable``: additions, replacements and removals need no rebuild, and
radii only grow until the index is built anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.staging import exists
from lodestone.sources.versioned import VersionedTable

CELLS = 256
SAMPLE = 8192  # rows on which the centres are fitted, those of the smallest hashes of the key; every row is indexed
BLOCK = 4096  # vectors of a cell, or queries, that meet in one task at a time
FIRST = 2  # cells that a query visits for its threshold
SLACK = 1e-6  # more than rounding to six digits, and floating point, can move a score


def _units(lists: pa.ListArray) -> np.ndarray:
    """Rows of unit length; a zero vector stays zero."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)


def fit_centres(v: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors; the first centres are spread over the sample."""
    centres = v[np.unique(np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int))]
    for _ in range(rounds):
        near = np.argmax(v @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


class VectorIndex:
    """``key, vector`` and the columns of ``parted_by`` are stored, with ``more`` columns that filters on rows need."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding", parted_by: tuple[str, ...] = (), more: tuple[str, ...] = ()):
        self.spark, self.path, self.key, self.vector, self.parted_by, self.more = spark, path, key, vector, list(parted_by), list(more)
        self.table = VersionedTable(spark, f"{path}/rows", [key], [*self.parted_by, "cell"], least_buckets=1)
        known = spark.read.parquet(f"{path}/centres").orderBy("cell").collect() if exists(spark, f"{path}/centres/_SUCCESS") else []  # at most ``CELLS``
        self.centres = np.array([r.centre for r in known]) if known else None

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int = CELLS, **columns) -> VectorIndex:
        """An index of ``vectors``; null keys and null or empty vectors are left out, the others have one length."""
        spark = vectors.sparkSession
        index = cls(spark, path, **columns)
        some = index._whole(vectors).orderBy(F.xxhash64(index.key), index.key).limit(SAMPLE).select(index.vector)
        sample = _units(some.toArrow().column(0).combine_chunks()) if not some.isEmpty() else np.zeros((0, 0))
        centres = fit_centres(sample, cells).tolist() if len(sample) else []
        spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").write.parquet(f"{path}/centres")
        index = cls(spark, path, **columns)
        if centres:
            index.add(vectors)
        return index

    def _whole(self, vectors: DataFrame) -> DataFrame:
        return vectors.filter(F.col(self.key).isNotNull() & (F.size(self.vector) > 0)).select(self.key, self.vector, *self.parted_by, *self.more)

    def add(self, vectors: DataFrame) -> None:
        """Puts vectors in the place of those with their keys."""
        rows = self._whole(vectors)
        centres = self.centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _units(batch.column(1)) @ centres.T
                cell = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
        placed = rows.mapInArrow(assign, schema)
        name, before = uuid.uuid4().hex, self.table.manifest()["side"]
        placed.groupBy(*self.parted_by, "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).write.parquet(f"{self.table.path}/side/{name}")
        last = placed.drop("angle").groupBy(self.key).agg(F.max_by(F.struct(*[c for c in placed.columns if c not in (self.key, "angle")]), F.col(self.vector)).alias("_r")).select(self.key, "_r.*")
        self.table.replace(last.select(self.key), last.select(*[c for c in placed.columns if c != "angle"]), side=[*before, name])

    def remove(self, keys: DataFrame) -> None:
        self.table.delete(keys.select(self.key))

    def cells(self) -> DataFrame:
        """``parted_by, cell, radius, n``: a row for each cell of each folder; n counts what was ever put there."""
        paths = [f"{self.table.path}/side/{x}" for x in self.table.manifest()["side"]]
        return self.spark.read.parquet(*paths).groupBy(*self.parted_by, "cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))

    def search(self, queries: DataFrame, k: int, folders: Column | None = None, rows: Column | None = None, digits: int = 6) -> DataFrame:
        """``qid, key, score, rank``: the k nearest of each query among the vectors that both filters let through, but for the query's own key.

        ``folders`` is a filter on the columns of ``parted_by``, which are not read where it fails; ``rows`` one on any column.
        """
        found, _ = self._search(queries, k, folders, rows, digits)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), self.key))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def visits(self, queries: DataFrame, k: int, folders: Column | None = None, rows: Column | None = None) -> DataFrame:
        """One row: ``cells`` that the queries could visit, each counted for each query, and ``visited``."""
        _, pairs = self._search(queries, k, folders, rows, 6)
        every = self.cells().filter(folders if folders is not None else F.lit(True)).count() * self._whole_queries(queries).count()
        return pairs.agg(F.lit(every).alias("cells"), F.count("*").alias("visited"))

    def _whole_queries(self, queries: DataFrame) -> DataFrame:
        return queries.filter(F.col(self.key).isNotNull() & (F.size(self.vector) > 0)).select(F.col(self.key).alias("qid"), F.col(self.vector).cast("array<double>").alias("q"))

    def _search(self, queries: DataFrame, k: int, folders: Column | None, rows: Column | None, digits: int) -> tuple[DataFrame, DataFrame]:
        asked = self._whole_queries(queries)
        qid = asked.schema["qid"].dataType.simpleString()
        if self.centres is None or not self.table.manifest()["segments"]:
            none = self.spark.createDataFrame([], f"qid {qid}, {self.key} {qid}, score double")
            return none, none.select("qid")
        known = self.cells().filter(folders if folders is not None else F.lit(True)).orderBy(*self.parted_by, "cell").collect()  # at most ``CELLS`` a folder
        meta = [(i, *[r[c] for c in self.parted_by], r.cell, max(1, -(-r.n // BLOCK))) for i, r in enumerate(known)]
        types = {f.name: f.dataType.simpleString() for f in self.table.read().schema}
        names = "slot int" + "".join(f", {c} {types[c]}" for c in self.parted_by) + ", cell int, parts int"
        slots = F.broadcast(self.spark.createDataFrame(meta, names))
        live = self.table.read()
        live = live if folders is None else live.filter(folders)
        live = live if rows is None else live.filter(rows)
        same = live["cell"] == slots["cell"]
        for c in self.parted_by:
            same &= live[c].eqNullSafe(slots[c])
        placed = live.join(slots, same).select("slot", F.pmod(F.xxhash64(self.key), F.col("parts")).alias("part"), F.col(self.key).alias("key"), F.col(self.vector).cast("array<double>").alias("v"))
        centres = self.centres[[r.cell for r in known]] if known else np.zeros((0, self.centres.shape[1]))
        radii, parts = np.array([r.radius for r in known]), np.array([m[-1] for m in meta], np.int64)

        def bounds(batch: pa.RecordBatch) -> np.ndarray:
            angle = np.arccos(np.clip(_units(batch.column("q")) @ centres.T, -1, 1))
            return np.cos(np.maximum(0.0, angle - radii)) + SLACK

        def visits(first: bool):
            """``qid, q, slot, parts, theta``: the first cells of each query, or the others that may reach its threshold."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    bound = bounds(batch)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    early = np.zeros(bound.shape, bool)
                    np.put_along_axis(early, order[:, :FIRST], True, axis=1)
                    theta = np.full(len(bound), -2.0) if first else batch.column("theta").to_numpy()
                    row, slot = np.nonzero(early if first else ~early & (bound >= theta[:, None]))
                    kept = batch.select(["qid", "q"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(slot.astype(np.int32)), pa.array(parts[slot])], names=["qid", "q", "slot", "parts"])

            return run

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, own = right.column("qid").to_pylist(), left.column("key").to_pylist()
            out: list[tuple] = []
            if ids and own:
                v, keys = _units(left.column("v").combine_chunks()), np.array(own)
                for a in range(0, len(ids), 256):
                    scores = _units(right.column("q").slice(a, 256).combine_chunks()) @ v.T
                    for q, line in zip(ids[a : a + 256], scores, strict=True):
                        line = np.where(keys == q, -np.inf, line)
                        # those that rounding may bring to the k-th place stay
                        least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
                        out += [(q, own[j], float(line[j])) for j in np.flatnonzero((line >= least - SLACK) & (line > -np.inf)).tolist()]
            kinds = [right.schema.field("qid").type, left.schema.field("key").type, pa.float64()]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], names=["qid", "key", "score"])

        pair = f"qid {qid}, q array<double>, slot int, parts bigint"

        def scored(pairs: DataFrame) -> DataFrame:
            to = pairs.withColumn("in_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
            right = to.select(F.col("slot").alias("in_slot"), "in_part", "qid", "q")
            found = placed.groupBy("slot", "part").cogroup(right.groupBy("in_slot", "in_part")).applyInArrow(best, f"qid {qid}, key {types[self.key]}, score double")
            return found.select("qid", F.col("key").alias(self.key), F.round("score", digits).alias("score"))

        early = asked.mapInArrow(visits(True), pair)
        first = scored(early)
        kth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), self.key))
        theta = first.withColumn("place", kth).filter(F.col("place") == k).select(F.col("qid").alias("of"), F.col("score").alias("theta"))
        limited = asked.join(theta, F.col("qid") == F.col("of"), "left").select("qid", "q", F.coalesce("theta", F.lit(-2.0)).alias("theta"))
        late = limited.mapInArrow(visits(False), pair)
        return first.unionByName(scored(late)), early.select("qid").unionByName(late.select("qid"))
