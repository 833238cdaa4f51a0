"""Search for any part of a text, whole words or not, by positional trigrams.

A trigram is three code points of a lower-case text, as one exact number. The index has for each trigram and document the
places where it stands, a row for each trigram and segment; a segment is some texts that a task reads together, so texts are
indexed where they are read. A part is looked up by its two rarest trigrams: a document is a candidate if both stand there at the
distance that they have in the part, and candidates are verified on the text. So what is read grows with the rarest trigrams
of what is asked, and no part meets every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.staging import new_path

GRAM = 3
RARE = 2  # trigrams of a part that are looked up
SEGMENT = 1 << 20  # code points of the texts of a segment; the last text may go beyond


def _grams(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams, all places in the order of the trigrams, and where each one's begin."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    places = np.argsort(grams, kind="stable")
    distinct, begins = np.unique(grams[places], return_index=True)
    return distinct, places, begins


def gram_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, gram, at``: the places of each trigram of the text in small letters, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a text at a time
                grams, places, begins = _grams(batch.column(1)[k].as_py())
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(places)).astype(np.int32)), pa.array(places.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(grams), k))), pa.array(grams), lists], names=[key, "gram", "at"])

    schema = T.StructType([texts.schema[key], T.StructField("gram", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType()))])
    return texts.select(key, F.lower(text).alias("text")).mapInArrow(run, schema)


def segment_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``gram, n, found``: for each trigram of a segment its ``n`` documents there, each with the places."""

    def rows_of(keys: pa.Array, texts_: list[tuple]) -> pa.RecordBatch:
        # one after another the documents' distinct trigrams and places; then by trigram, documents stay in their order
        grams = np.concatenate([g for g, _, _ in texts_])
        sizes = np.concatenate([np.diff(np.append(b, len(p))) for _, p, b in texts_])
        places = np.concatenate([p for _, p, _ in texts_]).astype(np.int32)
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        of = np.repeat(np.arange(len(texts_)), [len(g) for g, _, _ in texts_])
        order = np.argsort(grams, kind="stable")
        distinct, firsts = np.unique(grams[order], return_index=True)
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        moved = np.arange(len(places)) - np.repeat(ends[:-1], sizes[order]) + np.repeat(begins[order], sizes[order])
        at = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places[moved]))
        docs = pa.StructArray.from_arrays([keys.take(pa.array(of[order])), at], names=["key", "at"])
        bounds = np.append(firsts, len(grams)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(bounds), docs)
        return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.diff(bounds).astype(np.int64)), found], names=["gram", "n", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, held, size = 0, [], 0
            for k in range(batch.num_rows):  # a text at a time
                held.append(_grams(batch.column(1)[k].as_py()))
                size += len(held[-1][1])
                if size >= SEGMENT or k == batch.num_rows - 1:
                    yield rows_of(batch.column(0).slice(lo, len(held)), held)
                    lo, held, size = k + 1, [], 0

    doc = T.StructType([T.StructField("key", texts.schema[key].dataType), T.StructField("at", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType()), T.StructField("found", T.ArrayType(doc))])
    return texts.select(key, F.lower(text).alias("text")).mapInArrow(run, schema)


def _found(holding: Callable[[DataFrame], DataFrame], counts: DataFrame, parts: DataFrame, key: str, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``qid, part, key``: documents that have the rarest trigrams of a part at their distance; ``holding`` adds ``key, at`` to rows with a trigram."""
    own = gram_rows(parts, "qid", "part").select("qid", "gram", F.element_at("at", 1).alias("offset"))
    known = own.join(counts, "gram", "left")
    whole = known.groupBy("qid").agg(F.bool_and(F.col("df").isNotNull()).alias("whole")).filter("whole").select("qid")  # a trigram that no text has rules its part out
    place = F.row_number().over(Window.partitionBy("qid").orderBy("df", "gram"))
    rare = kept(known.join(whole, "qid").withColumn("place", place).filter(F.col("place") <= RARE))
    hits = holding(rare).select("qid", key, "place", F.transform("at", lambda p: p - F.col("offset")).alias("begins"))
    both = hits.groupBy("qid", key).agg(F.count("*").alias("n"), F.min_by("begins", "place").alias("first"), F.max_by("begins", "place").alias("last"))
    need = rare.groupBy("qid").agg(F.count("*").alias("need"))
    return both.join(need, "qid").filter((F.col("n") == F.col("need")) & F.arrays_overlap("first", "last")).select("qid", key)


def _verified(found: DataFrame, texts: DataFrame, parts: DataFrame, key: str, text: str) -> DataFrame:
    rows = found.join(texts.select(key, text), key).join(parts.select("qid", "part"), "qid")
    return rows.filter(F.contains(F.lower(text), F.lower("part"))).select("qid", key)


def _whole_parts(parts: DataFrame) -> DataFrame:
    short = F.length("part") < GRAM
    checked = F.when(short, F.raise_error(F.lit(f"a part has {GRAM} characters or more")).cast("string")).otherwise(F.col("part"))
    return parts.filter(F.col("part").isNotNull()).select("qid", checked.alias("part"))


def find(texts: DataFrame, parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``qid, key``: the texts that have each of ``parts(qid, part)``, whatever the case, without a stored index: trigrams of no part are dropped at once."""
    parts = _whole_parts(parts)
    asked = gram_rows(parts, "qid", "part").select("gram").distinct()
    postings = gram_rows(texts, key, text).join(asked, "gram", "left_semi")
    return _verified(_found(lambda rare: rare.join(postings, "gram"), postings.groupBy("gram").agg(F.count("*").alias("df")), parts, key), texts, parts, key, text)


class SubstringIndex:
    """Stored trigrams of texts, sorted in each segment: ``grams`` with the documents and places, ``counts`` with their document frequencies."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key
        self.grams, self.counts = spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/counts")

    @classmethod
    def build(cls, texts: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> SubstringIndex:
        """The keys differ. Nothing but the trigrams' document frequencies is sent."""
        segment_rows(texts, key, text).write.option("compression", "zstd").parquet(f"{path}/grams")
        texts.sparkSession.read.parquet(f"{path}/grams").groupBy("gram").agg(F.sum("n").alias("df")).write.parquet(f"{path}/counts")
        return cls(texts.sparkSession, path, key)

    def _candidates(self, parts: DataFrame) -> DataFrame:
        def holding(rare: DataFrame) -> DataFrame:
            docs = self.grams.join(rare, "gram").select(*rare.columns, F.explode("found").alias("d"))
            return docs.select(*rare.columns, F.col("d.key").alias(self.key), "d.at")

        def kept(rare: DataFrame) -> DataFrame:  # written and read back, so Spark knows how few they are
            path = new_path(self.spark, "rare")
            rare.write.parquet(path)
            return self.spark.read.parquet(path)

        return _found(holding, self.counts, parts, self.key, kept)

    def candidates(self, parts: DataFrame) -> DataFrame:
        """``qid, key`` before the texts are looked at."""
        return self._candidates(_whole_parts(parts))

    def search(self, texts: DataFrame, parts: DataFrame, text: str = "text") -> DataFrame:
        """``qid, key``: the texts that have each of ``parts(qid, part)``, whatever the case; parts of fewer than three characters are an error, null ones find nothing."""
        parts = _whole_parts(parts)
        return _verified(self._candidates(parts), texts, parts, self.key, text)
