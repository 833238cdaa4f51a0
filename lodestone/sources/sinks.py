"""Where results go: chunk tables, registries, reports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash
from lodestone.operators.bm25 import postings
from lodestone.sources.staging import exists, remove
from lodestone.sources.versioned import VersionedTable


def write_chunks(chunks: DataFrame, path: str, embed: Column, append: bool = False) -> None:
    """Chunks with hash and vector, parted by who may see them, so that filters on domain and visibility skip folders."""
    out = chunks.withColumn("content_hash", content_hash(F.col("content"))).withColumn("vector", embed)
    out.write.mode("append" if append else "overwrite").partitionBy("doc_domain", "visibility").parquet(path)


def write_postings(texts: DataFrame, path: str, key: str = "doc_id", partitions: int | None = None) -> None:
    """Postings in ranges of tokens, so that a search reads the files and row groups of its own tokens."""
    rows = postings(texts, key)
    (rows.repartitionByRange(partitions, "token") if partitions else rows.repartitionByRange("token")).sortWithinPartitions("token", key).write.mode("overwrite").parquet(path)


def write_registry(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def append_history(summary: DataFrame, path: str) -> None:
    """A JSON line per run; null metrics are left out by the writer."""
    summary.write.mode("append").json(path)


REPORT = ["id", "question", "answer", "expected_answer", "hit_rate", "mrr", "faithfulness", "relevancy", "correctness"]


def write_report(results: DataFrame, path: str) -> None:
    """Results as JSON, and the columns of the report as CSV with a header."""
    results.write.mode("overwrite").json(f"{path}/json")
    results.select(*[c for c in REPORT if c in results.columns]).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


class Collection:
    """Chunks with vectors of one length, by document and hash of the content; parted by domain and visibility so that filters on them skip folders.

    ``table`` is a ``VersionedTable``: each call is one version, the last write of a chunk counts in every column, and a
    crash leaves the version before or the new one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = VersionedTable(spark, f"{path}/chunks", ["document_id", "content_hash"], ["doc_domain", "visibility"])

    def ensure(self, dims: int, reset: bool = False) -> None:
        """Creates the collection; one that is there must have the same length of vectors, unless it is reset."""
        if reset:
            remove(self.spark, self.path)
        known = self.dims()
        if known is None:
            self.spark.createDataFrame([(dims,)], "dims int").write.mode("overwrite").parquet(f"{self.path}/about")
        elif known != dims:
            raise ValueError(f"the collection's vectors have {known} numbers, not {dims}")

    def dims(self) -> int | None:
        return self.spark.read.parquet(f"{self.path}/about").first().dims if exists(self.spark, f"{self.path}/about/_SUCCESS") else None

    def _rows(self, chunks: DataFrame, embed: Column) -> DataFrame:
        size = F.size("vector")
        checked = (
            F.when(size == self.dims(), F.col("vector"))
            .otherwise(F.raise_error(F.lit("a vector has another length than the collection")).cast("array<float>"))
        )
        return chunks.withColumn("content_hash", content_hash(F.coalesce("content", F.lit("")))).withColumn("vector", embed).withColumn("vector", checked)

    def upsert(self, chunks: DataFrame, embed: Column, order: list[str] | None = None) -> None:
        """Puts ``chunks(document_id, content, doc_domain, visibility, ...)`` in the place of those of equal document and content.

        Of such chunks within one call the last by ``order`` counts.
        """
        self.table.upsert(self._rows(chunks, embed), order)

    def replace(self, chunks: DataFrame, embed: Column) -> None:
        """The documents of ``chunks`` have these chunks and no others."""
        rows = self._rows(chunks, embed).dropDuplicates(["document_id", "content_hash"])
        self.table.replace(chunks.select("document_id").distinct(), rows)

    def change(self, documents: DataFrame) -> None:
        """Sets columns, such as who may see it, in all chunks of ``documents(document_id, ...)``; null is a value. No text is embedded again."""
        found = self.table.places(documents.select("document_id"))
        if found is not None:
            names, new = [f for f in self.table.read().columns], [c for c in documents.columns if c != "document_id"]
            rows = found.drop(*new).join(documents, "document_id").select(*names)
            self.table.replace(documents.select("document_id"), rows)

    def read(self) -> DataFrame:
        return self.table.read()

    def document_ids(self) -> DataFrame:
        """All ids of documents, from that column alone."""
        return self.table.read().select("document_id").distinct()

    def delete(self, documents: DataFrame) -> None:
        """Takes the chunks of ``documents(document_id)`` out: their places are written, no file is written again."""
        self.table.delete(documents.select("document_id"))

    def tidy(self) -> None:
        """Merges segments and lets go of what older versions alone need."""
        self.table.compact()
        self.table.vacuum()


QUESTION = ["question", "expected_answer", "source_hint", "dataset", "tags", "notes", "is_active"]


def export_questions(questions: DataFrame, path: str) -> None:
    """The questions' own columns as JSON lines, without ids."""
    questions.select(*[c for c in QUESTION if c in questions.columns]).write.mode("overwrite").json(path)


def import_questions(bank: DataFrame, new: DataFrame, dataset: str = "main", only_if_empty: bool = False) -> DataFrame:
    """``bank`` and those of ``new`` that are not blank, with the next ids in the order of their texts; a missing dataset is ``dataset``.

    ``only_if_empty``: a bank that has questions stays as it is.
    """
    if only_if_empty and not bank.isEmpty():
        return bank
    rows = new.filter(F.length(F.trim("question")) > 0)
    rows = rows.withColumn("dataset", F.coalesce("dataset", F.lit(dataset)) if "dataset" in new.columns else F.lit(dataset))
    last = F.broadcast(bank.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last")))  # one row
    missing = {c: F.lit(None).cast(t) for c, t in bank.dtypes if c not in rows.columns and c != "id"}
    numbered = rows.withColumns(missing).withColumn("_nth", F.row_number().over(Window.orderBy("question")))  # a list that people wrote
    return bank.unionByName(numbered.crossJoin(last).withColumn("id", (F.col("_last") + F.col("_nth")).cast(dict(bank.dtypes)["id"])).select(*bank.columns))


def write_grid(results: DataFrame, path: str) -> None:
    """The settings of a sweep, best first, a JSON object a line."""
    results.orderBy(F.desc("composite"), "config_id").coalesce(1).write.mode("overwrite").json(path)  # a row for each setting


def append_together(parts: dict[str, DataFrame], path: str) -> None:
    """Rows of several kinds in one commit, a folder ``kind=...`` for each: an answer and its log are both there or neither is.

    A kind is read back with its own columns by ``read_kind``.
    """
    packed = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")) for kind, df in parts.items()]
    rows = packed[0]
    for df in packed[1:]:
        rows = rows.unionByName(df)
    rows.write.mode("append").partitionBy("kind").parquet(path)


def read_kind(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    rows = spark.read.schema("row string, kind string").parquet(path).filter(F.col("kind") == kind)
    return rows.select(F.from_json("row", schema).alias("row")).select("row.*")
