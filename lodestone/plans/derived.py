"""The service's tables, derived from the test tables by fixed formulas, in Spark and in SQL alike."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.tokens import stem
from lodestone.operators import bm25, substring
from lodestone.sources.staging import exists, new_path

_INDEXES: dict[tuple[str, str], str] = {}  # the path of the index of each session and folder of tables


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        d, r = F.col("doc_id"), F.col("doc_id") % 4
        visibility = F.when(r == 0, "internal_public").when(r == 1, "internal_group").when(r == 2, "internal_private").otherwise("client_private")
        return self.documents.select("*", visibility.alias("visibility"), F.when(r >= 2, d % 10).alias("owner_id"), F.when(r == 1, d % 5).alias("group_id"))

    @cached_property
    def users(self) -> DataFrame:
        u = F.col("c_custkey")
        return self.customer.select(
            u.alias("user_id"), F.when(u % 3 == 0, "client").otherwise("internal").alias("kind"),
            F.when(u == 1, "admin").otherwise("user").alias("role"), F.col("c_name").alias("name"),
        )

    @cached_property
    def memberships(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 5).alias("group_id"))

    @cached_property
    def messages(self) -> DataFrame:
        return self.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", F.col("text").alias("content"))

    @cached_property
    def logs(self) -> DataFrame:
        status = (
            F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done")
            .when(F.col("event_type") == "click", "running")
            .otherwise("pending")
        )
        return self.events.select(
            F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("question"), F.col("value").alias("latency"),
            status.alias("status"), F.col("ts").cast("timestamp").alias("started_at"), "props",
        )

    @cached_property
    def index(self) -> bm25.Index:
        """The stored BM25 index of the documents: built by the first query of a session that needs it, read by all."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        path = _INDEXES.get(key)
        if path is None or not exists(self.spark, f"{path}/stats"):
            path = new_path(self.spark, "bm25")
            index = bm25.Index.build(self.documents.select("doc_id", "text"), path)
            _INDEXES[key] = path
            return index
        return bm25.Index(self.spark, path)

    @cached_property
    def questions(self) -> DataFrame:
        """``qid, question, source_hint``: the hint is the source of the lowest doc_id that has the whole item."""
        items = self.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
        hits = phrase_join(self.index, self.documents.select("doc_id", "text", "source"), items.select("qid", F.col("question").alias("probe")))
        hints = hits.groupBy("qid").agg(F.min_by("source", "doc_id").alias("source_hint"))
        return items.join(hints, "qid", "left").select("qid", "question", "source_hint")


def phrase_join(index: bm25.Index, docs: DataFrame, probes: DataFrame) -> DataFrame:
    """``qid, doc_id, source`` where a document has a probe verbatim.

    A probe's inner words are whole tokens of any text that has it, so its rarest one is looked up in the index, and the
    phrase is tested only on documents with that token. Probes without an inner word are found by their trigrams. The pairs
    to test are stored without their texts: while Spark finds them small they go to the documents, and no text is shuffled.
    """
    inner = F.regexp_extract_all(F.lower("probe"), F.lit("(?<=[^a-zа-яё0-9])[a-zа-яё0-9]{2,}(?=[^a-zа-яё0-9])"), F.lit(0))
    words = probes.select("qid", "probe", F.explode_outer(F.array_distinct(inner)).alias("word")).withColumn("token", stem(F.col("word")))
    weighed = words.join(index.terms, "token", "left").groupBy("qid").agg(
        F.first("probe").alias("probe"), F.count("token").alias("inner"), F.count("df").alias("known"), F.min_by("token", F.struct("df", "token")).alias("token")
    )
    # a token that no document has rules its probe out
    weighed = index.stored(weighed)  # a row for each probe
    keyed = weighed.filter((F.col("inner") > 0) & (F.col("known") == F.col("inner")))
    pairs = index.stored(index.holding(keyed.select("token", "qid")).select("doc_id", "qid"))
    hits = docs.join(pairs, "doc_id").join(keyed.select("qid", "probe"), "qid").filter(F.contains("text", F.col("probe")))
    cols = ["qid", "doc_id", "source"]
    found = hits.select(*cols)
    others = weighed.filter("inner = 0").select("qid", "probe")
    if others.isEmpty():
        return found
    # by trigrams, whatever the case, and then as they are; only probes of one or two characters meet every text
    parts = others.filter(F.length("probe") >= substring.GRAM)
    by_grams = substring.find(docs, parts.withColumnRenamed("probe", "part")).join(parts, "qid").join(docs, "doc_id").filter(F.contains("text", F.col("probe")))
    tiny = docs.join(others.filter(F.length("probe") < substring.GRAM), F.contains("text", F.col("probe")))
    return found.unionByName(by_grams.select(*cols)).unionByName(tiny.select(*cols))


#: The same tables for DuckDB, as common table expressions.
SQL = {
    "docs": """docs AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'internal_public' WHEN 1 THEN 'internal_group' WHEN 2 THEN 'internal_private' ELSE
  'client_private' END AS visibility,
  CASE WHEN doc_id % 4 >= 2 THEN doc_id % 10 END AS owner_id, CASE WHEN doc_id % 4 = 1 THEN doc_id % 5 END AS group_id FROM documents)""",
    "users": "users AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'client' ELSE 'internal' END AS kind, CASE WHEN c_custkey = 1 THEN 'admin' ELSE 'user' END AS role, c_name AS name FROM customer)",
    "memberships": "memberships AS (SELECT c_custkey AS user_id, c_custkey % 5 AS group_id FROM customer)",
    "messages": "messages AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text AS content FROM conversations)",
    "logs": """logs AS (SELECT event_id AS id, user_id, event_type AS question, value AS latency,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' ELSE 'pending' END AS status, ts AS
  started_at, props FROM events)""",
    "questions": """questions AS (SELECT item_id AS qid, any_value(b.text) AS question, arg_min(d.source, d.doc_id) AS source_hint
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)""",
}


def with_tables(names: str, sql: str) -> str:
    """``sql`` behind the derived tables it names; further expressions may follow a leading comma."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + sql
