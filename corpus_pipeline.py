"""A training corpus from ``documents``: rules, line dedup, near-dedup, mixing, packing.

Each stage gets what its predecessor kept, written as Parquet and read again, so a lost executor costs a reread. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, line_dedup, mixing, packing, quality
from lodestone.llm._common import stage

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
LINE_DOCS = 10
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go.

    Null and empty texts have no words and go; a null language is a stratum of its own; a null or repeated doc_id is judged by
    its own text. Without labels the base rules alone decide.
    """
    return quality.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key is in ``LINE_DOCS`` documents or more stay at their first occurrence only; the documents stay, and n_chars follows."""
    return line_dedup.drop_lines(docs, min_docs=LINE_DOCS, min_chars=1, keep_first=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, of repeated rows one.

    SimHash proposes the pairs within its radius of 3 bits; those of similarity 0.8 that differ in more, up to 17, MinHash does.
    Whole shingle sets decide.
    """
    return jaccard.one_of_each(docs, shingle=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, from 0 to 3 times.

    A null source is a source of its own; texts without words weigh nothing and come with their source's whole epochs;
    repeated rows are taken together; null ids have a key by their text.
    """
    return mixing.mixed(docs, mixing.word_count(F.col("text")), mixing.quality_weight(F.col("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most ``SEQUENCE`` tokens; a document that comes twice is packed twice."""
    return packing.pack_documents(docs, TOKENIZER, SEQUENCE, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: XXH64, the tokenizer and best-fit packing are not in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
