"""Batch answers: many questions through retrieval, fusion, filters and context in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.policy import SPARSE_BOOST, has_exact_reference, question_breadth
from lodestone.functions.text import content_hash
from lodestone.operators import bm25, context, rank

RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 30, 1.5, 0.5
MIN_SCORE, GAP_RATIO = 0.15, 0.1
CONTEXT_TOKENS = 6000


def overlap_list(texts: DataFrame, questions: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``qid, key, score, rank``: a list in the dense one's place, by the share of the question's distinct tokens that a text has."""
    asked = bm25.tokens(questions, "qid", "question").select("qid", "token").distinct()
    size = asked.groupBy("qid").agg(F.count("*").alias("size"))
    found = bm25.tokens(texts, key).join(asked.select("token").distinct(), "token", "left_semi").select(key, "token").distinct()
    scores = (
        found.join(asked, "token").groupBy("qid", key).agg(F.count("*").alias("n"))
        .join(size, "qid")
        .withColumn("score", F.round(F.col("n") / F.col("size"), 6))
    )
    return rank.top(scores.select("qid", key, "score"), "qid", k, F.desc("score"), F.col(key))


def fused_lists(index: bm25.Index, questions: DataFrame, fetch_k: int, weights: tuple[float, Column | float], rrf_k: int = RRF_K, allowed: DataFrame | None = None) -> DataFrame:
    """``qid, doc_id, score``: the index's two lists fused. A row has its places in both, so no union or join is needed."""
    lists = index.lists(questions, fetch_k, allowed)
    boost = questions.select("qid", (weights[1] if isinstance(weights[1], Column) else F.lit(weights[1])).alias("weight"))
    part = lambda w, place: F.coalesce(w / (F.lit(rrf_k) + F.col(place)), F.lit(0.0))
    return lists.join(boost, "qid").select("qid", "doc_id", F.round(part(F.lit(weights[0]), "dense") + part(F.col("weight"), "sparse"), 6).alias("score"))


def sparse_weight() -> Column:
    """The weight of the BM25 list: more for a question with an exact reference."""
    return F.when(has_exact_reference(F.col("question")), SPARSE_WEIGHT * SPARSE_BOOST).otherwise(F.lit(SPARSE_WEIGHT))


def _one_of_equal_texts(fused: DataFrame, hashes: DataFrame) -> DataFrame:
    best = rank.keep_first(fused.join(hashes, "doc_id"), "qid", "hash", order=[F.desc("score"), F.col("doc_id")])
    return rank.ranked(best.select("qid", "doc_id", "score"), "qid", F.desc("score"), F.col("doc_id"))


def hybrid(index: bm25.Index, questions: DataFrame, fetch_k: int = 25, dense: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """``qid, doc_id, score, rank``: two lists fused from a stored index; ``allowed(doc_id)`` is what the user may see.

    ``dense(qid, doc_id, rank)`` is a list from vectors; without one the share of the question's tokens takes its place.
    Equal texts count once, at the better place. The candidates are stored, at most two lists of ``fetch_k`` a question: while
    Spark finds them small they go to the documents, and no document is shuffled to meet them.
    """
    if dense is None:
        fused = fused_lists(index, questions, fetch_k, (DENSE_WEIGHT, sparse_weight()), allowed=allowed)
    else:
        sparse = index.search(questions, fetch_k, allowed).join(questions.select("qid", sparse_weight().alias("weight")), "qid")
        seen = dense if allowed is None else dense.join(allowed, "doc_id", "left_semi")
        fused = rank.fuse([(seen, DENSE_WEIGHT), (sparse, F.col("weight"))], "qid", "doc_id", RRF_K)
    return index.stored(_one_of_equal_texts(index.stored(fused), index.docs))


def answer_context(index: bm25.Index, texts: DataFrame, questions: DataFrame, top_k: int = 4, tokens: int = CONTEXT_TOKENS) -> DataFrame:
    """``qid, breadth, context, n_parts, max_score``: candidates, rerank by BM25 share, thresholds, and the context under its budget.

    ``texts`` is what the user may see of the indexed documents.
    """
    candidates = hybrid(index, questions, allowed=texts.select("doc_id"))
    best = rank.threshold(candidates.filter(F.col("rank") <= top_k), "qid", 0.0, GAP_RATIO)
    null = F.lit(None)
    rows = best.join(texts.select("doc_id", "text", "source"), "doc_id")
    head = context.header(F.col("rank"), F.col("source"), null, null, null, null.cast("string"), null.cast("string"), null.cast("string"))
    rows = rows.withColumn("part", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))))
    kept = context.within_budget(rows, "qid", F.length("part"), tokens * context.CHARS_PER_TOKEN)
    scores = kept.groupBy("qid").agg(F.max("score").alias("max_score"))
    out = context.joined(kept, "qid", "part").join(scores, "qid")
    return (
        questions.select("qid", question_breadth(F.col("question")).alias("breadth"))
        .join(out, "qid", "left")
        .withColumn("n_parts", F.coalesce("n_parts", F.lit(0)))
    )
