"""Ranked lists: fusion, deduplication, thresholds and roll-ups, keyed by question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(df: DataFrame, by: str, *order: Column, name: str = "rank") -> DataFrame:
    """With a rank from 1 within ``by``; the order must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return ranked(df, by, *order).filter(F.col("rank") <= k)


def keep_first(df: DataFrame, *keys: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def fuse(lists: list[tuple[DataFrame, float | Column]], by: str, key: str, k: int = RRF_K, digits: int = 6) -> DataFrame:
    """``by, key, score``: weighted reciprocal rank fusion of lists with a ``rank`` from 1.

    A sum over the union does what a full outer join would, in one shuffle. A key that a list has twice counts once, at its
    better rank. The weight may be a column of the list.
    """
    parts = None
    for df, weight in lists:
        w = F.lit(weight) if isinstance(weight, int | float) else weight
        part = df.groupBy(by, key).agg(F.min_by(w / (F.lit(k) + F.col("rank")), F.col("rank")).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(by, key).agg(F.round(F.sum("part"), digits).alias("score"))


def threshold(df: DataFrame, by: str, min_score: float = 0.0, gap_ratio: float = 0.0, score: str = "score") -> DataFrame:
    """Rows of at least ``min_score``, and of these at least ``gap_ratio`` of the question's best, where that is positive."""
    best = F.max(score).over(Window.partitionBy(by))
    return (
        df.filter(F.col(score) >= min_score).withColumn("_best", best)
        .filter((F.col("_best") <= 0) | (F.col(score) >= F.col("_best") * gap_ratio))
        .drop("_best")
    )


def rerank(df: DataFrame, by: str, score: Column, k: int, *ties: Column, min_score: float | None = None, gap_ratio: float = 0.0) -> DataFrame:
    """The k best by a new score; thresholds come after the cut, as scores are compared with the best that is kept."""
    out = top(df.drop("score", "rank").withColumn("score", score), by, k, F.desc("score"), *ties)
    return out if min_score is None else threshold(out, by, min_score, gap_ratio)


def by_source(df: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """``by, source, pages, max_score, n``: sorted distinct pages and the best score of each source; rank 1 is the best source."""
    rolled = (
        df.groupBy(by, "source")
        .agg(
            F.array_sort(F.collect_set("page")).alias("pages"), F.round(F.max("score"), digits).alias("max_score"), F.count("*").alias("n"),
        )
    )
    return ranked(rolled, by, F.desc_nulls_last("max_score"), F.col("source"))


def ordered_unique(value: str, position: str) -> Column:
    """An aggregate: distinct values in the order of their first position."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda x: x[value]))


def cited(answer: Column, sources: Column) -> Column:
    """The sources (an array) that the answer names by [n]; all of them if it names none that exists."""
    named = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    chosen = F.filter(sources, lambda x, i: F.array_contains(named, (i + 1).cast("int")))
    return F.when(F.size(chosen) == 0, sources).otherwise(chosen)


def confidence(df: DataFrame, by: str, score: str = "score") -> DataFrame:
    return df.groupBy(by).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(score))).alias("confidence"))
