"""Quantiles and distinct counts by window, as sketches that are stored as columns and merged upward.

Hours have a KLL sketch of a value and an HLL sketch of who caused it; days, weeks or all time are merged from them, so no
raw row is read again and a late hour changes its day alone. Errors do not grow with merging: a quantile's rank is off by
at most ``RANK_ERROR`` and a distinct count by ``DISTINCT_ERROR`` (three standard deviations), for any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_K = 400
HLL_LG_K = 12
RANK_ERROR = 0.01  # of KLL_K, with a confidence of 99 %
DISTINCT_ERROR = 3 * 1.04 / 2 ** (HLL_LG_K / 2)
_SKETCHED = ("n", "total", "values", "who")


def windows(events: DataFrame, by: list[str], value: str, who: str, ts: str, unit: str = "hour") -> DataFrame:
    """``by, start, n, total, values, who`` for each window of ``unit``; null values and people are counted in n alone."""
    return events.groupBy(*by, F.date_trunc(unit, F.col(ts)).alias("start")).agg(
        F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("values"), F.hll_sketch_agg(F.col(who), HLL_LG_K).alias("who"),
    )


def merged(rows: DataFrame, by: list[str], unit: str | None = None) -> DataFrame:
    """The windows of ``rows`` merged into those of ``unit`` (all time without one) and of ``by``, some of their columns or none."""
    start = [] if unit is None else [F.date_trunc(unit, F.col("start")).alias("start")]
    return rows.groupBy(*by, *start).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("values", F.lit(KLL_K)).alias("values"), F.hll_union_agg("who").alias("who")
    )


def quantile(share: float, sketch: str = "values") -> Column:
    """The value of that rank; null for a window without values."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(sketch)), F.lit(float(share))))


def read(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Windows with a column for each of ``shares``, the mean and the number of distinct people, without their sketches."""
    rest = [c for c in rows.columns if c not in _SKETCHED]
    named = [quantile(p).alias(name) for name, p in shares.items()]
    return rows.select(*rest, "n", (F.col("total") / F.kll_sketch_get_n_double("values")).alias("mean"), *named, F.hll_sketch_estimate("who").alias("distinct"))
