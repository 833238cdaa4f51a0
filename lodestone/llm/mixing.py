"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document has an exponential key -ln(u) / w, with u from a hash of its id and w its quality weight; ascending keys are
a weighted sample without replacement. A source takes as many complete epochs as its target holds, and then documents by
ascending key until their sizes reach what is left. The running sum goes over buckets of keys first: only the bucket in
which the budget ends is sorted by row, so a source with a third of all documents is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import Staged

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
CAP = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for text without mark-up symbols, less the more of its characters are such; 1 for an empty text."""
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>!]+", ""))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(8.0) * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def sample_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / w: u in (0, 1) from 52 bits of the MD5 of seed and name, so that reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"))), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / weight


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from ``sized(source, size)``: one row per source, a null source last.

    Sources in code point order take ``weights`` in turn and share the sum of all sizes by them. A target stops at ``cap``
    times its source's size; the excess goes to the others by weight until none is above. In ascending order of cap per
    weight, the sources before the first that stays below its share are the capped ones.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights)))
    weighed = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn.cast("int") + 1))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")), F.asc_nulls_last("source"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everywhere = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * cap
    rest = F.sum("source_size").over(everywhere) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    shared = weighed.withColumn("limit", limit).withColumn("rest", rest).withColumn("weights", F.sum("weight").over(after))
    free = F.col("limit") * F.col("weights") >= F.col("rest") * F.col("weight")
    shared = shared.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", F.when(free, F.col("rest").cast("double") / F.col("weights")))
    level = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("place"))).over(everywhere)
    return shared.select("source", "source_size", F.least(F.col("limit").cast("double"), level * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, size: Column, weight: Column, id_col: str, source_col: str, seed: str) -> DataFrame:
    """``carried`` (a struct of all columns), and ``doc_id, source, size, key, bucket``."""
    # null ids are told apart by their texts
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit(""))))) if "text" in docs.columns else F.col(id_col)
    key = sample_key(name, weight, seed)
    rows = docs.select(
        F.struct("*").alias("carried"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        size.alias("size"), key.alias("key"),
    )
    return rows.withColumn("bucket", F.floor(F.exp(-F.col("key")) * BUCKETS))


_PLACE = ("key", "id", "size")


def _decide(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``rows`` with ``source_size, target`` and ``times``, how often the mix takes each; fitted on ``sized``, a written table of the same rows."""
    targets = (
        source_targets(sized, weights, cap)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    )
    targets = Staged(targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets").df
    same = F.col("source").eqNullSafe(F.col("of"))
    down = Window.partitionBy("source").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(down), F.lit(0)))
    ends = (
        sums.join(targets.select(F.col("source").alias("of"), "budget"), same)
        .filter((F.col("before") < F.col("budget")) & (F.col("before") + F.col("sum") > F.col("budget")))
    )
    ends = Staged(ends.select("of", F.col("bucket").alias("end"), "before", "budget"), "ends").df
    # the rows of the bucket in which a budget ends, in order
    run = Window.partitionBy("source").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "size")
    inside = sized.join(ends, same & (F.col("bucket") == F.col("end"))).withColumn("place", place).select("source", "before", "budget", "place.*", "place")
    so_far = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    last = inside.withColumn("fits", so_far + F.col("size") / 2 < F.col("budget")).filter("fits").groupBy("source").agg(F.max("place").alias("last"))
    limits = (
        targets.withColumnRenamed("source", "of")
        .join(ends.select(F.col("of").alias("source"), "end"), F.col("of").eqNullSafe(F.col("source")), "left")
        .drop("source")
    )
    limits = Staged(limits.join(last, F.col("of").eqNullSafe(F.col("source")), "left").drop("source"), "limits").df
    extra = F.when(F.col("end").isNull(), F.col("budget") >= F.col("source_size")).otherwise(
        (F.col("bucket") > F.col("end")) | ((F.col("bucket") == F.col("end")) & F.coalesce(place <= F.col("last"), F.lit(False)))
    )
    return rows.join(limits, same).withColumn("times", F.col("epochs") + extra.cast("long"))


def mix(docs: DataFrame, size: Column, weight: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``; taken is its size times the copies the mix takes.

    A document is taken whole: ``floor(target / source_size)`` times, and once more if the source's running sum over
    ascending keys, half of the document included, is still below what the target leaves. Sizes of 0 take 0. Repeated rows
    have the same key and are taken together; rows with a null id have a key by their text. An empty table gives no rows.
    """
    sized = Staged(_sized(docs, size, weight, id_col, source_col, seed).drop("carried"), "sized").df
    return _decide(sized, sized, weights, cap).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, size: Column, weight: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it. Texts are read twice and never shuffled, unless there are too many sources to broadcast."""
    rows = _sized(docs, size, weight, id_col, source_col, seed)
    taken = _decide(rows, Staged(rows.drop("carried"), "sized").df, weights, cap).filter("times > 0")
    return taken.select("carried", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("carried.*")
