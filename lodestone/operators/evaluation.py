"""Retrieval quality: hits and ranks, parameter grids, summaries, and comparisons of runs."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.policy import judge_reason, judge_score
from lodestone.sources.ledger import Ledger

# fixed values: metrics that judges give out of ten, and the falls that fail a run
OUT_OF_TEN = {"faithfulness", "relevancy", "correctness"}
METRICS = ["hit_rate", "mrr", "faithfulness", "relevancy", "correctness", "avg_similarity"]
THRESHOLDS = {"hit_rate": -0.05, "faithfulness": -1.0, "relevancy": -1.0, "correctness": -1.0}
PROBLEM_BELOW = 5


def retrieval_metrics(found: DataFrame, questions: DataFrame, by: str = "qid", source: str = "source", hint: str = "source_hint") -> DataFrame:
    """``by, hit_rate, mrr, avg_similarity`` for every question; without a hint hit and rank are null. A hit: the source's name contains the hint."""
    rows = questions.select(by, hint).join(found, by, "left")
    hit = F.contains(F.lower(source), F.lower(hint))
    first = F.min(F.when(hit, F.col("rank")))
    known = F.max(hint).isNotNull()
    return rows.groupBy(by).agg(
        F.when(known, first.isNotNull().cast("int")).alias("hit_rate"), F.when(known, F.round(F.coalesce(1 / first, F.lit(0.0)), 4)).alias("mrr"),
        F.round(F.avg("score"), 4).alias("avg_similarity"),
    )


def summary(results: DataFrame, by: list[str], digits: dict[str, int]) -> DataFrame:
    """Means over the non-null values of each metric, rounded."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(m), d).alias(m) for m, d in digits.items()])


def over_runs(results: DataFrame, question: str, run: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """Averages per question over runs, and then the averages of these."""
    per_question = results.groupBy(question).agg(F.countDistinct(run).alias("runs"), *[F.avg(m).alias(m) for m in metrics])
    return per_question.agg(F.max("runs").alias("runs"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])


def composite(weights: dict[str, float], digits: int = 4) -> Column:
    """The weighted mean of those metrics that have a positive weight and a value; judged ones as shares of ten."""
    parts = [(m, w) for m, w in weights.items() if w > 0]
    if not parts:
        return F.lit(0.0)
    value = {m: F.col(m) / 10 if m in OUT_OF_TEN else F.col(m) for m, _ in parts}
    score = reduce(lambda a, b: a + b, [F.coalesce(F.lit(float(w)) * value[m], F.lit(0.0)) for m, w in parts])
    total = reduce(lambda a, b: a + b, [F.when(F.col(m).isNotNull(), float(w)).otherwise(0.0) for m, w in parts])
    return F.coalesce(F.round(score / F.nullif(total, F.lit(0.0)), digits), F.lit(0.0))


def axis(spec: dict) -> list[float]:
    """The values of a parameter: a list, or from min to max by step, the end included."""
    if "values" in spec:
        return list(spec["values"])
    if "min" not in spec:
        return [spec["default"]]
    n = int((spec["max"] - spec["min"]) / spec["step"] + 1e-9)
    return [round(spec["min"] + k * spec["step"], 6) for k in range(n + 1)]


def grid(spark: SparkSession, space: dict[str, dict]) -> DataFrame:
    """One row per point, with ``config_id``; its size is the product of the axes' and does not depend on data."""
    points = [(k, *map(float, p)) for k, p in enumerate(itertools.product(*[axis(s) for s in space.values()]))]
    return spark.createDataFrame(points, "config_id int" + "".join(f", {name} double" for name in space))


def grid_size(space: dict[str, dict]) -> int:
    return reduce(lambda a, s: a * len(axis(s)), space.values(), 1)


def random_points(spark: SparkSession, space: dict[str, dict], n: int, seed: int) -> DataFrame:
    """n points: uniform between min and max (whole numbers where both and the step are), or a choice of values."""
    df = spark.range(n).select(F.col("id").cast("int").alias("config_id"))
    for k, (name, s) in enumerate(space.items()):
        u = F.rand(seed + k)
        if "values" in s:
            v = s["values"]
            col = F.element_at(F.array(*[F.lit(float(x)) for x in v]), (F.floor(u * len(v)) + 1).cast("int"))
        elif all(float(s[x]).is_integer() for x in ("min", "max")) and float(s.get("step", 1)).is_integer():
            col = F.floor(s["min"] + u * (s["max"] - s["min"] + 1)).cast("double")
        else:
            col = F.round(s["min"] + u * (s["max"] - s["min"]), 6)
        df = df.withColumn(name, col)
    return df


def halved(scored: DataFrame, score: str, rounds: int) -> DataFrame:
    """The best half of the points, again and again: what successive halving keeps after ``rounds``."""
    w = Window.orderBy(F.desc(score), "config_id")
    return scored.withColumn("_place", F.percent_rank().over(w)).filter(F.col("_place") < F.lit(0.5) ** rounds).drop("_place")


def sweep(places: DataFrame, lists: list[str], configs: DataFrame, questions: DataFrame, sources: DataFrame, skip_unhinted: bool = True) -> DataFrame:
    """``config_id, hit_rate, mrr``: every configuration (fetch_k, top_k, rrf_k and a weight per list) over the same candidates, in one job.

    ``places``: ``qid, key`` and for each list a column with the key's place in it, null if it has none, up to the largest
    fetch_k; the weight of a list is the configuration's column ``<list>_weight``. The grid is small and is broadcast.
    """
    sources = sources.join(places.select("key").distinct(), "key", "left_semi")  # before they meet the places under every configuration
    rows = places.crossJoin(F.broadcast(configs))
    taken = [F.when(F.col(n) <= F.col("fetch_k"), F.col(f"{n}_weight") / (F.col("rrf_k") + F.col(n))) for n in lists]
    score = F.round(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in taken]), 9)
    listed = reduce(lambda a, b: a | b, [x.isNotNull() for x in taken])
    w = Window.partitionBy("config_id", "qid").orderBy(F.desc("score"), "key")
    kept = rows.filter(listed).withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("top_k"))
    hinted = questions.filter(F.col("source_hint").isNotNull()) if skip_unhinted else questions
    hits = kept.join(sources, "key").join(hinted.select("qid", "source_hint"), "qid").filter(F.contains(F.lower("source"), F.lower("source_hint")))
    first = hits.groupBy("config_id", "qid").agg(F.min("rank").alias("first"))
    sums = first.groupBy("config_id").agg(F.count("*").alias("found"), F.sum(1 / F.col("first")).alias("mrr"))
    asked = F.broadcast(hinted.agg(F.nullif(F.count("*"), F.lit(0)).alias("asked")))  # one row
    out = configs.select("config_id").join(sums, "config_id", "left").crossJoin(asked)
    share = lambda c, digits: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("asked"), digits)
    return out.select("config_id", share("found", 3).alias("hit_rate"), share("mrr", 4).alias("mrr"))


def two_phases(scored: DataFrame, weights: dict[str, float], top_n: int, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Phase A ranks every configuration by its retrieval metrics, phase B judges the ``top_n`` best and ranks those by all metrics.

    ``scored``: ``config_id, hit_rate, mrr``; ``judge`` adds ``faithfulness`` and ``relevancy`` to the rows that it gets.
    ``config_id, composite, judged, place``: judged configurations come first.
    """
    unjudged = scored.withColumns({m: F.lit(None).cast("double") for m in OUT_OF_TEN if m not in scored.columns})
    first = unjudged.withColumn("composite", composite(weights)).orderBy(F.desc("composite"), "config_id").limit(top_n).select("config_id")
    final = judge(scored.join(F.broadcast(first), "config_id", "left_semi")).withColumn("composite", composite(weights))  # top_n rows
    rest = unjudged.join(F.broadcast(first), "config_id", "left_anti").withColumn("composite", composite(weights))
    both = final.select("config_id", "composite", F.lit(True).alias("judged")).unionByName(rest.select("config_id", "composite", F.lit(False).alias("judged")))
    return both.withColumn("place", F.row_number().over(Window.orderBy(F.desc("judged"), F.desc("composite"), "config_id")))  # a row for each configuration


def search_rerank(found: DataFrame, params: DataFrame, questions: DataFrame) -> DataFrame:
    """``param_id, hit_rate, mrr``: reranked lists under every setting of ``params(param_id, top_k, min_score, gap_ratio)``.

    ``found``: ``qid, key, source, score``, reranked. Thresholds come before the cut, the gap only where the best score is
    positive. Questions without a hint are left out.
    """
    best = F.max("score").over(Window.partitionBy("qid"))
    rows = found.withColumn("best", best).crossJoin(F.broadcast(params))
    good = (F.col("score") >= F.col("min_score")) & ((F.col("best") <= 0) | (F.col("score") >= F.col("best") * F.col("gap_ratio")))
    w = Window.partitionBy("param_id", "qid").orderBy(F.desc("score"), "key")
    kept = rows.filter(good).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("top_k"))
    hinted = questions.filter(F.col("source_hint").isNotNull()).select("qid", "source_hint")
    hits = kept.join(hinted, "qid").filter(F.contains(F.lower("source"), F.lower("source_hint")))
    sums = (
        hits.groupBy("param_id", "qid").agg(F.min("rank").alias("first"))
        .groupBy("param_id")
        .agg(F.count("*").alias("found"), F.sum(1 / F.col("first")).alias("mrr"))
    )
    asked = F.broadcast(hinted.agg(F.nullif(F.count("*"), F.lit(0)).alias("asked")))  # one row
    out = params.select("param_id").join(sums, "param_id", "left").crossJoin(asked)
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("asked"), 4)
    return out.select("param_id", share("found").alias("hit_rate"), share("mrr").alias("mrr"))


def judged(answers: DataFrame, judge: Callable[[str, dict], str], retries: int = 3) -> DataFrame:
    """``answers`` with a score and a reason for each of ``faithfulness, relevancy, correctness``; ``judge(metric, row)`` gives a model's reply.

    A call that fails is tried ``retries`` times in all, and then the task fails. Correctness is null without an
    ``expected_answer``. The port is called in the tasks, a batch of rows at a time; replies are parsed as columns.
    """
    metrics = [m for m in METRICS if m in OUT_OF_TEN]

    def reply(metric: str, row: dict) -> str | None:
        if metric == "correctness" and not row.get("expected_answer"):
            return None
        for attempt in range(1, retries + 1):
            try:
                return judge(metric, row)
            except Exception:
                if attempt == retries:
                    raise
        return None

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            yield pdf.assign(**{f"_{m}": pd.Series([reply(m, r) for r in rows], dtype="object", index=pdf.index) for m in metrics})

    schema = T.StructType([*answers.schema.fields, *[T.StructField(f"_{m}", T.StringType()) for m in metrics]])
    raw = answers.mapInPandas(ask, schema)
    for m in metrics:
        said = F.col(f"_{m}")
        raw = raw.withColumn(m, F.when(said.isNotNull(), judge_score(said))).withColumn(f"{m}_reason", F.when(said.isNotNull(), judge_reason(said)))
    return raw.drop(*[f"_{m}" for m in metrics])


def judged_once(answers: DataFrame, ledger: Ledger, model: Callable[[str, str], str], columns: list[str] | None = None, retries: int = 3) -> DataFrame:
    """As ``judged``, by a journal: ``model(metric, prompt)`` sees ``columns`` (all that a judge needs) as JSON and is called once for each distinct prompt.

    What earlier runs and lost tasks were told is taken from the journal.
    """
    metrics = [m for m in METRICS if m in OUT_OF_TEN]
    columns = columns or [c for c in ("question", "answer", "expected_answer", "context") if c in answers.columns]
    asked = answers.withColumn("_prompt", F.to_json(F.struct(*columns)))
    expected = F.coalesce(F.col("expected_answer") != "", F.lit(False))
    which = F.array_compact(F.array(*[F.when(expected, F.lit(m)) if m == "correctness" else F.lit(m) for m in metrics]))
    replies = ledger.ask(asked.select(F.explode(which).alias("kind"), F.col("_prompt").alias("prompt")).distinct(), model, retries)
    said = replies.groupBy(F.col("prompt").alias("_prompt")).agg(*[F.max(F.when(F.col("kind") == m, F.col("reply"))).alias(f"_{m}") for m in metrics])
    raw = asked.join(said, "_prompt", "left")
    for m in metrics:
        reply = F.col(f"_{m}")
        raw = raw.withColumn(m, F.when(reply.isNotNull(), judge_score(reply))).withColumn(f"{m}_reason", F.when(reply.isNotNull(), judge_reason(reply)))
    return raw.drop("_prompt", *[f"_{m}" for m in metrics])


def compare(current: DataFrame, baseline: DataFrame, spark: SparkSession, thresholds: dict[str, float] | None = None) -> DataFrame:
    """``metric, baseline, current, delta, threshold, failed`` for each threshold; a missing side is skipped and does not fail. Inputs: ``metric, value``."""
    limits = spark.createDataFrame(list((thresholds or THRESHOLDS).items()), "metric string, threshold double")
    rows = limits.join(current.withColumnRenamed("value", "current"), "metric", "left").join(baseline.withColumnRenamed("value", "baseline"), "metric", "left")
    delta = F.col("current") - F.col("baseline")
    return rows.select(
        "metric", F.round("baseline", 4).alias("baseline"), F.round("current", 4).alias("current"), F.round(delta, 4).alias("delta"),
        "threshold", F.coalesce(delta < F.col("threshold"), F.lit(False)).alias("failed"),
    )


def passed(comparison: DataFrame) -> DataFrame:
    return comparison.agg((~F.coalesce(F.bool_or("failed"), F.lit(False))).alias("passed"))


def side_by_side(runs: DataFrame, run: str, ids: list[int]) -> DataFrame:
    """``key`` and a column per run, from rows of ``run, config map<string,string>``; keys in order, absent ones null."""
    return runs.select(run, F.explode("config").alias("key", "value")).groupBy("key").pivot(run, ids).agg(F.first("value")).orderBy("key")


def trend(runs: DataFrame, by: str, order: str, metric: str, digits: int = 4) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    before = F.lag(metric).over(w)
    return runs.withColumn("previous", before).withColumn("delta", F.round(F.col(metric) - before, digits))


def problems(results: DataFrame, below: float = PROBLEM_BELOW) -> DataFrame:
    return results.filter((F.col("faithfulness") < below) | (F.col("relevancy") < below))

