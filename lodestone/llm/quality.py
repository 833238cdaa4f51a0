"""Quality rules whose cutoffs limit the false rejections of each stratum.

Every document gets whole-text counts and five scores. A labelled text is either in the tuning part or in the holdout
part, by its hash; exact copies are one, labelled clean if all are, so none is on both sides or counts twice. For each stratum (language) and each level of strictness, the tuning part gives each rule a
lower limit that at most that share of its clean documents reach; the cutoff lies half-way from there to the scores of the
bad documents above, so that a rule leaves clean documents room. The levels are tested on the holdout part from the mildest:
level l is certified if the exact binomial probability of so few false rejections, were the risk ``RISK``, is at most
``DELTA`` divided by the number of strata (Bonferroni over strata; within one, testing stops at the first level that
fails, so no further correction is needed). The strictest certified level sets the stratum's cutoffs; with probability
1 - DELTA no stratum's rules reject more than RISK of its clean documents. A stratum without a certificate keeps all.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._common import WHITE, Staged, text_bytes, tidy

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SAME_WORDS = 500  # the words of a window in which distinct ones are counted, as their share of a text falls with its length
RISK = 0.02
DELTA = 0.05
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005)  # the share of clean tuning documents that a rule's cutoff may reach
UNIT = 1000  # scores are whole thousandths up to 1, and thousandths of the natural logarithm above
GRID = 23_000  # beyond every score: a text has under 2**31 bytes, and ln(2**31) is 21.5
HOLDOUT = 0.7
MIN_CATCH = 0.01  # of a stratum's bad tuning documents; a rule that catches fewer is off
BAD_TAIL = 0.05  # of the bad documents above a lower limit, those nearest to it that do not draw the cutoff
RULES = ("symbol_share", "upper_share", "shout_share", "repeat_share", "same_word_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = b"#*$%&|<>"
_ODD = np.int64(0x2545F4914F6CDD1D)


def counts(text: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` and ``RULES`` of one text."""
    text = text or b""
    words, n_dup, seen = text.split(), 0, set()
    n = len(words)
    for line in text.split(b"\n"):
        if line in seen:
            n_dup += 1
        elif line.strip(WHITE):
            seen.add(line)
    solid = b"".join(words)
    points = np.frombuffer(solid.decode().encode("utf-32-le"), np.uint32)
    n_symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    if n == 0:
        return (0, 0, 0, n_dup, 0, *repeat(0, len(RULES)))
    hashes = np.fromiter(map(hash, words), np.int64, n)
    n_repeat = repeated_words(words, hashes)
    letters, upper = (int(np.count_nonzero(kind[points])) for kind in _letters())
    alike = np.flatnonzero(hashes[1:] == hashes[:-1]).tolist()
    stutter = sum(words[k] == words[k + 1] for k in alike)
    shares = (n_symbols / n, upper / max(1, letters), solid.count(b"!") / n, n_repeat / n, max(stutter / n, same_words(words)))
    return (n, len(points), n_symbols, n_dup, n_repeat, *map(score, shares))


def score(share: float) -> int:
    """The share on the grid: scores of different shares above 1 differ too."""
    return int(UNIT * share) if share <= 1 else UNIT + int(UNIT * math.log(share))


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters of any script, and which of these are capitals."""
    n = sys.maxunicode + 1
    letters = np.fromiter((chr(k).isalpha() for k in range(n)), bool, n)
    return letters, letters & np.fromiter((chr(k).isupper() for k in range(n)), bool, n)


def same_words(words: list[bytes]) -> float:
    """The share of words that their window has before, over consecutive windows of ``SAME_WORDS``; the last ends with the text."""
    n = len(words)
    if n <= SAME_WORDS:
        return 1 - len(set(words)) / n
    starts = [*range(0, n - SAME_WORDS, SAME_WORDS), n - SAME_WORDS]
    return 1 - sum(len(set(words[a : a + SAME_WORDS])) for a in starts) / (SAME_WORDS * len(starts))


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """The words that stand in a window of ``WINDOW`` words which the text has twice or more.

    ``hashes`` has one of each word. Windows whose combined hash is unique are no other's; the rest are compared as they are.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.int64)
    for k in range(WINDOW):
        mixed = mixed * _ODD + hashes[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice_by_hash = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]).tolist()
    first: dict[bytes, int] = {}
    twice = set()
    for k in twice_by_hash:
        w = b" ".join(words[k : k + WINDOW])
        if first.setdefault(w, k) != k:
            twice.add(k)
            twice.add(first[w])
    covered, end = 0, 0
    for k in sorted(twice):
        covered += k + WINDOW - max(k, end)
        end = k + WINDOW
    return covered


MEASURES = ", ".join(f"{c} long" for c in (*COUNTS, *RULES))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["carried", "stratum", "text_hash", *COUNTS, *RULES]
    for batch in batches:
        rows = [counts(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names) - 3))], names=names)


def measure(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """``doc_id`` (or the struct ``carried``), ``stratum, text_hash``, ``COUNTS`` and ``RULES`` for each row, in one pass over whole texts.

    The stratum is lang, a null one like an empty one. Null and empty texts have no words.
    """
    first = F.col("doc_id").cast("long") if carried is None else carried
    rows = docs.select(
        first.alias("carried"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text_bytes().alias("text"),
        F.xxhash64("text").alias("text_hash"),
    )
    schema = T.StructType([rows.schema["carried"], *T._parse_datatype_string(f"stratum string, text_hash long, {MEASURES}").fields])
    out = rows.mapInArrow(tidy(_counts), schema)
    return out.withColumnRenamed("carried", "doc_id") if carried is None else out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), exactly, by its terms' ratios from the first; 1 for k >= n."""
    ratio = p / (1 - p)
    log_first = n * F.log(F.lit(1 - p))
    # terms by their logarithms: the first may be too small for a double
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct(log_first.alias("term"), log_first.alias("top"), F.lit(1.0).alias("sum")),
        lambda acc, i: _add_log(acc, acc["term"] + F.log((n - i + 1).cast("double") / i * ratio)),
    )
    total = F.when(k < 1, log_first).otherwise(terms["top"] + F.log(terms["sum"]))
    return F.when(k >= n, F.lit(1.0)).otherwise(F.exp(total))


def _add_log(acc: Column, term: Column) -> Column:
    top = F.greatest(acc["top"], term)
    return F.struct(term.alias("term"), top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(term - top)).alias("sum"))


def fit_cutoffs(labelled: DataFrame, levels: tuple[float, ...] = LEVELS, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum`` and a cutoff for each rule (``cut_<rule>``), from ``labelled(text_hash, stratum, clean, RULES)``; certified strata only.

    A document that a rule's score puts at or above the cutoff is rejected. Counts cover all labelled rows; what moves is
    at most ``GRID`` + 1 counts for each stratum and rule, and one row per stratum and level.
    """
    labelled = labelled.groupBy("stratum", "text_hash").agg(F.min("clean").alias("clean"), *[F.first(r).alias(r) for r in RULES])
    tuning = F.pmod(F.xxhash64("text_hash"), F.lit(1000)) >= int(1000 * HOLDOUT)
    good = labelled.filter("clean")
    scores = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(r).alias("score")) for k, r in enumerate(RULES)]))
    histogram = (
        labelled.filter(tuning).select("stratum", "clean", scores.alias("x"))
        .groupBy("stratum", "x.rule", "x.score")
        .agg(F.count_if("clean").alias("n"), F.count_if(~F.col("clean")).alias("bad"))
    )
    histogram = Staged(histogram, "score-counts").df
    per_rule = Window.partitionBy("stratum", "rule")
    above = histogram.withColumn("above", F.sum("n").over(per_rule.orderBy(F.desc("score")))).withColumn("all", F.sum("n").over(per_rule))
    # the smallest limit above every score that more than the level's share of clean documents reach
    limit = [F.coalesce(F.max(F.when(F.col("above") > F.floor(F.lit(level) * F.col("all")), F.col("score"))), F.lit(-1)) + 1 for level in levels]
    limits = (
        above.groupBy("stratum", "rule").agg(F.array(*limit).alias("limits"), F.sum("bad").alias("all_bad"))
        .select("stratum", "rule", "all_bad", F.posexplode("limits").alias("level", "low"))
    )
    per_level = Window.partitionBy("stratum", "rule", "level")
    bad = limits.join(histogram.filter("bad > 0"), ["stratum", "rule"]).filter(F.col("score") >= F.col("low"))
    bad = bad.withColumn("upto", F.sum("bad").over(per_level.orderBy("score"))).withColumn("total", F.sum("bad").over(per_level))
    high = (
        bad.filter(F.col("total") >= F.lit(MIN_CATCH) * F.col("all_bad"))
        .filter(F.col("upto") >= F.lit(BAD_TAIL) * F.col("total"))
        .groupBy("stratum", "rule", "level")
        .agg(F.min("score").alias("high"))
    )
    # a rule with too few bad documents above its limit is off
    cut = F.coalesce(F.ceil((F.col("low") + F.col("high")) / 2), F.lit(GRID + 1))
    rule_cuts = limits.join(high, ["stratum", "rule", "level"], "left").withColumn("at", cut)
    cuts = (
        rule_cuts.groupBy("stratum", "level")
        .agg(F.struct(*[F.max(F.when(F.col("rule") == k, F.col("at"))).alias(r) for k, r in enumerate(RULES)]).alias("cut"))
    )
    tested = good.filter(~tuning).join(cuts.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | (F.col(r) >= F.col(f"cut.{r}"))
    results = tested.groupBy("stratum", "level", "cut").agg(F.count("*").alias("n"), F.count_if(rejected).alias("k"))
    strata = F.broadcast(results.select("stratum").distinct().agg(F.count("*").alias("strata")))  # one row
    sure = results.crossJoin(strata).withColumn("sure", binomial_tail(F.col("k"), F.col("n"), risk) <= F.lit(delta) / F.col("strata"))
    up_to = Window.partitionBy("stratum").orderBy("level")
    sure = sure.withColumn("sure", F.min("sure").over(up_to)).filter("sure")
    best = sure.groupBy("stratum").agg(F.max_by("cut", "level").alias("cut"))
    return best.select("stratum", *[F.col(f"cut.{r}").alias(f"cut_{r}") for r in RULES])


def cutoffs(measured: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``fit_cutoffs`` on those of ``measured`` that are labelled and pass the base rules, as a written table.

    ``labels``: ``doc_id, quality``; clean is quality 1. Of several labels of a document all must be 1; a null one is none.
    """
    clean = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("clean"))
    return Staged(fit_cutoffs(measured.filter(~base_failed()).join(clean, "doc_id"), **how), "cutoffs").df


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed``, ``rule_failed`` and ``kept``; a stratum without cutoffs keeps what passes the base rules."""
    joined = measured.join(cuts, "stratum", "left")
    failed = F.lit(False)
    for r in RULES:
        failed = failed | F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("rule_failed", failed).withColumn("kept", ~(F.col("base_failed") | F.col("rule_failed")))


def apply_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row of measures and verdict for each row of ``docs``; rows with the same or a null doc_id are judged each for itself."""
    measured = Staged(measure(docs), "measures").df
    return judge(measured, cutoffs(measured, labels, **how))


def keep_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep. They are measured once, written with their measures, and never shuffled."""
    measured = Staged(measure(docs, F.struct("*")), "measured").df
    cuts = cutoffs(measured.withColumn("doc_id", F.col("carried.doc_id").cast("long")).drop("carried"), labels, **how)
    return judge(measured, cuts).filter("kept").select("carried.*")
