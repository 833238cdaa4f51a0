"""Tables as the service keeps them: latest states, upserts, differences, pages of results, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last entry of each key in a log of changes; a tombstone (``deleted`` true) removes the key. ``order`` must be total."""
    rest = [c for c in log.columns if c not in keys]
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")
    return out if deleted is None else out.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def replace_groups(table: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """``table`` with the rows of every ``by`` in ``new`` replaced by those of ``new``."""
    return table.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A full outer join in which a non-null new value wins."""
    rest = [c for c in table.columns if c not in keys]
    return table.alias("t").join(new.alias("n"), keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")).alias(c) for c in rest])


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, missing_in``: ids that only one side has, from one full outer join."""
    l, r = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    both = l.join(r, key, "full_outer")
    return both.filter(F.col("_l").isNull() | F.col("_r").isNull()).select(key, F.when(F.col("_l").isNull(), "left").otherwise("right").alias("missing_in"))


def append_new(table: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``table`` and those rows of ``more`` whose key it does not have."""
    return table.unionByName(more.join(table.select(key), key, "left_anti"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of results; the order must be total."""
    return df.orderBy(*order).offset(offset).limit(limit)


def matching(conditions: list[Column | None]) -> Column:
    """All of the filters that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def contains_text(c: Column, part: str) -> Column:
    """Case-insensitive containment; % and _ are ordinary characters."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def phrase(c: Column, words: str, least: int = 3) -> Column:
    """The whole phrase, whatever its case, with word borders as Unicode has them; nothing for fewer than ``least`` characters."""
    words = words.strip()
    if len(words) < least:
        return F.lit(False)
    quoted = words.replace("\\E", "\\E\\\\E\\Q")
    return c.rlike(rf"(?iU)(?<!\w)\Q{quoted}\E(?!\w)")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unique_names(df: DataFrame, name: str, order: str, ranges: int | None = None) -> DataFrame:
    """``unique_name``: later rows with the same name, by ``order``, get a number before the extension.

    Rows are numbered within ranges of ``order``, and the counts of the ranges before are added, so that a name which a
    third of all rows have is no single task. ``order`` is a number or a time and differs within a name.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(order) if dict(df.dtypes)[order] not in ("timestamp", "date") else F.unix_micros(F.col(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<long>")
    ranged = df.withColumn("_range", F.size(F.filter(bounds, lambda c: c < at)))
    counts = ranged.groupBy(name, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(name).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = counts.select(F.col(name).alias("_name"), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(name, "_range").orderBy(order)) - 1
    rows = ranged.withColumn("_inside", inside).join(starts, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_range") == F.col("_of")))
    nth = F.col("_inside") + F.col("_before")
    base, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    named = F.when(nth == 0, F.col(name)).otherwise(F.concat(base, F.lit(" ("), nth.cast("string"), F.lit(")"), ext))
    return rows.withColumn("unique_name", named).select(*df.columns, "unique_name")


def question_filter(dataset: str | None = None, tag: str | None = None, search: str | None = None, is_active: bool | None = None) -> Column:
    """Benchmark questions by dataset, tag, text in the question, the expected answer or the notes, and whether they are active."""
    found = None
    if search:
        found = reduce(lambda a, b: a | b, [F.coalesce(contains_text(F.col(c), search), F.lit(False)) for c in ("question", "expected_answer", "notes")])
    return matching([
        None if dataset is None else F.col("dataset") == dataset, None if tag is None else F.coalesce(F.array_contains("tags", tag), F.lit(False)), found,
        None if is_active is None else F.col("is_active") == is_active,
    ])


def patch(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``table`` with some columns of some rows changed: of each column the last non-null change by ``order`` wins; unknown keys change nothing."""
    columns = [c for c in changes.columns if c not in (key, order)]
    last = changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns])
    out = table.join(last, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def apply_log(table: DataFrame, log: DataFrame, key: str, order: str, deleted: str = "deleted") -> DataFrame:
    """``table`` after a log of inserts, updates and deletions of whole rows; the last entry of a key by ``order`` counts."""
    last = latest(log, [key], [order])
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter(~F.coalesce(F.col(deleted), F.lit(False))).select(*table.columns))


def lifecycle(events: DataFrame, key: str, kind: str, ts: str) -> DataFrame:
    """``key, created_at, last_used_at, revoked_at, is_active`` from events ``create, use, revoke``; a later creation takes a revocation back."""
    when = lambda k: F.when(F.col(kind) == k, F.col(ts))
    out = (
        events.groupBy(key)
        .agg(
            F.min(when("create")).alias("created_at"), F.max(when("create")).alias("_again"), F.max(when("use")).alias("last_used_at"),
            F.max(when("revoke")).alias("revoked_at"),
        )
    )
    active = F.col("created_at").isNotNull() & (F.col("revoked_at").isNull() | (F.col("_again") > F.col("revoked_at")))
    return out.withColumn("is_active", active).drop("_again")


def first_non_empty(table: DataFrame, other: DataFrame) -> DataFrame:
    """``table``, or ``other`` where it has no rows: questions of the database before those of a file."""
    return other.limit(0).unionByName(table) if not table.isEmpty() else other


def conversations(messages: DataFrame, by: str = "conv_id", order: str = "id") -> DataFrame:
    """``by, first_question, n_messages, last_id``, from one aggregation: the first message of the user, and the count of all."""
    said = F.when(F.col("role") == "user", F.col(order))
    return messages.groupBy(by).agg(F.min_by("content", said).alias("first_question"), F.count("*").alias("n_messages"), F.max(order).alias("last_id"))


def orphaned(jobs: DataFrame, now: Column, minutes: int) -> DataFrame:
    return jobs.filter((F.col("status") == "running") & (F.col("started_at") < now - F.make_interval(mins=F.lit(minutes))))


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """``by, le, n``: cumulative counts under fixed upper bounds, the last one infinite, in one pass and without a row per bound."""
    counts = df.groupBy(*by).agg(F.array(*[F.count_if(F.col(value) <= b) for b in bounds], F.count(value)).alias("ns"))
    les = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    return counts.select(*by, F.explode(F.arrays_zip(les.alias("le"), F.col("ns").alias("n"))).alias("x")).select(*by, "x.le", "x.n")


def health(checks: DataFrame, status: str = "status") -> DataFrame:
    bad = F.bool_or(F.startswith(F.col(status), F.lit("error")))
    return checks.agg(F.when(F.coalesce(bad, F.lit(False)), "degraded").otherwise("ok").alias("overall"))
