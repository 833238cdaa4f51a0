"""Streams: windows over events, deduplication, expiry, and the search index kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from lodestone.functions.policy import same_config
from lodestone.operators import bm25
from lodestone.operators.tables import latest
from lodestone.sources.staging import children, exists, remove
from lodestone.sources.versioned import LEAST_BUCKETS, VersionedTable

# fixed values: how many requests a user has in a minute
LIMITS = {"chat": 20, "upload": 10, "ingest": 10}
MERGED_COUNTS = 8  # tables of changes of frequencies that are added up into one


def rate_windows(events: DataFrame, user: str, ts: str, limit: int, seconds: int = 60, late: str | None = None) -> DataFrame:
    """``user, start, n, limited``: requests per tumbling window; a stream needs ``late``, how long a window waits."""
    df = events.withWatermark(ts, late) if late else events
    counts = df.groupBy(user, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.select(user, F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("limited"))


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``user, start, end, n``: runs of events with less than ``gap`` between them."""
    df = events.withWatermark(ts, late) if late else events
    counts = df.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """A stream without repeated keys within the watermark."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def alive(entries: DataFrame, now: Column, written: str, ttl_seconds: int) -> DataFrame:
    return entries.filter(F.col(written) + F.make_interval(secs=F.lit(ttl_seconds)) > now)


def invalidated(cache: DataFrame, document_id: int, ids: str = "document_ids") -> DataFrame:
    """The cached answers that do not rest on a document."""
    return cache.filter(~F.coalesce(F.array_contains(ids, document_id), F.lit(False)))


def current_config(changes: DataFrame) -> DataFrame:
    """``key, value, ts`` of the last change of each key."""
    return latest(changes, ["key"], ["ts", "value"])


def gauges(events: DataFrame, name: str, value: str, ts: str, seconds: int = 30, late: str | None = None) -> DataFrame:
    """``name, start, n, last, mean``: one sample of each gauge per window, its last value by time (the larger one of a tie)."""
    df = events.withWatermark(ts, late) if late else events
    rows = (
        df.groupBy(name, F.window(ts, f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("n"), F.max(F.struct(ts, value)).alias("last"), F.avg(value).alias("mean"))
    )
    return rows.select(name, F.col("w.start").alias("start"), "n", F.col(f"last.{value}").alias("last"), "mean")


def orphan_alerts(changes: DataFrame, minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """``job_id, started_at`` of each job that runs for longer than ``minutes`` of event time, from a stream of ``job_id, status, ts``.

    A job's state is when it began to run; any other status ends it, and a timer tells of those that nothing ended.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        late_alert = None
        if state.hasTimedOut:
            late_alert = state.get[0]
            state.remove()
        else:
            last = max(((t, s) for b in batches for t, s in zip(b["ts"], b["status"], strict=True)), default=None)
            if last is not None and last[1] != "running":
                if state.exists:
                    state.remove()
            elif last is not None:
                due = int(last[0].timestamp() * 1000) + minutes * 60_000
                if due <= state.getCurrentWatermarkMs():
                    late_alert = last[0]
                else:
                    state.update((last[0],))
                    state.setTimeoutTimestamp(due)
        if late_alert is not None:
            yield pd.DataFrame({"job_id": [key[0]], "started_at": [late_alert]})

    keyed = changes.withWatermark("ts", late).groupBy("job_id")
    return keyed.applyInPandasWithState(follow, "job_id long, started_at timestamp", "started_at timestamp", "append", "EventTimeTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, exactly once, into Parquet; ends when it has caught up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(spark: SparkSession, path: str, out: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """New files below ``path`` through ``parse`` into ``out``; the checkpoint remembers which are done, a new one starts over."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    return run_once(parse(files), out, checkpoint)


class LiveIndex:
    """Postings and document frequencies under additions, replacements and removals, exact at every step.

    ``apply`` takes a batch of changes (``doc_id, text, deleted`` and an order, ``seq``): of a document's changes the last
    counts, what it had is taken away and what it has now is put in its place. Postings are segments of a
    ``VersionedTable``: a batch writes the postings of its own documents, the places of those that they had, and how each of
    these tokens' frequency changes; segments of like size are merged now and then, so their number grows with the
    logarithm of the index. Readers and retries see whole versions, and a new instance goes on from the last one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS):
        self.spark, self.path = spark, path
        self.table = VersionedTable(spark, path, ["doc_id", "token"], least_buckets=buckets)

    @property
    def version(self) -> int:
        return self.table.manifest()["version"]

    def postings(self) -> DataFrame:
        rows = self.table.read()
        return rows if rows.columns else self.spark.createDataFrame([], "doc_id long, token string, tf long, dl int")

    def apply(self, changes: DataFrame, epoch: int | None = None, writer: str = "") -> None:
        """One batch; with an ``epoch`` of its ``writer`` it is idempotent, as a stream's foreachBatch needs."""
        mark = None if epoch is None else (writer, epoch)
        m = self.table.manifest()
        if self.table.applied(mark, m):
            return
        last = latest(changes.select("doc_id", "text", "deleted", "seq"), ["doc_id"], ["seq"])
        now = bm25.postings(last.filter(~F.coalesce(F.col("deleted"), F.lit(False))).select("doc_id", "text")).select("doc_id", "token", "tf", "dl")
        gone = self.table.places(last.select("doc_id"), m)
        moved = now.select("token", F.lit(1).alias("by"))
        if gone is not None:
            moved = moved.unionByName(gone.select("token", F.lit(-1).alias("by")))
        self.table.replace(last.select("doc_id"), now, mark, self._counted(m["side"], moved))
        self.table.compact()
        self.table.vacuum()

    def _counted(self, before: list[str], moved: DataFrame) -> list[str]:
        """Names of the tables of changes of frequencies with ``moved(token, by)``; several are added up into one now and then."""
        name = uuid.uuid4().hex
        if len(before) >= MERGED_COUNTS:
            moved, before = moved.unionByName(self._counts(before)), []
        moved.groupBy("token").agg(F.sum("by").alias("by")).filter("by != 0").write.parquet(f"{self.path}/side/{name}")
        return [*before, name]

    def _counts(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], "token string, by long")
        return self.spark.read.schema("token string, by long").parquet(*[f"{self.path}/side/{n}" for n in names])

    def rebuild(self, texts: DataFrame) -> None:
        """A version from all of ``texts(doc_id, text)``, whatever was there."""
        rows = bm25.postings(texts).select("doc_id", "token", "tf", "dl")
        self.table.overwrite(rows, self._counted([], rows.select("token", F.lit(1).alias("by"))))
        self.table.vacuum()

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        go = lambda batch, epoch: self.apply(batch, epoch, checkpoint)
        return changes.writeStream.foreachBatch(go).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def stats(self) -> DataFrame:
        """``token, df``, exact: the changes added up, without reading the postings."""
        return self._counts(self.table.manifest()["side"]).groupBy("token").agg(F.sum("by").alias("df")).filter("df > 0")


def rebuild_due(last_build: Column, now: Column, hour: int = 3) -> Column:
    """Whether a build at ``hour`` of every day has been missed since the last one; a first one is due."""
    today = F.date_trunc("day", now) + F.make_interval(hours=F.lit(hour))
    slot = F.when(now >= today, today).otherwise(today - F.make_interval(days=F.lit(1)))
    return last_build.isNull() | (last_build < slot)


def refetched(changes: DataFrame, table: DataFrame) -> DataFrame:
    """``key, value, ts``: changes that were too large to be sent (``oversize``) get their value from the table, those of unknown keys go."""
    now = table.select("key", F.col("value").alias("_now"))
    found = changes.join(now, "key", "left").withColumn("value", F.when(F.col("oversize"), F.col("_now")).otherwise(F.col("value")))
    return found.filter(~F.col("oversize") | F.col("_now").isNotNull()).select("key", "value", "ts")


def out_of_step(applied: DataFrame, table: DataFrame) -> DataFrame:
    """``key, value``: what a full resync has to apply, where the applied value is not the table's, as JSON; a null value takes the key away."""
    both = (
        applied.select("key", F.col("value").alias("_have"), F.lit(True).alias("_known"))
        .join(table.select("key", "value", F.lit(True).alias("_there")), "key", "full_outer")
    )
    same = F.col("_known").isNotNull() & F.col("_there").isNotNull() & same_config(F.col("_have"), F.col("value"))
    return both.filter(~same).select("key", "value")


class LiveConfig:
    """The configuration that a stream of changes leaves, as a table per version; ``resync`` makes it equal to the source table."""

    SCHEMA = "key string, value string, ts timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        done = [int(n[1:]) for n in children(spark, path) if n.startswith("v")]
        self.version = max([v for v in done if exists(spark, f"{path}/v{v}/_SUCCESS")], default=0)

    def current(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v{self.version}") if self.version else self.spark.createDataFrame([], self.SCHEMA)

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.select("key", "value", "ts").write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.version = version
        remove(self.spark, f"{self.path}/v{version - 2}")

    def apply(self, changes: DataFrame, table: DataFrame, epoch: int | None = None) -> None:
        if epoch is not None:
            self.version = epoch
        self._write(current_config(self.current().unionByName(refetched(changes, table))), self.version + 1)

    def follow(self, changes: DataFrame, table: DataFrame, checkpoint: str) -> StreamingQuery:
        go = lambda batch, epoch: self.apply(batch, table, epoch)
        return changes.writeStream.foreachBatch(go).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def resync(self, table: DataFrame, now: Column) -> None:
        fixed = out_of_step(self.current(), table)
        kept = self.current().join(fixed.select("key"), "key", "left_anti")
        self._write(kept.unionByName(fixed.filter(F.col("value").isNotNull()).withColumn("ts", now)), self.version + 1)


def sweep_progress(done: DataFrame, total: int) -> DataFrame:
    """``finished, percent, best, done`` of a sweep, a row that a listener reads until ``done``; works on a stream in complete mode as well."""
    n = F.count("*")
    return (
        done.agg(n.alias("finished"), F.round(100.0 * n / max(1, total), 1).alias("percent"), F.max("composite").alias("best"))
        .withColumn("done", F.col("finished") >= total)
    )


def renewed(entries: DataFrame, hits: DataFrame, key: str, written: str, at: str, ttl_seconds: int) -> DataFrame:
    """``key, hits, expires_at``: each hit before an entry's end counts and renews its time to live.

    An entry ends at the first gap longer than the time to live; later hits do not bring it back.
    """
    ttl = F.make_interval(secs=F.lit(ttl_seconds))
    uses = hits.select(key, F.col(at).alias("_at")).join(entries.select(key, F.col(written).alias("_from")), key).filter(F.col("_at") >= F.col("_from"))
    marks = entries.select(key, F.col(written).alias("_at"), F.lit(0).alias("_hit")).unionByName(uses.select(key, "_at", F.lit(1).alias("_hit")))
    w = Window.partitionBy(key).orderBy("_at", "_hit")
    late = F.coalesce(F.col("_at") >= F.lag("_at").over(w) + ttl, F.lit(False))
    alive_ = marks.withColumn("_late", late.cast("int")).withColumn("_dead", F.max("_late").over(w)).filter("_dead = 0")
    return alive_.groupBy(key).agg(F.sum("_hit").alias("hits"), (F.max("_at") + ttl).alias("expires_at"))
