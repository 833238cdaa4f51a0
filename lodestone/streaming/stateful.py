"""Limits and caches as state of a stream, replayed in the order of event time whatever the order of arrival.

What arrives waits in the state of its key until the watermark has passed it, so that late rows within the watermark take
their place; a timer then goes through what is due in order. State that can matter no more is removed in the same step.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.streams import run_once

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Keeps ``fields`` (the first two are ``at``, microseconds, and ``seq``) until they are due, then hands them on by ``at`` and ``seq``."""

    fields = "at long, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.fields)
        self.names = [f.split()[0] for f in self.fields.split(", ")]

    def _wait(self, rows: list[tuple]) -> None:
        self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[n] for n in self.names) for r in rows]
        if new:
            self.pending.appendList(new)
            self._wait(new)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.pending.get())
        due, later = sorted((tuple(r) for r in waiting if r[0] <= now), key=lambda r: r[:2]), [tuple(r) for r in waiting if r[0] > now]
        if later:
            self.pending.put(later)
            self._wait(later)
        else:
            self.pending.clear()
        return iter(self.due(key, due, now)) if due else iter(())

    def due(self, key: tuple, rows: list[tuple], now: int) -> list[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Sliding(InOrder):
    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "at long")

    def due(self, key: tuple, rows: list[tuple], now: int) -> list[Row]:
        times = [r[0] for r in self.recent.get()] + [r[0] for r in rows] if self.recent.exists() else [r[0] for r in rows]
        out, lo, hi = [], 0, 0
        for at, seq in rows:
            while hi < len(times) and times[hi] <= at:
                hi += 1
            while times[lo] <= at - self.micros:
                lo += 1
            out.append(Row(key=key[0], seq=seq, n=hi - lo, limited=hi - lo > self.limit))
        left = [(x,) for x in times if x > now - self.micros]
        self.recent.put(left) if left else self.recent.clear()
        return out


class _Cache(InOrder):
    fields = "at long, seq long, kind string, name string, documents array<long>"

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entries = handle.getMapState("entries", "name string", "ends long, hits long, documents array<long>")
        self.holders = handle.getMapState("holders", "document long", "names array<string>")

    def _remove(self, name: str) -> None:
        for d in self.entries.getValue((name,))[2]:
            names = [x for x in self.holders.getValue((d,))[0] if x != name]
            self.holders.updateValue((d,), (names,)) if names else self.holders.removeKey((d,))
        self.entries.removeKey((name,))

    def due(self, key: tuple, rows: list[tuple], now: int) -> list[Row]:
        out = []
        for at, seq, kind, name, documents in rows:
            held = sorted(set(documents or []))
            if kind == "drop":
                for n in {x for d in held if self.holders.containsKey((d,)) for x in self.holders.getValue((d,))[0]}:
                    self._remove(n)
                continue
            there = self.entries.containsKey((name,))
            if there and (kind == "put" or self.entries.getValue((name,))[0] <= at):
                self._remove(name)
                there = False
            if kind == "put":
                self.entries.updateValue((name,), (at + self.micros, 0, held))
                for d in held:
                    names = self.holders.getValue((d,))[0] if self.holders.containsKey((d,)) else []
                    self.holders.updateValue((d,), ([*names, name],))
            else:
                hits = 0
                if there:
                    _, hits, held = self.entries.getValue((name,))
                    hits += 1
                    self.entries.updateValue((name,), (at + self.micros, hits, list(held)))
                out.append(Row(seq=seq, name=name, hit=there, hits=hits))
        for n in [k[0] for k, v in self.entries.iterator() if v[0] <= now]:
            self._remove(n)
        return out


def _in_order(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).withColumn("at", F.unix_micros(ts))


def sliding_limits(requests: DataFrame, user: str, ts: str, seq: str, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """``key, seq, n, limited`` for each request of a stream: how many the user has made in the ``seconds`` up to it, itself and those of the same time included.

    ``seq`` names a request. Requests without a user or a time are left out. A user's state is the times of one window and
    what waits for the watermark.
    """
    rows = _in_order(requests.select(F.col(user).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(ts)).filter(f"key IS NOT NULL AND {ts} IS NOT NULL"), ts, late)
    schema = f"key {dict(rows.dtypes)['key']}, seq long, n long, limited boolean"
    return rows.groupBy("key").transformWithState(_Sliding(limit, seconds * 1_000_000), schema, "Append", "EventTime")


def cache_answers(events: DataFrame, ts: str, ttl_seconds: int, groups: int = 64, late: str = "10 minutes") -> DataFrame:
    """``seq, name, hit, hits`` for each ``get`` in a stream of ``seq, kind, name, documents``: whether the cache has an answer, and its hits so far.

    ``put`` writes an answer that rests on documents, a hit renews its life, ``drop`` removes all answers that rest on one of
    its documents. Names are dealt to ``groups`` states; a ``drop`` goes to each. Rows of equal time follow ``seq``.
    """
    rows = events.filter(f"{ts} IS NOT NULL").withColumn("seq", F.col("seq").cast("long"))
    every = F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")
    group = F.explode(F.when(F.col("kind") == "drop", every).otherwise(F.array(F.pmod(F.xxhash64("name"), F.lit(groups)))))
    dealt = _in_order(rows.select(group.alias("group"), "seq", "kind", "name", F.col("documents").cast("array<long>").alias("documents"), ts), ts, late)
    return dealt.groupBy("group").transformWithState(_Cache(ttl_seconds * 1_000_000), "seq long, name string, hit boolean, hits long", "Append", "EventTime")


def run_stateful(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """``run_once`` with state on disk, which ``transformWithState`` needs; the session's own choice is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run_once(stream, path, checkpoint)
    finally:
        spark.conf.set(PROVIDER, before)
