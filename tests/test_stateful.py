"""Limits and caches of streams against a replay of all rows in order, with rows that come late and runs that go on."""

import datetime
import random

from lodestone.streaming import stateful

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def write_files(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def shuffled(rows, seconds, draw):
    """Rows by time, each put back by less than half of ``seconds``."""
    return sorted(rows, key=lambda r: (r[0] - START).total_seconds() + draw.random() * seconds / 2)


def test_sliding_limits(spark, tmp_path):
    draw = random.Random(4)
    schema = "ts timestamp, user string, id long"
    rows = [(at(draw.randrange(900)), f"u{draw.choice([0, 0, 0, 1, 2])}", k) for k in range(240)]
    arrived = shuffled(rows, 100, draw)
    batches = [arrived[k : k + 80] for k in range(0, 240, 80)] + [[(at(9000), "end", -1), (None, "u0", -2), (at(8000), None, -3)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(spark, source, batches[:2], schema)
    run = lambda: stateful.run_stateful(spark, stateful.sliding_limits(stream(spark, source, schema), "user", "ts", "id", 5, 60, "100 seconds"), out, str(tmp_path / "state")).awaitTermination()
    run()
    write_files(spark, source + "/more", batches[2:], schema)  # the next run goes on from the state
    run()
    got = {r.seq: (r.key, r.n, r.limited) for r in spark.read.parquet(out).collect()}
    want = {}
    for ts, user, k in rows:
        n = sum(u == user and ts - datetime.timedelta(seconds=60) < x <= ts for x, u, _ in rows)
        want[k] = (user, n, n > 5)
    assert {k: v for k, v in got.items() if k >= 0} == want and -2 not in got and -3 not in got
    assert any(v[2] for v in want.values()) and not all(v[2] for v in want.values())


def replay(rows, ttl):
    cache, out = {}, {}
    for ts, seq, kind, name, documents in sorted(rows, key=lambda r: r[:2]):
        if kind == "put":
            cache[name] = [ts + datetime.timedelta(seconds=ttl), 0, set(documents or [])]
        elif kind == "drop":
            cache = {n: e for n, e in cache.items() if not e[2] & set(documents or [])}
        else:
            there = name in cache and cache[name][0] > ts
            if there:
                cache[name][0], cache[name][1] = ts + datetime.timedelta(seconds=ttl), cache[name][1] + 1
            else:
                cache.pop(name, None)
            out[seq] = (name, there, cache[name][1] if there else 0)
    return out


def test_cache(spark, tmp_path):
    draw = random.Random(8)
    schema = "ts timestamp, seq long, kind string, name string, documents array<long>"
    rows = []
    for k in range(300):
        kind = draw.choices(["put", "get", "drop"], [3, 8, 1])[0]
        documents = None if kind == "get" or draw.random() < 0.1 else [draw.randrange(12) for _ in range(draw.randrange(3))]
        rows.append((at(draw.randrange(600)), k, kind, None if kind == "drop" else f"n{draw.randrange(9)}", documents))
    arrived = shuffled(rows, 60, draw)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(spark, source, [arrived[:150], arrived[150:], [(at(9000), -1, "get", "end", None)]], schema)
    answers = stateful.cache_answers(stream(spark, source, schema), "ts", 40, 4, "60 seconds")
    stateful.run_stateful(spark, answers, out, str(tmp_path / "state")).awaitTermination()
    got = {r.seq: (r.name, r.hit, r.hits) for r in spark.read.parquet(out).collect() if r.seq >= 0}
    want = replay(rows, 40)
    assert got == want and 20 < sum(v[1] for v in want.values()) < len(want) - 20
