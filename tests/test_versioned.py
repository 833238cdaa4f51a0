"""Versioned tables: last write wins, crashes leave a whole version, writes grow with the batch, merged segments equal a rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25
from lodestone.sources import sinks, staging, versioned
from lodestone.streaming import streams

ROWS = "k long, h string, v int, who string"


def rows(table, *columns):
    return sorted(tuple(r[c] for c in columns) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    t = versioned.VersionedTable(spark, str(tmp_path / "t"), ["k", "h"], ["who"], least_buckets=4)
    t.upsert(spark.createDataFrame([(k, h, 10 * k, "all") for k in range(20) for h in "ab"], ROWS))
    return t


def test_last_write_wins_in_every_column(spark, table):
    table.upsert(spark.createDataFrame([(3, "a", 7, "me"), (3, "a", 5, "all"), (99, "x", 1, None)], ROWS).withColumn("seq", F.col("v")).drop("seq"), order=["v"])
    got = {(r.k, r.h): (r.v, r.who) for r in table.read().collect()}
    assert len(got) == 41 and got[3, "a"] == (7, "me") and got[3, "b"] == (30, "all") and got[99, "x"] == (1, None)
    assert table.read().columns == ["k", "h", "v", "who"]
    # a filter on the folders finds the new visibility and not the old one
    assert [r.v for r in table.read().filter("who = 'me'").collect()] == [7]
    assert table.read().filter("k = 3 AND h = 'a' AND who = 'all'").count() == 0
    table.delete(spark.createDataFrame([(3,), (4,), (1234,)], "k long"))
    assert {r.k for r in table.read().collect()} == set(range(20)) - {3, 4} | {99}
    assert table.read(2).count() == 41 and table.read(1).count() == 40  # versions stay readable until they are let go
    with pytest.raises(ValueError, match="columns"):
        table.upsert(spark.createDataFrame([(1, "a", 2)], "k long, h string, v int"))


def test_a_delete_writes_places_only(spark, table):
    before = set(staging.children(spark, f"{table.path}/data"))
    table.delete(spark.createDataFrame([(5,)], "k long"))
    assert set(staging.children(spark, f"{table.path}/data")) == before
    m = table.manifest()
    assert [v["rows"] for v in m["vectors"]] == [2] and sum(s["rows"] for s in m["segments"]) == 40


@pytest.mark.parametrize("step", ["data", "places", "manifest", "rename"])
def test_a_crash_leaves_the_old_version(spark, table, monkeypatch, step):
    before = rows(table, "k", "h", "v", "who")

    def crash(*_, **__):
        raise OSError("the driver died")

    if step == "data":
        monkeypatch.setattr(versioned.VersionedTable, "_write", crash)
    elif step == "places":
        monkeypatch.setattr(versioned.VersionedTable, "places", crash)
    elif step == "manifest":
        monkeypatch.setattr(versioned, "write_text_once", crash)
    else:  # the manifest was written aside, and not renamed
        monkeypatch.setattr(versioned, "write_text_once", lambda s, p, text: staging.write_text_once(s, p + ".aside", text) and crash())
    change = spark.createDataFrame([(1, "a", -1, "me"), (77, "z", -1, "me")], ROWS)
    with pytest.raises(OSError, match="died"):
        table.upsert(change)
    assert rows(table, "k", "h", "v", "who") == before
    monkeypatch.undo()
    again = versioned.VersionedTable(spark, table.path, ["k", "h"], ["who"], least_buckets=4)
    again.upsert(change)
    assert len(rows(again, "k", "h")) == 41 and again.read().filter("v = -1").count() == 2
    again.vacuum(keep=1)
    m = again.manifest()
    assert {x.removeprefix("_segment=") for x in staging.children(spark, f"{again.path}/data")} == {s["name"] for s in m["segments"]}
    assert len(rows(again, "k", "h")) == 41


def test_two_writers(spark, table, monkeypatch):
    """The second of two writers that began at one version is told."""
    old = table.manifest()
    table.delete(spark.createDataFrame([(0,)], "k long"))
    monkeypatch.setattr(versioned.VersionedTable, "manifest", lambda self, version=None: old)
    with pytest.raises(RuntimeError, match="another writer"):
        table.delete(spark.createDataFrame([(1,)], "k long"))


def test_segments_stay_few(spark, tmp_path):
    t = versioned.VersionedTable(spark, str(tmp_path / "t"), ["k"], least_buckets=2)
    want = {}
    for batch in range(9):
        some = {k: batch for k in range(batch * 3, batch * 3 + 5)}
        want |= some
        t.upsert(spark.createDataFrame(list(some.items()), "k long, v int"))
        t.compact()
    m = t.manifest()
    assert len(m["segments"]) < 6 and rows(t, "k", "v") == sorted(want.items())
    assert t.compact(everything=True) == len(m["segments"]) - 1
    m = t.manifest()
    assert [s["rows"] for s in m["segments"]] == [len(want)] and m["vectors"] == [] and rows(t, "k", "v") == sorted(want.items())
    t.delete(t.read().select("k"))
    t.compact(everything=True)
    assert t.manifest()["segments"] == [] and rows(t, "k", "v") == []


def test_collection_changes(spark, tmp_path):
    store = sinks.Collection(spark, str(tmp_path / "c"))
    store.ensure(1)
    embed = F.array(F.length("content").cast("float"))
    schema = "document_id long, content string, doc_domain string, visibility string, page int"
    store.upsert(spark.createDataFrame([(1, "t", "d", "internal_public", 1), (1, "u", "d", "internal_public", 2), (2, "t", "d", "internal_public", 1)], schema), embed)
    store.upsert(spark.createDataFrame([(1, "t", "d", "internal_private", 1)], schema), embed)  # the same chunk, private now
    seen = lambda: sorted((r.document_id, r.content, r.visibility, r.page) for r in store.read().collect())
    assert seen() == [(1, "t", "internal_private", 1), (1, "u", "internal_public", 2), (2, "t", "internal_public", 1)]
    assert store.read().filter("visibility = 'internal_public' AND document_id = 1 AND content = 't'").count() == 0
    store.change(spark.createDataFrame([(1, "client_private")], "document_id long, visibility string"))
    assert seen()[:2] == [(1, "t", "client_private", 1), (1, "u", "client_private", 2)]
    store.replace(spark.createDataFrame([(1, "new text", "d", "internal_public", 9)], schema), embed)
    assert seen() == [(1, "new text", "internal_public", 9), (2, "t", "internal_public", 1)]
    store.tidy()
    store.delete(spark.createDataFrame([(1,)], "document_id long"))
    assert seen() == [(2, "t", "internal_public", 1)]


def _rows_written(table):
    m = table.manifest()
    return sum(s["rows"] for s in m["segments"]) + sum(v["rows"] for v in m["vectors"])


def test_ten_batches_equal_a_rebuild(spark, tmp_path):
    """Frequencies and postings are exact after every batch, and a small batch writes little beside a large index."""
    draw = random.Random(3)
    texts = {k: " ".join(f"w{int(draw.paretovariate(0.7)) % 900}" for _ in range(60)) for k in range(1200)}
    schema = "doc_id long, text string, deleted boolean, seq int"
    index = streams.LiveIndex(spark, str(tmp_path / "index"), buckets=4)
    index.apply(spark.createDataFrame([(k, t, False, 0) for k, t in texts.items()], schema).repartition(4))
    first = _rows_written(index.table)
    for batch in range(9):
        changed = draw.sample(range(1300), 12)
        new = {k: None if draw.random() < 0.3 else f"batch {batch} w{k % 50} again again" for k in changed}
        index.apply(spark.createDataFrame([(k, t, t is None, batch) for k, t in new.items()], schema), batch, "test")
        texts = {k: t for k, t in (texts | new).items() if t is not None}
        if batch == 1:
            assert _rows_written(index.table) - first < 2 * 12 * 64 < 0.1 * first  # what two batches have and what they took away
            index.apply(spark.createDataFrame([(5, "this batch again", False, 0)], schema), batch, "test")  # a number that was applied
    want = bm25.postings(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("doc_id", "token", "tf", "dl")
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, want.collect()))
    assert {r.token: r.df for r in index.stats().collect()} == {r.token: r["count"] for r in want.groupBy("token").count().collect()}
    assert len(index.table.manifest()["segments"]) <= 6
