"""The data source of files against a walk of the folder."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import listing
from lodestone.streaming import streams


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    for k, name in enumerate(["a.txt", "a/x.md", "a/deep/y.TXT", "a/deep/z.pdf", "b/empty/.hidden", "b/q.txt", "b/_tmp/n.txt", "c.md", "zz/none"]):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * (k * 10))
    return root


def walked(root):
    out = {}
    for where, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d[0] not in "._"]
        for n in names:
            if n[0] not in "._":
                path = os.path.join(where, n)
                out[os.path.relpath(path, root)] = os.path.getsize(path)
    return out


def test_listing(spark, folder, tmp_path):
    rows = listing.files_of(spark, str(folder)).collect()
    assert {r.key: r.size_bytes for r in rows} == walked(folder) and len(rows) == len(walked(folder))
    assert {r.key: r.extension for r in rows}["a/deep/y.TXT"] == ".txt" and {r.key: r.extension for r in rows}["zz/none"] == ""
    assert all(r.modified is not None and r.filename == r.key.rpartition("/")[2] for r in rows) and "content" not in rows[0]
    got = listing.files_of(spark, f"file://{folder}", content=True).collect()
    assert {r.key: len(r.content) for r in got} == walked(folder)
    assert listing.files_of(spark, str(tmp_path / "nowhere")).collect() == []


def test_options_are_applied_while_listing(spark, folder):
    want = walked(folder)
    for options, keep in (
        ({"extensions": [".txt"]}, lambda k, n: k.lower().endswith(".txt")),
        ({"extensions": [".txt", ".md"]}, lambda k, n: k.lower().endswith((".txt", ".md"))),
        ({"least": 11, "most": 50}, lambda k, n: 10 < n <= 50),
        ({"prefix": "a/de"}, lambda k, n: k.startswith("a/de")),
    ):
        files = listing.files_of(spark, str(folder), content=True, **options)
        assert {r.key for r in files.collect()} == {k for k, n in want.items() if keep(k, n)}
        assert {r.key for r in files.filter(F.col("size_bytes") > 20).collect()} == {k for k, n in want.items() if keep(k, n) and n > 20}
        assert {r.key for r in files.collect()} == {k for k, n in want.items() if keep(k, n)}  # a query leaves nothing behind for the next
    assert [p.folder for p in listing._Batch({"path": str(folder), "prefix": "a/de"}).partitions()] == ["", "a/"]


def test_key_order_and_ranges(folder):
    files, root = listing._store(str(folder))
    keys = [k for k, _ in listing._walk(files, root, listing.Prefix("", True))]
    assert keys == sorted(walked(folder)) and listing._last_key(files, root) == keys[-1]
    reading = listing._Reading({"path": str(folder)})
    for i, start in enumerate(["", *keys]):
        for j in range(i, len(keys) + 1):
            end = keys[j - 1] if j else ""
            got = [k for p in reading.prefixes(start, end) for k, _ in listing._walk(files, root, p)]
            assert sorted(got) == keys[i:j]


def test_a_stream_goes_on_after_the_last_key(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: streams.run_once(listing.new_files(spark, str(folder), content=True), out, state).awaitTermination()
    run()
    first = sorted(r.key for r in spark.read.parquet(out).collect())
    assert first == sorted(walked(folder))
    run()
    (folder / "zz" / "p.txt").write_text("more")
    (folder / "zzz").mkdir()
    (folder / "zzz" / "q.txt").write_text("and more")
    run()
    rows = {r.key: bytes(r.content) for r in spark.read.parquet(out).collect()}
    assert sorted(rows) == sorted(walked(folder)) and spark.read.parquet(out).count() == len(rows) and rows["zzz/q.txt"] == b"and more"
