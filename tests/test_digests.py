"""Comparison by digests against a comparison of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import digests, tables
from lodestone.operators.digests import DigestTree

SCHEMA = "id long, a string, b int"


def changed_copy(rows, share, seed):
    """Rows of which a share is left out, changed or put in."""
    draw, out = random.Random(seed), []
    for k, a, b in rows:
        u = draw.random()
        if u < share / 3:
            continue
        out.append((k, a, b) if u > share else (k, a, None if b is not None else 1))
    return out + [(10**6 + k, "new", k) for k in range(int(len(rows) * share / 3))]


def by_hand(left, right):
    l, r = ({k: {x[1:] for x in rows if x[0] == k} for k in {x[0] for x in rows} - {None}} for rows in (left, right))
    out = {k: "left" if k not in l else "right" if k not in r else "changed" for k in l.keys() | r.keys() if l.get(k) != r.get(k)}
    return sorted(out.items())


def test_equals_a_comparison_of_all_rows(spark):
    rows = [(k, None if k % 7 == 0 else f"t{k % 13}", None if k % 5 == 0 else k % 3) for k in range(300)]
    other = [*changed_copy(rows, 0.2, 1), (5, "t5", 9), (6, *rows[6][1:]), (None, "x", 1), (None, "x", 1)]
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA)
    assert sorted(map(tuple, digests.reconcile(left, right, "id", ["a", "b"]).collect())) == by_hand(rows, other)
    ids = digests.reconcile(left, right, "id").withColumnRenamed("difference", "missing_in")
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, tables.differences(left, right.filter("id IS NOT NULL"), "id").collect()))


def test_a_null_is_not_an_empty_place(spark):
    left, right = (spark.createDataFrame([(1, *x)], "id long, a string, b string") for x in ((None, "v"), ("v", None)))
    assert [tuple(r) for r in digests.reconcile(left, right, "id", ["a", "b"]).collect()] == [(1, "changed")]
    assert digests.reconcile(left, left, "id", ["a", "b"]).collect() == []


@pytest.mark.parametrize("empty", ["left", "right", "both"])
def test_empty_tables(spark, empty):
    some, none = spark.createDataFrame([(k, "t", k) for k in range(40)], SCHEMA), spark.createDataFrame([], SCHEMA)
    left, right = none if empty != "right" else some, none if empty != "left" else some
    got = digests.reconcile(left, right, "id", ["a"]).groupBy("difference").count().collect()
    assert [tuple(r) for r in got] == ([] if empty == "both" else [(empty, 40)])


def test_few_differences_move_few_rows(spark, tmp_path):
    """With 0.1 % differences under 5 % of the rows are taken up; a tree that follows changes equals one that is built again."""
    base = spark.range(200_000).select("id", F.hash("id").cast("string").alias("a"))
    differs = F.col("id") % 1000 == 7
    other = base.withColumn("a", F.when(differs, "other").otherwise(F.col("a")))
    left = DigestTree.build(base, "id", ["a"], str(tmp_path / "left"))
    right = left.changed(str(tmp_path / "right"), "id", ["a"], added=other.filter(differs), removed=base.filter(differs))
    again = DigestTree.build(other, "id", ["a"], str(tmp_path / "again"), left.bits)
    bits, none = right.differing(again)
    assert none.count() == 0
    bits, found = left.differing(right)
    assert 0 < digests.candidates(base, "id", bits, found).count() < 0.05 * 200_000
    got = digests.reconcile(base, other, "id", ["a"], (left, right))
    assert sorted(map(tuple, got.collect())) == [(k, "changed") for k in range(7, 200_000, 1000)]


def test_trees_of_different_depth(spark, tmp_path):
    small, large = spark.range(50).select("id"), spark.range(40_000).select("id")
    trees = tuple(DigestTree.build(df, "id", [], str(tmp_path / name)) for name, df in (("small", small), ("large", large)))
    assert trees[0].bits < trees[1].bits
    assert digests.reconcile(small, large, "id", None, trees).groupBy("difference").count().collect() == [("left", 39_950)]
    same = DigestTree.build(small, "id", [], str(tmp_path / "deep"), 20)
    assert trees[0].differing(same)[1].count() == 0


def test_many_leaves_are_joined_by_a_shuffle(spark, monkeypatch):
    left, right = spark.range(3000).select("id"), spark.range(1000, 4000).select("id")
    want = sorted(map(tuple, digests.reconcile(left, right, "id").collect()))
    monkeypatch.setattr(digests, "BROADCAST_LEAVES", 3)
    assert sorted(map(tuple, digests.reconcile(left, right, "id").collect())) == want and len(want) == 2000
