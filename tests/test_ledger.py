"""The journal of model calls: what is asked, how often, and what outlives a task that fails."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation
from lodestone.sources import ledger
from lodestone.sources.ledger import Ledger


def counting(folder, fails=None):
    """A model that notes each call in a file of its own process and fails where ``fails`` has a marker that it can take away."""

    def model(kind, prompt):
        number = sum(map(ord, prompt))
        if fails is not None and number % 2 == 0:
            marker = f"{fails}/{number % 8}"
            if not os.path.exists(marker):
                open(marker, "w").close()
                raise ConnectionError(prompt)
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(f"{kind}|{prompt}\n")
        return f"{kind} of {prompt}"

    return model


def calls(folder):
    return collections.Counter(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().splitlines())


@pytest.fixture
def places(tmp_path):
    for name in ("calls", "fails"):
        (tmp_path / name).mkdir()
    return f"file://{tmp_path}/journal", str(tmp_path / "calls"), str(tmp_path / "fails")


def test_each_distinct_call_is_made_once(spark, places):
    path, noted, _ = places
    rows = [(k, f"kind{k % 2}", f"prompt {k % 20}", "old") for k in range(100)] + [(100, None, "p", "old"), (101, "kind0", None, "old"), (102, "kind0", "", "old")]
    prompts = spark.createDataFrame(rows, "id long, kind string, prompt string, reply string")
    got = {r.id: r.reply for r in Ledger(spark, path, 8).ask(prompts, counting(noted)).collect()}
    assert got == {k: f"{kind} of {p}" if kind is not None and p is not None else None for k, kind, p, _ in rows}
    assert len(calls(noted)) == 21 and set(calls(noted).values()) == {1}
    more = prompts.unionByName(spark.createDataFrame([(200, "kind0", "another", "old")], prompts.schema))
    assert Ledger(spark, path, 8).ask(more, counting(noted)).count() == 104
    assert len(calls(noted)) == 22 and set(calls(noted).values()) == {1}
    assert Ledger(spark, path, 8).ask(prompts.limit(0), counting(noted)).collect() == []


def test_kind_and_prompt_are_kept_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a", "b:c"), ("a:b", "c")], "kind string, prompt string")
    assert df.select(ledger.call_id().alias("c")).distinct().count() == 4


def test_a_failed_run_loses_no_reply(spark, places):
    """Tasks fail on half of the prompts, the run is started again until it ends, and no call whose reply was written is made twice."""
    path, noted, fails = places
    prompts = spark.range(120).select(F.lit("judge").alias("kind"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    failed = 0
    for _ in range(12):
        try:
            got = Ledger(spark, path, 8).ask(prompts, counting(noted, fails), retries=1).collect()
            break
        except Exception:
            failed += 1
    assert failed >= 1 and len(got) == 120 and all(r.reply == f"judge of {r.prompt}" for r in got)
    made = calls(noted)
    # tasks that were stopped with the run may not have written their last file
    assert len(made) == 120 and sum(made.values()) <= 120 + 4 * ledger.CALLS_A_FILE * failed
    assert Ledger(spark, path, 8).ask(prompts, counting(noted), retries=1).count() == 120 and calls(noted) == made


def test_a_file_that_is_not_whole_is_not_read(spark, places, tmp_path):
    path, noted, _ = places
    prompts = spark.createDataFrame([("k", "p")], "kind string, prompt string")
    folder = tmp_path / "journal" / "3"
    folder.mkdir(parents=True)
    (folder / ".half").write_text('{"call": "')
    assert [r.reply for r in Ledger(spark, path, 8).ask(prompts, counting(noted)).collect()] == ["k of p"]


def test_judged_with_a_journal(spark, places):
    path, noted, _ = places
    answers = spark.createDataFrame([(1, "q", "a", "e"), (2, "q", "a", None)], "id long, question string, answer string, expected_answer string")
    note = counting(noted)

    def judge(kind, prompt):
        note(kind, prompt)
        return '{"score": 7, "reason": "fine"}'

    first = {r.id: r.asDict() for r in evaluation.judged_once(answers, Ledger(spark, path, 8), judge).collect()}
    direct = {r.id: r.asDict() for r in evaluation.judged(answers, lambda m, r: '{"score": 7, "reason": "fine"}').collect()}
    assert first == direct
    made = sum(calls(noted).values())
    evaluation.judged_once(answers, Ledger(spark, path, 8), judge).collect()
    assert sum(calls(noted).values()) == made == 5
