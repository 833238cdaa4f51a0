"""Ranking, context, chunks, tables, files and streams on literal cases."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import acl
from lodestone.operators import bm25, chunking, context, evaluation, rank, sketches, substring, tables, vector, vector_index, visibility
from lodestone.sources import files, sinks, staging
from lodestone.streaming import streams


def test_bm25(spark):
    texts = spark.createDataFrame([(1, "маркировка товаров и учёт"), (2, "правила маркировки продукции"), (3, "дата 14.04.2026 приказа"), (4, ""), (5, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "маркировка"), (2, "14.04.2026"), (3, ""), (4, "маркировка маркировка")], "qid long, question string")
    found = bm25.search(texts, asked, 10).orderBy("qid", "rank").collect()
    assert {r.doc_id for r in found if r.qid == 1} == {1, 2} and [r.doc_id for r in found if r.qid == 2] == [3] and not [r for r in found if r.qid == 3]
    assert {r.doc_id: round(2 * r.score, 4) for r in found if r.qid == 1} == {r.doc_id: round(r.score, 4) for r in found if r.qid == 4}
    assert bm25.corpus_stats(texts.limit(0)).first().avgdl == 1.0


def ranked(spark, keys):
    return spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(keys)], "qid int, key string, rank int")


def test_fusion(spark):
    dense, sparse = ranked(spark, "abc"), ranked(spark, "bad")
    got = {r.key: r.score for r in rank.fuse([(dense, 1.0), (sparse, 1.0)], "qid", "key").collect()}
    assert set(sorted(got, key=got.get)[-2:]) == {"a", "b"} and set(got) == set("abcd") and got["a"] == round(1 / 61 + 1 / 62, 6)
    assert [r.key for r in rank.fuse([(dense, 1.0), (ranked(spark, "a").limit(0), 1.0)], "qid", "key").orderBy(F.desc("score")).collect()] == list("abc")
    assert rank.fuse([(ranked(spark, "aa"), 1.0)], "qid", "key").first().score == round(1 / 61, 6)
    assert {r.key: r.score for r in rank.fuse([(dense, 1.0), (sparse, 10.0)], "qid", "key").collect()}["b"] >= got["b"]


@pytest.mark.parametrize(("scores", "low", "gap", "want"), [([0.9, 0.3, 0.1], 0.5, 0, 1), ([1, 0.05, 0.01], 0, 0.1, 1), ([1, 0.8, 0.01], 0.5, 0.5, 2), ([-0.8, -0.2], -1, 0.5, 2)])
def test_thresholds(spark, scores, low, gap, want):
    df = spark.createDataFrame([(1, float(s)) for s in scores], "qid int, score double")
    assert rank.threshold(df, "qid", low, gap).count() == want


def test_citations(spark):
    df = spark.createDataFrame([("see [1] and [3]",), ("none",), ("[9]",), ("[99999999999]",)], "a string").select(rank.cited(F.col("a"), F.array(*map(F.lit, "abc"))).alias("s"))
    assert [r.s for r in df.collect()] == [["a", "c"], list("abc"), list("abc"), list("abc")]


def test_sources_and_context(spark):
    rows = spark.createDataFrame([(1, "a.pdf", 1, 0.2), (1, "a.pdf", 3, 0.9), (1, "a.pdf", 1, 0.1), (1, "b.pdf", 2, 0.5)], "qid int, source string, page int, score double")
    got = rank.by_source(rows, "qid").orderBy("rank").collect()
    assert [(r.source, r.pages, r.max_score) for r in got] == [("a.pdf", [1, 3], 0.9), ("b.pdf", [2], 0.5)]
    parts = spark.createDataFrame([(1, k, n * "x") for k, n in ((1, 50), (2, 40), (3, 100), (4, 5))], "qid int, rank int, part string")
    keep = lambda budget: [r["rank"] for r in context.within_budget(parts, "qid", F.length("part"), budget).orderBy("rank").collect()]
    assert [keep(b) for b in (1, 96, 95, 120, 300)] == [[1], [1, 2], [1], [1, 2], [1, 2, 3, 4]]
    assert context.joined(parts, "qid", "part").first().context.startswith("x" * 50 + "\n\n---\n\n")
    head = spark.range(1).select(context.header(F.lit(1), F.lit("d/report.pdf"), F.lit(3), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit("table"))).first()[0]
    assert head == "[1] report.pdf (таблица) (стр. 3)"


def _corpus(spark, n, seed=0):
    import random

    draw = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    text = lambda size: " ".join(words[min(299, int(draw.paretovariate(0.6)) - 1)] for _ in range(size))
    texts = [(k, text(draw.randint(1, 120))) for k in range(n)] + [(n, ""), (n + 1, None), (n + 2, "w1 w2"), (n + 3, "w1 w2")]
    asked = [(k, text(draw.randint(1, 12))) for k in range(25)] + [(90, "nothing known"), (91, ""), (92, "w1 w2"), (93, "w1 w1 w250")]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, question string")


def test_pruned_search_finds_what_scoring_all_finds(spark, tmp_path, monkeypatch):
    """Ranges of documents and the k-th score decide what is read; the result is that of every score."""
    monkeypatch.setattr(bm25, "RANGE_DOCS", 50)
    monkeypatch.setattr(bm25, "CHUNK_QUESTIONS", 8)  # several chunks of questions
    texts, asked = _corpus(spark, 700)
    index = bm25.Index.build(texts, str(tmp_path / "index"))
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())
    every = index.matches(asked).cache()
    assert rows(index.search(asked, 5)) == rows(bm25.best(every, 5)) == rows(bm25.search(texts, asked, 5))
    some = texts.filter("doc_id % 7 = 3").select("doc_id")
    assert rows(index.search(asked, 5, some)) == rows(bm25.best(index.matches(asked, some), 5))
    none = texts.filter("doc_id < 0").select("doc_id")
    assert index.search(asked, 5, none).collect() == [] and index.search(asked.filter("qid = 91"), 5).collect() == []
    shares = bm25.best(every.drop("score").withColumnRenamed("share", "score"), 5)
    want = {(r.qid, r.doc_id): r["rank"] for r in shares.collect()}
    assert {(r.qid, r.doc_id): r.dense for r in index.lists(asked, 5).filter("dense is not null").collect()} == want


def test_tokens_in_tasks_are_those_of_the_columns(spark):
    from lodestone.functions import tokens

    texts = ["Nations mention moment ёлки Ёлками ОСТИ радость Ärger İstanbul K2 \u212aelvin ß ǅ ΟΔΟΣ naïveness x 12 ab1ый ый1 tion action ление", "", "a", "слово словами 🙂слова\tтекст-ий ость гость able table"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in df.select("text", tokens.tokenize_raw(F.col("text")).alias("raw"), tokens.tokenize(F.col("text")).alias("stems")).collect():
        assert tokens.tokens_of(r.text) == r.raw and [tokens.stem_of(x) for x in r.raw] == r.stems


def test_index_sends_each_text_once(spark, tmp_path, monkeypatch):
    """Postings are packed: what a range has of a token is a few bytes a document, also for many repetitions and long texts."""
    monkeypatch.setattr(bm25, "RANGE_TOKENS", 4000)
    texts = spark.createDataFrame([(f"k{k}", "often " * (300 * k % 70_001) + f"rare{k} " * 2) for k in range(40)], "doc_id string, text string").repartition(4)
    index = bm25.Index.build(texts, str(tmp_path / "index"))
    rows = index.blocks.filter("token = 'often'")
    assert rows.agg(F.sum("n")).first()[0] == 39 and rows.filter("length(at) > n OR length(tf) > 4 * n").count() == 0
    held = index.holding(spark.createDataFrame([("often", 7), ("rare3", 8), ("none", 9)], "token string, mark int")).collect()
    assert {(r.mark, r.doc_id, r.tf, r.dl) for r in held} == {(7, f"k{k}", 300 * k, 300 * k + 2) for k in range(1, 40)} | {(8, "k3", 2, 902)}


def test_pruned_search_scores_few_documents(spark, sf_dir, tmp_path):
    docs, asked = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id as qid", "text as question")
    index = bm25.Index.build(docs.select("doc_id", "text"), str(tmp_path / "index"))
    work = index.work(asked, 1).first()
    assert work.finished < 0.1 * work.pairs and work.opened < 0.5 * work.pairs


def test_history(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"message {k}") for k in range(1, 20)] + [(2, 1, "user", "only")]
    got = context.recent_turns(spark.createDataFrame(rows, "c int, id int, role string, content string"), "c", "id", 8).orderBy("id").collect()
    assert [r.id for r in got] == list(range(11, 19))


@pytest.mark.parametrize(("s", "size", "overlap", "want"), [("abcdefghij", 4, 2, 5), ("x" * 25, 10, 3, 4), ("", 10, 3, 0), ("x" * 10, 10, 2, 2)])
def test_stride(spark, s, size, overlap, want):
    got = chunking.stride_chunks(spark.createDataFrame([(s,)], "text string"), size, overlap).orderBy("chunk_index").collect()
    assert len(got) == want and "".join(r.chunk[: size - overlap] for r in got)[: len(s)] == s
    with pytest.raises(ValueError, match="smaller"):
        chunking.stride_chunks(spark.createDataFrame([(s,)], "text string"), 5, 5)


def test_recursive_split(spark):
    cut = chunking.split_recursively
    assert len(cut("word " * 200, 900, 150, chunking.GENERAL)) > 1 and len(cut("A" * 500 + "\n\n" + "B" * 500, 600, 100, chunking.GENERAL)) >= 2
    assert cut("short", 550, 200, chunking.GENERAL) == ["short"] and cut("", 10, 2, chunking.GENERAL) == []
    assert all(len(c) <= 100 for c in cut("xyz " * 300 + "q" * 450, 100, 30, chunking.GENERAL))
    assert any("Статья 123" in c for c in cut("Вступление\nСтатья 123 " + "слово " * 300, 1000, 250, chunking.LEGAL))
    df = spark.createDataFrame([("table", "| a |\n" * 300), ("text", "| a |\n" * 300)], "content_type string, text string")
    counts = {r.content_type: r["count"] for r in chunking.recursive_chunks(df).groupBy("content_type").count().collect()}
    assert counts["table"] == 1 and counts["text"] > 1
    chunking.register_chunker(spark)
    df.createOrReplaceTempView("texts")
    assert spark.sql("SELECT chunk FROM texts, LATERAL chunk_text(text, 100, 20)").count() > 10


@pytest.mark.parametrize("letters", [1_000_000, 10_000_000])
def test_recursive_chunks_of_a_long_text(spark, letters):
    """The text is not repeated for its chunks: what leaves Python grows with the text, not with its square."""
    text = ("one sentence with several words in it. " * 14 + "\n\n") * (letters // 550)
    df = spark.createDataFrame([(1, text), (2, "short")], "id int, text string").withColumn("tag", F.lit("t"))
    got = chunking.recursive_chunks(df).groupBy("id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("all")).orderBy("id").collect()
    assert (got[0].n, got[0].longest <= 550) == (got[0].last + 1, True) and 0.9 * len(text) < got[0]["all"] < 2 * len(text)
    assert (got[1].n, got[1]["all"]) == (1, 5)
    assert chunking.recursive_chunks(df).columns == ["id", "tag", "chunk_index", "chunk"]


def test_islands_and_sections_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "# A\nx\n#  \n## B"), (5, "| t |"), (6, "\n".join("| r |" if k % 3 else f"line {k}" for k in range(20_000)))]
    df = spark.createDataFrame(rows, "id int, text string")
    assert [(r.id, r.kind) for r in chunking.islands(df.filter("id < 6"), "id").orderBy("id").collect()] == [(4, "text"), (5, "table")]
    counts = {r.kind: r["count"] for r in chunking.islands(df.filter("id = 6"), "id").groupBy("kind").count().collect()}
    assert counts == {"text": 6667, "table": 6667}
    got = [(r.id, r.section, r.heading, r.content) for r in chunking.sections(df.filter("id < 6"), "id").orderBy("id", "section").collect()]
    assert got == [(4, 1, "A", "x\n#"), (4, 2, "B", ""), (5, 0, None, "| t |")]
    plan = chunking.islands(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_islands_sections_pages(spark):
    df = spark.createDataFrame([(1, "intro\n| a | b |\n| - | - |\nafter\n\n| c |\nend")], "doc_id int, text string")
    assert [r.kind for r in chunking.islands(df, "doc_id").orderBy("segment").collect()] == ["text", "table", "text", "table", "text"]
    md = spark.createDataFrame([(1, "lead\n# One\nbody\n## Two\n\nmore\n### Empty")], "doc_id int, text string")
    assert [(r.heading, r.content) for r in chunking.sections(md, "doc_id").orderBy("section").collect()] == [(None, "lead"), ("One", "body"), ("Two", "more"), ("Empty", "")]
    pages = spark.createDataFrame([("a", 5, "five"), ("a", 1, "one"), ("a", 3, "three"), ("b", 2, "x")], "source string, page int, text string")
    got = chunking.merge_pages(pages).orderBy("source").first()
    assert (got.content, got.page_start, got.page_end, got.pages) == ("one\n\nthree\n\nfive", 1, 5, [1, 3, 5])


def test_tables(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 3, "c", True)], "k int, ts int, v string, gone boolean")
    assert [(r.k, r.v) for r in tables.latest(log, ["k"], ["ts"], "gone").collect()] == [(1, "b")]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in tables.upsert(a, b, ["k"]).collect()) == [(1, "x"), (2, "z"), (3, None)]
    assert sorted((r.k, r.missing_in) for r in tables.differences(a, b, "k").collect()) == [(1, "right"), (3, "left")]
    assert sorted(r.k for r in tables.append_new(a, b, "k").collect()) == [1, 2, 3] and tables.replace_groups(a, b, "k").count() == 3
    assert [(r.le, r.n) for r in tables.histogram(spark.createDataFrame([(1, 0.5), (1, 7.0), (1, None)], "k int, x double"), ["k"], "x", [1, 5]).collect()] == [(1.0, 1), (5.0, 1), (float("inf"), 2)]
    assert tables.health(spark.createDataFrame([("ok",), ("error: db",)], "status string")).first().overall == "degraded"


def test_evaluation(spark):
    found = spark.createDataFrame([(1, "B.pdf", 1, 0.5), (1, "a.pdf", 2, 0.4), (2, "x", 1, 0.3)], "qid int, source string, rank int, score double")
    asked = spark.createDataFrame([(1, "A.PDF"), (2, "zz"), (3, None), (4, "q")], "qid int, source_hint string")
    got = {r.qid: (r.hit_rate, r.mrr) for r in evaluation.retrieval_metrics(found, asked).collect()}
    assert got == {1: (1, 0.5), 2: (0, 0.0), 3: (None, None), 4: (0, 0.0)}
    space = {"a": {"values": [1, 2]}, "b": {"min": 0.1, "max": 0.3, "step": 0.1}}
    assert evaluation.grid(spark, space).count() == evaluation.grid_size(space) == 6
    drawn = evaluation.random_points(spark, space | {"c": {"min": 1, "max": 3}}, 50, 7)
    assert drawn.filter("b BETWEEN 0.1 AND 0.3 AND a IN (1, 2) AND c IN (1, 2, 3)").count() == 50
    assert evaluation.halved(drawn, "b", 1).count() == 25
    row = spark.createDataFrame([(1.0, 0.5, 8.0, None)], "hit_rate double, mrr double, faithfulness double, relevancy double")
    weights = {"hit_rate": 0.5, "mrr": 0.25, "faithfulness": 0.25, "relevancy": 1.0, "avg_similarity": 0.0}
    assert row.select(evaluation.composite(weights)).first()[0] == 0.825 and row.select(evaluation.composite({})).first()[0] == 0.0
    now, before = (spark.createDataFrame(v, "metric string, value double") for v in ([("hit_rate", 0.8), ("faithfulness", 7.0)], [("hit_rate", 0.9), ("faithfulness", 7.5)]))
    result = evaluation.compare(now, before, spark)
    assert {r.metric: r.failed for r in result.collect()} == {"hit_rate": True, "faithfulness": False, "relevancy": False, "correctness": False} and not evaluation.passed(result).first().passed


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    got = vector.cosine_top_k(df.filter("vec_id = 1"), df, 10).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (3, 0.0), (4, 0.0)]
    texts = spark.createDataFrame([("one two",), ("",), (None,)], "t string")
    assert [len(r[0]) for r in texts.select(vector.hashed_embedding(16)(F.col("t"))).collect()] == [16] * 3
    assert spark.range(1).select(vector.lexical_rerank(F.lit("a big cat"), F.lit("the CAT sat"))).first()[0] == 0.5


def test_cosine_blocks_are_not_broadcast(spark):
    """Blocks meet in a shuffle even where Spark finds them small, in several blocks and slices the result is that of all pairs."""
    import numpy as np

    draw = np.random.default_rng(3)
    v = np.round(draw.normal(size=(150, 4)), 1)
    v[100:] = v[:50]  # ties
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = vector.cosine_top_k(df.filter("vec_id % 4 = 0"), df, 6, block=16)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.round(u @ u.T, 6) + 0.0
    want = [(q, c, r + 1) for q in range(0, 150, 4) for r, c in enumerate(sorted(set(range(150)) - {q}, key=lambda c: (-scores[q, c], c))[:6])]
    assert sorted((r.qid, r.vec_id, r["rank"]) for r in got.collect()) == sorted(want)
    executed = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in executed


def test_cosine_slices(spark, monkeypatch):
    """The best of all slices, with ties, repeated keys and own rows in any of them; blocks grow with the table, as far as there is room."""
    import numpy as np

    draw = np.random.default_rng(5)
    c, q = (np.round(draw.normal(size=(n, 3)), 0) for n in (200, 40))
    ci, qi = np.sort(draw.integers(0, 120, 200)), draw.integers(0, 150, 40)
    for met, k in ((7, 5), (64, 5), (500, 5), (3, 8)):
        monkeypatch.setattr(vector, "MET", met)
        row, place, score = vector._nearest(qi, q, ci, c, k, 2)
        scores = np.round(q @ c.T, 2) + 0.0
        want = [(r, p, scores[r, p]) for r in range(40) for p in sorted((p for p in range(200) if ci[p] != qi[r]), key=lambda p: (-scores[r, p], p))[:k]]  # noqa: B023
        assert list(zip(row.tolist(), place.tolist(), score.tolist(), strict=True)) == want
    df = spark.range(150).selectExpr("id AS vec_id", "array(1.0F, 2.0F) AS embedding")
    assert [vector._blocks(df, "embedding", b) for b in (50, 16, 4)] == [3, 10, 15] and vector._blocks(df.limit(0), "embedding", 4) == 1
    monkeypatch.setattr(vector, "ROOM", 12)
    assert vector._blocks(df, "embedding", 4) == 25
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in vector.cosine_top_k(odd.filter("vec_id = 1"), odd, 2).orderBy("rank").collect()] == [(4, 0.707107), (2, 0.0)]


def test_vector_index(spark, tmp_path):
    """Equal to comparing everything, after additions, replacements and removals; on clusters few cells are visited."""
    import numpy as np

    draw = np.random.default_rng(7)
    centres = draw.normal(size=(20, 12))
    rows = [(k, (centres[k % 20] + 0.05 * draw.normal(size=12)).tolist(), k % 3 if k % 11 else None, k % 2) for k in range(900)] + [(900, [0.0] * 12, 1, 0), (901, None, 1, 0), (902, [], 1, 0), (None, [1.0] * 12, 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, who int, odd int").repartition(3)
    index = vector_index.VectorIndex.build(df.filter("vec_id < 600 OR vec_id IS NULL"), str(tmp_path / "i"), cells=20, parted_by=("who",), more=("odd",))
    index.add(df.filter("vec_id >= 500"))
    index.remove(df.filter("vec_id % 10 = 9"))
    asked, left = df.filter("vec_id % 25 = 0"), df.filter("vec_id % 10 <> 9")
    got = lambda x: sorted((r.qid, r["rank"], r.vec_id, r.score) for r in x.collect())
    assert got(index.search(asked, 5)) == got(vector.cosine_top_k(asked, left, 5))
    assert got(index.search(asked, 5, F.col("who").isin(0, 2), F.col("odd") == 1)) == got(vector.cosine_top_k(asked, left.filter("who IN (0, 2) AND odd = 1"), 5))
    assert got(index.search(asked, 5, F.col("who").isNull())) == got(vector.cosine_top_k(asked, left.filter("who IS NULL"), 5))
    work = index.visits(asked, 5).first()
    assert work.visited < 0.3 * work.cells
    assert got(vector_index.VectorIndex(spark, index.path, parted_by=("who",), more=("odd",)).search(asked, 5)) == got(index.search(asked, 5))
    empty = vector_index.VectorIndex.build(df.limit(0), str(tmp_path / "e"), parted_by=("who",))
    assert empty.search(asked, 5).collect() == []


@pytest.mark.parametrize("for_list", [True, False])
def test_bitmaps_see_what_the_rules_see(spark, tmp_path, for_list):
    kinds = ["internal_public", "internal_group", "internal_private", "client_private", None, "other"]
    docs = spark.createDataFrame([(k * 9001, kinds[k % 6], k % 7 if k % 6 in (2, 3) else None, k % 3 if k % 6 == 1 else None) for k in range(60)] + [(None, "internal_public", None, None)], "doc_id long, visibility string, owner_id long, group_id long").repartition(3)
    people = [(u, "client" if u % 3 == 0 else "internal", "admin" if u in (0, 1) else "user") for u in range(8)]
    users = spark.createDataFrame(people, "user_id long, kind string, role string")
    groups = {u: [u % 3, 2] for u in range(8)}
    members = spark.createDataFrame([(u, g) for u, gs in groups.items() for g in gs] + [(1, None)], "user_id long, group_id long")
    index = visibility.VisibleIndex.build(docs, str(tmp_path / "v"))
    who = visibility.holders(users, members, for_list)
    want = {u: {r.doc_id for r in docs.filter("doc_id IS NOT NULL").filter(acl.visible(kind, u, groups[u], for_list, role)).collect()} for u, kind, role in people}
    if for_list:  # in lists what a user owns as a client counts for every kind of user
        for u, *_ in people:
            want[u] |= {k * 9001 for k in range(60) if k % 6 == 3 and k % 7 == u}
    assert {r.user_id: r.n_visible for r in index.counts(who).collect()} == {u: len(d) for u, d in want.items() if d}
    pairs = users.select("user_id").join(docs.select("doc_id").filter("doc_id IS NOT NULL"))
    got = {}
    for r in index.allowed(pairs.withColumn("bucket", F.lit(1)), who).collect():
        got.setdefault(r.user_id, set()).add(r.doc_id)
    assert got == {u: d for u, d in want.items() if d}


def test_bitmaps_are_opened_for_sets_of_holders(spark, tmp_path):
    """A thousand users of five kinds open as many bitmaps as five users; owners open those of their own buckets."""
    docs = spark.range(40).select((F.col("id") * 32_768).alias("doc_id"), F.lit("internal_public").alias("visibility"), F.lit(None).cast("long").alias("owner_id"), F.lit(None).cast("long").alias("group_id"))
    own = spark.createDataFrame([(32_768 * 7, "internal_private", 3, None), (32_768 * 7 + 1, "internal_private", 3, None), (32_768 * 99, "client_private", 4, None), (5, "internal_group", None, 1)], docs.schema)
    users = spark.range(1000).select(F.col("id").alias("user_id"), F.lit("internal").alias("kind"), F.when(F.col("id") < 2, "admin").otherwise("user").alias("role"))
    members = spark.range(1000).select(F.col("id").alias("user_id"), (F.col("id") % 5).alias("group_id"))
    index = visibility.VisibleIndex.build(docs.unionByName(own), str(tmp_path / "v"))
    counted = index.counts(visibility.holders(users, members))
    got = {r.user_id: r.n_visible for r in counted.collect()}
    # the first of the two documents of user 3 has the number of a public one
    want = {u: 40 + (u % 5 == 1) + (u == 3) + (u == 4 or u < 2) for u in range(1000)}
    assert got == want
    walk, most = [counted._jdf.queryExecution().executedPlan()], 0
    while walk:
        node = walk.pop()
        walk += [node.children().apply(k) for k in range(node.children().size())] + ([node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [])
        if "bitmap_or_agg" in node.toString().splitlines()[0] and "numOutputRows" in str(node.metrics().keys()):
            most = max(most, node.metrics().apply("numOutputRows").value())
    assert 0 < most < 1000


def test_sketches_merge_within_their_errors(spark):
    """Hours merged into days and into one, against exact ranks and counts."""
    events = spark.range(40_000).select((F.col("id") % 3).alias("kind"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) ** 2).cast("double").alias("v"), (F.col("id") % 7001).alias("u"), F.timestamp_seconds(F.col("id") * 9).alias("ts")).repartition(5)
    hours = sketches.windows(events, ["kind"], "v", "u", "ts").cache()
    assert hours.count() == 300
    days = sketches.read(sketches.merged(hours, ["kind"], "day"), {"p50": 0.5, "p99": 0.99})
    assert days.count() == 15 and days.agg(F.sum("n")).first()[0] == 40_000
    one = sketches.read(sketches.merged(hours, []), {"p50": 0.5, "p99": 0.99}).first()
    assert one.n == 40_000 and abs(one.distinct / 7001 - 1) <= sketches.DISTINCT_ERROR
    for name, share in (("p50", 0.5), ("p99", 0.99)):
        assert abs(events.filter(F.col("v") <= one[name]).count() / 40_000 - share) <= sketches.RANK_ERROR + 1e-4
    assert abs(one["mean"] - events.agg(F.avg("v")).first()[0]) < 1e-3
    blank = spark.createDataFrame([(None, None, None)], "v double, u long, ts timestamp")
    got = sketches.read(sketches.merged(sketches.windows(blank, [], "v", "u", "ts"), []), {"p50": 0.5}).first()
    assert (got.n, got["mean"], got.p50, got.distinct) == (1, None, None, 0)
    assert sketches.read(sketches.windows(events.limit(0), ["kind"], "v", "u", "ts"), {"p50": 0.5}).collect() == []


def test_substring_index(spark, tmp_path):
    rows = [(1, "The Quick brown fox"), (2, "quickbrown"), (3, "k b and brown and uic"), (4, None), (5, ""), (6, "ab"), (7, "ΟΔΟΣ straße 🙂🙂🙂 x"), (8, "aaaa%_aaaa"), (9, "abcabcabd" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(1, "QUICK"), (2, "k brow"), (3, "🙂🙂"), (4, "🙂🙂🙂"), (5, "%_a"), (6, "abd"), (7, "zzz"), (8, "aaa"), (9, "bcabcabdabc"), (10, None), (11, "row")]
    parts = spark.createDataFrame([a for a in asked if a[0] != 3], "qid long, part string")
    want = sorted((q, d) for q, p in asked if p and q != 3 for d, t in rows if t and p.lower() in t.lower())
    index = substring.SubstringIndex.build(df, str(tmp_path / "i"))
    got = lambda x: sorted((r.qid, r.doc_id) for r in x.collect())
    assert got(index.search(df, parts)) == got(substring.find(df, parts)) == want
    # trigrams that stand elsewhere in a text do not make it a candidate
    assert got(index.candidates(parts.filter("qid = 2"))) == [(2, 1)]
    with pytest.raises(Exception, match="characters or more"):
        index.search(df, spark.createDataFrame([(3, "🙂🙂")], "qid long, part string")).collect()
    assert substring.SubstringIndex.build(df.limit(0), str(tmp_path / "e")).search(df, parts).collect() == []


def test_substrings_are_indexed_where_texts_are_read(spark, tmp_path, monkeypatch):
    """A row for each trigram and segment, not for each document; several segments in a task give the same."""
    texts = spark.createDataFrame([(f"k{k}", f"xabc{'abc' * (k % 5)} {k % 17:03d}y") for k in range(300)], "doc_id string, text string").repartition(2)
    parts = spark.createDataFrame([(1, "cabc "), (2, "ABC 01"), (3, "abc 016y"), (4, "q00")], "qid long, part string")
    want = sorted((q, r.doc_id) for q, p in [(1, "cabc "), (2, "abc 01"), (3, "abc 016y"), (4, "q00")] for r in texts.collect() if p in r.text)
    for size in (1 << 20, 200):
        monkeypatch.setattr(substring, "SEGMENT", size)
        index = substring.SubstringIndex.build(texts, str(tmp_path / str(size)))
        assert sorted((r.qid, r.doc_id) for r in index.search(texts, parts).collect()) == want
        assert index.counts.filter(F.col("gram") == (ord("a") << 42 | ord("b") << 21 | ord("c"))).first().df == 300
        if size > 200:
            assert index.grams.groupBy("gram").count().agg(F.max("count")).first()[0] <= 2


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{s}\"/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    body = para("Lead text of the document") + para("Part", "Heading1") + table + para("Body")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")


def test_files(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_bytes("Обычный текст документа \xff".encode("latin-1", "replace") + " длинный текст".encode())
    (src / "sub/b.md").write_text("# Title\n\nSome **bold** text that is long enough")
    (src / "c.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b world\b0\par caf\'e9 \u1087? and more text}")
    (src / "short.txt").write_text("tiny")
    (src / "e.pdf").write_bytes(b"%PDF")
    (src / "x.bin").write_bytes(b"no")
    docx(src / "d.docx")
    listed = files.listing(spark, str(src), content=True)
    assert listed.count() == 6
    parsed = {r.filename: r for r in files.parse(listed).collect()}
    assert parsed["b.md"].text == "Title\n\nSome bold text that is long enough" and parsed["short.txt"].error == "too_short" and parsed["e.pdf"].error == "unsupported"
    assert "Hello world\ncaf" in parsed["c.rtf"].text and "п" in parsed["c.rtf"].text and parsed["d.docx"].text.endswith("| a\\|b |  |\n| --- | --- |")
    assert files.docx_sections((src / "d.docx").read_bytes()) == [(None, "Lead text of the document"), ("Part", "Body"), (None, "| a\\|b |  |\n| --- | --- |")]
    assert files.parse(listed, {".pdf": lambda b: "recognised text, long enough"}).filter("filename = 'e.pdf'").first().text.startswith("recognised")
    chunks = files.parse(listed).filter("error IS NULL").select("filename", F.col("text").alias("content"))
    where = str(tmp_path / "registry")
    assert files.registry(spark, where).count() == 0
    sinks.write_registry(files.registry_entries(chunks, listed), where)
    assert sorted(r.filename for r in files.not_indexed(listed, files.registry(spark, where)).collect()) == ["e.pdf", "short.txt"]


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "a?"}, {"id": "2", "question": "  "}]))
    assert [r.id for r in files.questions(spark, str(tmp_path / "q.json")).collect()] == ["1"]
    (tmp_path / "h.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "dataset": "main", "metrics": {"mrr": 0.5}}\nnot json\n')
    assert files.history(spark, str(tmp_path / "h.jsonl")).count() == 1
    body = json.dumps({"data": [{"id": "x/B", "name": "b", "pricing": {"prompt": "0.000001", "completion": "bad"}}, {"id": "x/A", "name": "A", "pricing": None}]})
    assert [(r.name, r.prompt_price) for r in files.model_list(spark, body, "x/").collect()] == [("A", None), ("b", 1.0)]
    chunks = spark.createDataFrame([("t", "general", "p"), ("u", "legal", "q")], "content string, doc_domain string, visibility string")
    sinks.write_chunks(chunks, str(tmp_path / "chunks"), vector.hashed_embedding(4)(F.col("content")))
    assert spark.read.parquet(str(tmp_path / "chunks")).filter("doc_domain = 'legal'").first().content == "u"
    sinks.write_postings(spark.createDataFrame([(1, "aa bb aa")], "doc_id long, text string"), str(tmp_path / "postings"))
    assert spark.read.parquet(str(tmp_path / "postings")).filter("token = 'aa'").first().tf == 2
    sinks.write_report(spark.createDataFrame([("1", "q", 0.5)], "id string, question string, mrr double"), str(tmp_path / "report"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "report/csv")).columns == ["id", "question", "mrr"]


def test_live_index(spark, tmp_path):
    schema = T._parse_datatype_string("doc_id long, text string, deleted boolean, seq int")
    path = str(tmp_path / "index")
    index = streams.LiveIndex(spark, path, buckets=4)
    index.apply(spark.createDataFrame([(1, "aa bb aa", False, 1), (2, "bb cc", False, 1), (3, "cc", False, 1), (4, "alpha beta", False, 1), (4, "gamma delta", False, 2)], schema))
    assert {r.token: r.df for r in index.stats().collect()} == {"aa": 1, "bb": 2, "cc": 2, "gamma": 1, "delta": 1}
    index.apply(spark.createDataFrame([(1, "dd", False, 1), (3, None, True, 1), (9, None, True, 1), (4, "x", True, 2), (4, "late one", False, 1)], schema))
    want = {"bb": 1, "cc": 1, "dd": 1}
    assert {r.token: r.df for r in index.stats().collect()} == want
    again = streams.LiveIndex(spark, path, buckets=4)  # goes on from the stored version
    assert again.version == 2 and {r.token: r.df for r in again.stats().collect()} == want
    batch = spark.createDataFrame([(7, "ee", False, 1)], schema)
    for _ in range(2):  # a batch that is retried
        again.apply(batch, 2)
        assert {r.token: r.df for r in again.stats().collect()} == want | {"ee": 1}
    again.apply(spark.createDataFrame([(k, None, True, 1) for k in (1, 2, 7)], schema))
    assert again.stats().count() == 0
    again.rebuild(spark.createDataFrame([(1, "new start")], "doc_id long, text string"))
    assert {r.token: r.df for r in again.stats().collect()} == {"new": 1, "start": 1}
    assert sum(n.startswith("manifest-") for n in staging.children(spark, path)) == 2
    src = tmp_path / "changes"
    spark.createDataFrame([(4, "ee ee", False, 1)], schema).write.parquet(str(src))
    follower = streams.LiveIndex(spark, str(tmp_path / "followed"))
    follower.follow(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.token, r.tf) for r in follower.postings().collect()] == [("ee", 2)]


def test_live_config(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    table = spark.createDataFrame([("a", '["x", "y"]'), ("b", "7"), ("c", "big")], "key string, value string")
    src, schema = str(tmp_path / "log"), "key string, value string, ts timestamp, oversize boolean"
    spark.createDataFrame([("a", '["x","y"]', at(1), False), ("b", "5", at(2), False), ("b", "6", at(1), False), ("c", None, at(1), True), ("gone", None, at(1), True)], schema).write.parquet(src)
    config = streams.LiveConfig(spark, str(tmp_path / "config"))
    config.follow(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "cp")).awaitTermination(60)
    assert {r.key: r.value for r in config.current().collect()} == {"a": '["x","y"]', "b": "5", "c": "big"}
    assert [(r.key, r.value) for r in streams.out_of_step(config.current(), table).collect()] == [("b", "7")]
    config.resync(table.filter("key != 'c'"), F.lit("2024-01-02").cast("timestamp"))
    assert {r.key: r.value for r in streams.LiveConfig(spark, str(tmp_path / "config")).current().collect()} == {"a": '["x","y"]', "b": "7"}


def test_rebuilds_progress_and_renewal(spark):
    import datetime as dt

    now = F.lit("2024-01-02 02:00:00").cast("timestamp")
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3, 0),), (dt.datetime(2024, 1, 1, 2, 59),), (None,)], "t timestamp")
    assert [r[0] for r in rows.select(streams.rebuild_due(F.col("t"), now)).collect()] == [False, True, True]
    done = spark.createDataFrame([(1, 0.4), (2, 0.6)], "config_id int, composite double")
    assert streams.sweep_progress(done, 3).first()[:] == (2, 66.7, 0.6, False) and streams.sweep_progress(done, 2).first().done
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    entries = spark.createDataFrame([("a", at(0)), ("b", at(0))], "key string, written timestamp")
    hits = spark.createDataFrame([("a", at(4)), ("a", at(8)), ("a", at(20)), ("b", at(5)), ("c", at(1))], "key string, ts timestamp")
    got = {r.key: (r.hits, r.expires_at) for r in streams.renewed(entries, hits, "key", "written", "ts", 300).collect()}
    assert got == {"a": (2, at(13)), "b": (0, at(5))}


def test_streams_equal_batches(spark, tmp_path, sf_dir):
    src = str(tmp_path / "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    seen = streams.first_seen(stream, "event_id", "ts", "1 day")
    streams.run_once(seen, str(tmp_path / "seen"), str(tmp_path / "cp1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "seen")).count() == events.count()
    windows = streams.rate_windows(stream, "user_id", "ts", 1, late="1 hour")
    streams.run_once(windows, str(tmp_path / "rates"), str(tmp_path / "cp2")).awaitTermination(90)
    got, want = spark.read.parquet(str(tmp_path / "rates")), streams.rate_windows(events, "user_id", "ts", 1)
    assert got.exceptAll(want).count() == 0 and got.count() > 0.9 * want.count()


def test_ingest_stream(spark, tmp_path):
    src = tmp_path / "files"
    src.mkdir()
    (src / "a.txt").write_text("the first document of all")
    go = lambda: streams.ingest_files(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), lambda f: f.select("path", F.col("content").cast("string").alias("text"))).awaitTermination(60)
    go()
    (src / "b.txt").write_text("the second document")
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_cache(spark):
    cache = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, None)], "id int, document_ids array<int>")
    assert sorted(r.id for r in streams.invalidated(cache, 2).collect()) == [2, 3]


def test_orphan_alerts(spark, tmp_path):
    import datetime as dt

    schema = T._parse_datatype_string("job_id long, status string, ts timestamp")
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    src = str(tmp_path / "jobs")
    for batch in ([(1, "running", at(0, 0)), (2, "running", at(0, 0))], [(2, "done", at(0, 5)), (3, "running", at(1, 0))], [(4, "pending", at(3, 0))], [(5, "pending", at(4, 0))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.run_once(streams.orphan_alerts(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    assert {r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3}
