"""Literal cases of the service's further operators, and the chunkers against a brute-force version."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import acl, policy
from lodestone.operators import bm25, chunking, context, evaluation, rank, tables, vector
from lodestone.plans import answer, catalogue, service  # noqa: F401  both register their queries
from lodestone.plans.derived import Tables, phrase_join
from lodestone.plans.registry import QUERIES
from lodestone.sources import database, files, pages, sinks, staging
from lodestone.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_index_equals_a_search_without_one(spark, tmp_path):
    texts = spark.createDataFrame([(1, "aa bb aa cc"), (2, "bb cc dd"), (3, None), (4, "aa " * 40), (5, "ee ff"), (6, "aa bb aa cc")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "aa bb"), (2, "bb bb zz"), (3, ""), (4, "zz")], "qid long, question string")
    index = bm25.Index.build(texts, str(tmp_path / "index"))
    assert (index.n_docs, index.avgdl) == (6, (4 + 3 + 0 + 40 + 2 + 4) / 6)
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert rows(bm25.Index(spark, str(tmp_path / "index")).search(asked, 3)) == rows(bm25.search(texts, asked, 3))
    allowed = spark.createDataFrame([(2,), (4,)], "doc_id long")
    assert {r.doc_id for r in index.search(asked, 3, allowed).collect()} == {2, 4}
    hybrid = answer.hybrid(index, asked)
    assert {r.doc_id for r in hybrid.filter("qid = 1").collect()} == {1, 2, 4}  # 6 has the text of 1
    dense = spark.createDataFrame([(1, 5, 1), (1, 2, 2)], "qid long, doc_id long, rank int")
    assert [r.doc_id for r in answer.hybrid(index, asked, dense=dense).filter("qid = 1").orderBy("rank").limit(2).collect()] == [2, 5]
    docs = texts.withColumn("source", F.lit("s"))
    probes = spark.createDataFrame([(1, "bb cc"), (2, "a bb a"), (3, "b cc d"), (4, "x zz y"), (5, "c")], "qid long, probe string")
    assert sorted((r.qid, r.doc_id) for r in phrase_join(index, docs, probes).collect()) == [(1, 2), (2, 1), (2, 6), (3, 2), (5, 1), (5, 2), (5, 6)]
    empty = bm25.Index.build(texts.limit(0), str(tmp_path / "empty"))
    assert (empty.n_docs, empty.avgdl) == (0, 1.0) and empty.search(asked, 3).count() == 0


def _met_by_shuffle(df, column):
    """Whether a join by ``column`` shuffles its sides, in the plan that ran."""
    df.collect()
    return f"SortMergeJoin [{column}#" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # less than the documents of the smallest tables
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_phrases_go_to_the_texts(spark, sf_dir, small_broadcasts):
    t = Tables(spark, sf_dir)
    assert not _met_by_shuffle(t.questions, "doc_id")
    hits = phrase_join(t.index, t.documents.select("doc_id", "text", "source"), t.benchmark.selectExpr("item_id AS qid", "text AS probe"))
    assert hits.count() == t.documents.join(t.benchmark.select(F.col("text").alias("probe")), F.contains("text", F.col("probe"))).count() > 0


@pytest.mark.parametrize("name", ["rerank_lexical", "answer_context", "source_flags", "context_budget", "rerank_search"])
def test_candidates_go_to_the_documents(spark, sf_dir, small_broadcasts, name):
    assert not _met_by_shuffle(QUERIES[name](spark, sf_dir), "doc_id")


def test_a_sweep_takes_sources_of_listed_keys_only(spark):
    places = spark.createDataFrame([(1, 5, 1, 2), (1, 6, None, 1)], "qid long, key long, dense int, sparse int")
    configs = spark.createDataFrame([(0, 5.0, 5.0, 30.0, 1.0, 1.0)], "config_id int, fetch_k double, top_k double, rrf_k double, dense_weight double, sparse_weight double")
    asked = spark.createDataFrame([(1, "b"), (2, None)], "qid long, source_hint string")
    sources = spark.createDataFrame([(5, "a"), (6, "b"), (7, "b"), (6, "b2")], "key long, source string")
    df = evaluation.sweep(places, ["dense", "sparse"], configs, asked, sources)
    assert [tuple(r) for r in df.collect()] == [(0, 1.0, 0.5)]
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()


def test_scalars(spark):
    key = lambda owner, group: one(spark, policy.storage_key(F.lit(owner), F.lit(group), F.lit(7), F.lit("../x/a b.pdf")))
    assert [key(3, 4), key(None, 4), key(None, None)] == ["uploads/users/3/7_a b.pdf", "uploads/groups/4/7_a b.pdf", "uploads/public/7_a b.pdf"]
    same = lambda a, b: one(spark, policy.same_config(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert same('["ru", "en"]', '["ru","en"]') and same('{"a": 1, "b": 2}', '{"b":2,"a":1}') and same("1", "1.0") and same("true", "true") and same("plain", '"plain"') and same("plain", "plain") and same(None, None)
    assert not same('["ru","en"]', '["en","ru"]') and not same("1", "2") and not same(None, "1") and not same("plain", "other") and not same("true", "false")
    raw = policy.KEY_PREFIX + "abcdefghij"
    assert one(spark, policy.key_display(F.lit(raw))) == policy.KEY_PREFIX + "abcdef" and len(one(spark, policy.key_hash(F.lit(raw)))) == 64
    assert [one(spark, policy.chat_role(F.lit(r))) for r in ("user", "assistant", "system")] == ["human", "ai", "ai"]
    got = one(spark, policy.extraction_quality(F.lit(10), F.lit(7), F.lit(2), F.lit(1)))
    assert got[:] == (3, 1, 0.4, True) and one(spark, policy.extraction_quality(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))[:] == (0, 0, 0.0, False)


def test_domains_and_questions(spark):
    docs = spark.createDataFrame([(1, acl.PUBLIC, "legal"), (2, acl.PUBLIC, None), (3, acl.CLIENT, "legal")], "doc_id int, visibility string, doc_domain string").withColumns({"owner_id": F.lit(9), "group_id": F.lit(1)})
    assert [r.doc_id for r in docs.filter(acl.in_domain(acl.visible("internal", 2, []), "legal")).collect()] == [1]
    bank = spark.createDataFrame([(1, "What?", "yes", None, "main", ["a", "b"], True), (2, "why", None, "what else", "main", None, False)], "id long, question string, expected_answer string, notes string, dataset string, tags array<string>, is_active boolean")
    ids = lambda **how: [r.id for r in bank.filter(tables.question_filter(**how)).orderBy("id").collect()]
    assert ids() == ids(dataset="main") == ids(search="WHAT") == [1, 2] and ids(tag="b") == ids(is_active=True) == ids(search="yes") == [1] and ids(tag="a", is_active=False) == []


def test_question_import_and_export(spark, tmp_path):
    bank = spark.createDataFrame([(4, "old", "main", ["t"])], "id long, question string, dataset string, tags array<string>")
    new = spark.createDataFrame([("b",), (" ",), ("a",)], "question string")
    assert [(r.id, r.question, r.dataset, r.tags) for r in sinks.import_questions(bank, new).orderBy("id").collect()] == [(4, "old", "main", ["t"]), (5, "a", "main", None), (6, "b", "main", None)]
    assert sinks.import_questions(bank, new, only_if_empty=True).count() == 1 and sinks.import_questions(bank.limit(0), new, only_if_empty=True).count() == 2
    sinks.export_questions(bank, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).columns == ["dataset", "question", "tags"]
    assert [r.question for r in tables.first_non_empty(bank.select("question"), new).collect()] == ["old"] and tables.first_non_empty(bank.limit(0).select("question"), new).count() == 3
    sinks.write_grid(spark.createDataFrame([(1, 0.2), (2, 0.9)], "config_id int, composite double"), str(tmp_path / "g"))
    assert json.loads(next((tmp_path / "g").glob("*.json")).read_text().split("\n")[0])["config_id"] == 2


def test_collection(spark, tmp_path):
    store = sinks.Collection(spark, str(tmp_path / "c"))
    store.ensure(4)
    chunks = spark.createDataFrame([(1, "t", "general", "p"), (1, "u", "legal", "q"), (2, "t", "general", "p")], "document_id long, content string, doc_domain string, visibility string")
    embed = vector.hashed_embedding(4)(F.col("content"))
    store.upsert(chunks, embed)
    store.upsert(chunks, embed)
    assert store.read().count() == 3 and sorted(r.document_id for r in store.document_ids().collect()) == [1, 2]
    store.delete(spark.createDataFrame([(1,)], "document_id long"))
    assert [r.document_id for r in store.read().collect()] == [2]
    with pytest.raises(ValueError, match="have 4"):
        store.ensure(5)
    with pytest.raises(Exception, match="another length"):
        store.upsert(chunks, vector.hashed_embedding(3)(F.col("content")))
    store.ensure(5, reset=True)
    assert store.dims() == 5 and not staging.exists(spark, str(tmp_path / "c/chunks"))


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    base = database.Database(spark, url, [url, url], driver="org.apache.derby.jdbc.EmbeddedDriver")
    rows = spark.range(100).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    base.write(rows, "things", "overwrite")
    got = base.read("things", key="id", parts=4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100 and base.read("things").filter("id = 7").first().name == "n7"
    base.write(rows.limit(0), "nothing", "overwrite")
    assert base.read("nothing", key="id").count() == 0


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], "k int, v string, n int")
    change = spark.createDataFrame([(1, 1, "x", None), (1, 2, None, 9), (1, 3, "y", None), (8, 1, "no", 1)], "k int, seq int, v string, n int")
    assert sorted(r[:] for r in tables.patch(base, change, "k", "seq").collect()) == [(1, "y", 9), (2, "b", 2), (3, "c", None)]
    log = spark.createDataFrame([(1, "z", 5, 1, False), (2, None, None, 1, True), (2, None, None, 0, False), (4, "new", 4, 1, None)], "k int, v string, n int, seq int, deleted boolean")
    assert sorted(r[:] for r in tables.apply_log(base, log, "k", "seq").select("k", "v").collect()) == [(1, "z"), (3, "c"), (4, "new")]
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame([("a", "create", at(1)), ("a", "use", at(2)), ("b", "create", at(1)), ("b", "revoke", at(3)), ("c", "create", at(1)), ("c", "revoke", at(2)), ("c", "create", at(4)), ("d", "use", at(1))], "k string, kind string, ts timestamp")
    assert {r.k: r.is_active for r in tables.lifecycle(events, "k", "kind", "ts").collect()} == {"a": True, "b": False, "c": True, "d": False}
    names = spark.createDataFrame([(k, "a.txt" if k % 3 else "b") for k in range(100)] + [(200, None)], "id long, name string").repartition(3)
    got = {r.id: r.unique_name for r in tables.unique_names(names, "name", "id", ranges=7).collect()}
    assert got[0] == "b" and got[3] == "b (1)" and got[1] == "a.txt" and got[98] == "a (65).txt" and got[200] is None and len(set(got.values())) == 101


def test_pages(spark):
    blocks = spark.createDataFrame([("a", 1, 50.0, 11.0, "right"), ("a", 1, 5.0, 12.0, "left"), ("a", 1, 0.0, 90.0, "below"), ("a", 2, 0.0, 0.0, "x"), ("a", 3, 0.0, 0.0, "hidden by its table")], "path string, page int, x double, y double, text string")
    texts = pages.page_texts(blocks)
    assert {r.page: r.text for r in texts.collect()} == {1: "left\nright\nbelow", 2: "x", 3: "hidden by its table"}
    grid = spark.createDataFrame([("a", 3, 1, [["h", "a|b"], ["c\nd"], ["e", None]]), ("a", 5, 1, [])], "path string, page int, nth int, cells array<array<string>>")
    seen = spark.createDataFrame([("a", 2, "much longer"), ("a", 4, "scanned"), ("a", 1, "ignored, as the page has text of its own")], "path string, page int, text string")
    got = {(r.page, r.content_type): r.text for r in pages.assembled(texts, grid, seen, least_chars=10).collect()}
    assert got == {(1, "text"): "left\nright\nbelow", (2, "text"): "much longer", (3, "table"): "| h | a\\|b |\n| --- | --- |\n| c d |  |\n| e |  |", (4, "text"): "scanned"}
    assert one(spark, pages.wants_recognition(F.lit("  x "))) and not one(spark, pages.wants_recognition(F.lit("x"), enabled=False))


def test_docx_pages_lists_and_images():
    w, wp = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
    p = lambda text, inner="", before="": f"<w:p>{inner}<w:r>{before}<w:t>{text}</w:t></w:r></w:p>"
    item = lambda level: f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/></w:numPr></w:pPr>'
    image = '<w:p><w:r><w:drawing><wp:inline><wp:docPr id="1" descr=" a chart "/></wp:inline></w:drawing></w:r></w:p>'
    body = p("one") + p("deep", item(2)) + p("", before='<w:br w:type="page"/>') + p("two", before='<w:br w:type="page"/>') + image
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:wp="{wp}"><w:body>{body}</w:body></w:document>')
    assert files.docx_pages(raw.getvalue()) == (1, 3, [1, 3])
    assert [b.text for b in files.docx_blocks(raw.getvalue()) if b.text] == ["one", "    - deep", "two", "[image: a chart]"]


def test_sweeps_and_judges(spark):
    space = {"fetch_k": {"values": [2, 3]}, "top_k": {"default": 2}, "rrf_k": {"values": [60]}, "a_weight": {"values": [1.0]}, "b_weight": {"values": [0.0, 1.0]}}
    configs = evaluation.grid(spark, space)
    places = spark.createDataFrame([(1, "x", 1, None), (1, "y", 2, 1), (1, "z", 3, None), (2, "x", None, 3)], "qid int, key string, a int, b int")
    asked, sources = spark.createDataFrame([(1, "Y"), (2, "x"), (3, None)], "qid int, source_hint string"), spark.createDataFrame([("x", "x"), ("y", "y"), ("z", "z")], "key string, source string")
    got = {r.config_id: (r.hit_rate, r.mrr) for r in evaluation.sweep(places, ["a", "b"], configs, asked, sources).collect()}
    assert got == {0: (0.5, 0.25), 1: (0.5, 0.5), 2: (1.0, 0.75), 3: (1.0, 1.0)}
    assert evaluation.sweep(places, ["a", "b"], configs, asked, sources, skip_unhinted=False).filter("config_id = 3").first().hit_rate == 0.667
    scored = spark.createDataFrame([(k, k / 10, 0.0) for k in range(5)], "config_id int, hit_rate double, mrr double")
    judge = lambda df: df.withColumn("faithfulness", 10 - 10 * F.col("hit_rate")).withColumn("relevancy", F.lit(None).cast("double"))
    order = evaluation.two_phases(scored, {"hit_rate": 0.5, "faithfulness": 1.0}, 2, judge).orderBy("place").collect()
    assert [(r.config_id, r.judged) for r in order] == [(3, True), (4, True), (2, False), (1, False), (0, False)]
    found = spark.createDataFrame([(1, "a", "A", 0.9), (1, "b", "B", 0.5), (2, "c", "C", -1.0), (2, "d", "D", -2.0)], "qid int, key string, source string, score double")
    params = spark.createDataFrame([(0, 2, -5.0, 0.0), (1, 1, -5.0, 0.0), (2, 2, -5.0, 0.9), (3, 2, 5.0, 0.0)], "param_id int, top_k int, min_score double, gap_ratio double")
    hints = spark.createDataFrame([(1, "b"), (2, "d")], "qid int, source_hint string")
    assert {r.param_id: r.hit_rate for r in evaluation.search_rerank(found, params, hints).collect()} == {0: 1.0, 1: 0.0, 2: 0.5, 3: 0.0}
    answers = spark.createDataFrame([("q", "a", None), ("q", "a", "e")], "question string, answer string, expected_answer string")
    calls = {"n": 0}

    def model(metric, row):
        calls["n"] += 1
        if calls["n"] % 2:
            raise OSError("busy")
        return f'so: {{"score": {len(metric)}, "reason": "{row["answer"]}"}}'

    rows = evaluation.judged(answers, model).collect()
    assert [(r.faithfulness, r.relevancy, r.correctness, r.correctness_reason) for r in rows] == [(10.0, 9.0, None, None), (10.0, 9.0, 10.0, "a")]


def test_older_turns_and_ordered_articles(spark):
    rows = spark.createDataFrame([(1, k, "user", f"m{k}") for k in range(5)], "c int, id int, role string, content string")
    assert context.transcript(context.older_turns(rows, "c", "id", 3), "c").first().transcript == "User: m0\nUser: m1"
    marks = spark.createDataFrame([(2, "b"), (1, "a"), (3, "b"), (4, None)], "at int, article string")
    assert marks.filter("article IS NOT NULL").agg(rank.ordered_unique("article", "at").alias("x")).first().x == ["a", "b"]
    config = spark.createDataFrame([("a", None, dt.datetime(2024, 1, 1), True)], "key string, value string, ts timestamp, oversize boolean")
    assert streams.refetched(config, spark.createDataFrame([("b", "1")], "key string, value string")).count() == 0


def test_pairs_and_appends(spark, tmp_path):
    said, log = spark.createDataFrame([(1, "answer", None)], "id long, content string, at timestamp"), spark.createDataFrame([(1, 0.5)], "id long, latency double")
    for _ in range(2):
        sinks.append_together({"message": said, "log": log}, str(tmp_path / "both"))
    got = sinks.read_kind(spark, str(tmp_path / "both"), "message", "id long, content string, at timestamp")
    assert [r[:] for r in got.collect()] == [(1, "answer", None)] * 2 and sinks.read_kind(spark, str(tmp_path / "both"), "log", "id long, latency double").count() == 2
    sinks.append_rows(log, str(tmp_path / "rows"))
    sinks.append_rows(log, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2
    summary = spark.createDataFrame([("main", {"mrr": 0.5})], "dataset string, metrics map<string,double>").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    sinks.append_history(summary, str(tmp_path / "history"))
    assert files.history(spark, str(tmp_path / "history")).first().metrics == {"mrr": 0.5}


def brute_split(text, size, overlap, separators):
    """The splitter by its rule: cut at the first separator that the text has, join pieces up to ``size`` with ``overlap`` kept, go into longer ones."""
    if not text:
        return []
    k = next(k for k, s in enumerate(separators) if s == "" or s in text)
    sep = separators[k]
    pieces = list(text) if sep == "" else [p for p in (text.split(sep)[:1] + [sep + x for x in text.split(sep)[1:]]) if p]
    out, run = [], []

    def close(run):
        merged, window = [], []
        for p in run:
            if window and sum(map(len, window)) + len(p) > size:
                merged.append("".join(window).strip())
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(p) > size):
                    window = window[1:]
            window = [*window, p]
        return [m for m in [*merged, "".join(window).strip()] if m]

    for p in pieces:
        if len(p) <= size:
            run.append(p)
            continue
        out, run = out + close(run), []
        out += brute_split(p, size, overlap, separators[k + 1 :]) if separators[k + 1 :] else [p]
    return out + close(run)


@pytest.mark.parametrize("domain", ["general", "legal"])
def test_recursive_chunks_by_brute_force(spark, sf_dir, domain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size, overlap = chunking.SIZES[domain]
    got = {}
    for r in chunking.recursive_chunks(docs, domain).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    separators = chunking.LEGAL if domain == "legal" else chunking.GENERAL
    rows = [r for r in docs.collect() if len(r.text or "") < 20_000]
    assert len(rows) > 150
    for r in rows:
        assert got.get(r.doc_id, []) == brute_split(r.text, size, overlap, separators)
