"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import archives, extraction, licenses, line_dedup, mixing, mtree, packing, quality, simhash, token_files
from lodestone.llm._common import new_path, stage

LONG = "word " * 50_000 + "end\nlast line"
ROWS = [
    (1, "the same text here\nshared", "en", "a", 1), (1, "the same text here\nshared", "en", "a", 1), (2, None, None, None, 2), (None, "no id at all", "en", "b", 3),
    (None, None, "fr", None, 4), (3, "", "de", "b", 5), (4, LONG, "en", "a", 6), (5, " \n\t\n", "en", "a", 7), (6, " 𝕏 \x00 odd", "", "", 8),
]
EXTRA = "doc_id long, text string, lang string, source string, n_lines int"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, EXTRA)
    for name in ("uid", "doc", "row", "part", "size", "kept", "carried"):  # names that operators use themselves
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


LABELS = "doc_id long, quality int"


def both(docs, empty, f):
    assert f(empty).count() == 0
    return f(docs).collect()


def test_line_dedup(docs, empty):
    rows = both(docs, empty, lambda d: line_dedup.line_digests(d, min_docs=2))
    assert len(rows) == len(ROWS)
    assert {r.n_lines for r in rows if r.doc_id == 2} == {1}
    kept = both(docs, empty, line_dedup.drop_lines)
    assert len(kept) == len(ROWS) and kept[0].asDict().keys() == set(docs.columns)
    assert sum(r.text is None for r in kept) == 2 and all(r.uid == "mine" for r in kept)


def test_simhash(docs, empty):
    rows = both(docs, empty, simhash.near_duplicates)
    assert len(rows) == len(ROWS)
    wordless = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(wordless) == 4 and {r.component_id for r in wordless} == {2}
    assert [r.component_id for r in rows if r.doc_id is None and r.fingerprint != "0" * 16] == [None]
    kept = both(docs, empty, simhash.one_of_each)
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 4, 6] and all(r.row == "mine" for r in kept)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], LABELS)
    rows = both(docs, empty, lambda d: quality.apply_rules(d, labels))
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.n_words, r.kept) for r in rows if r.doc_id in (1, 2, 4)} == {(1, 5, False), (2, 0, False), (4, 50_003, False)}
    assert quality.keep_documents(docs, labels.limit(0)).columns == docs.columns


def test_mix(docs, empty):
    words, weight = mixing.word_count(F.col("text")), mixing.quality_weight(F.col("text"))
    rows = both(docs, empty, lambda d: mixing.mix(d, words, weight))
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert {r.target for r in rows if r.source_size == 0} <= {0.0}
    assert both(docs, empty, lambda d: mixing.mixed(d, words, weight))[0].asDict().keys() == set(docs.columns)


def test_pack(docs, empty):
    rows = both(docs, empty, lambda d: packing.pack_documents(d, "word_bpe_49k.json", 2048))
    assert sum(r.length for r in rows if r.doc_id == 4) == 50_004 and sum(r.length for r in rows if r.doc_id == 2) == 1
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 1 for r in rows) == 2
    with pytest.raises(Exception, match="does not fit"):
        packing.pack(docs.select(F.lit(9).alias("length")), 8).collect()


def test_pipeline_stages(spark, sf_dir):
    """Nulls in every column, repeated rows, one id with two texts and a very long text go through all stages."""
    prose = lambda tag: " ".join(f"{tag}{k} in the word" for k in range(12))
    rows = [(1, prose("a"), "en", "s", 1), (1, prose("a"), "en", "s", 1), (1, prose("b"), "en", "s", 1), (None, prose("c"), None, None, None), (None, prose("c"), None, None, None)]
    rows += [(2, None, "en", "s", 0), (3, "", None, "s", 0), (4, " ".join(f"w{k}" for k in range(60_000)), "en", None, 9), (5, prose("a") + "\nshared", "en", "t", 2)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("stratum", F.lit("mine"))
    seen = []
    for name, f in corpus_pipeline.STAGES[:-1]:
        now = stage(f(spark, now, sf_dir), "edge-stage")
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", "stratum"]
        seen.append((name, collections.Counter((r.doc_id, (r.text or "")[:2]) for r in now.collect())))
    assert seen[0][1] == {(1, "a0"): 2, (1, "b0"): 1, (None, "c0"): 2, (4, "w0"): 1, (5, "a0"): 1} == seen[1][1]
    assert seen[2][1] == {(1, "a0"): 1, (1, "b0"): 1, (None, "c0"): 1, (4, "w0"): 1}
    assert set(seen[3][1]) <= set(seen[2][1]) and max(seen[3][1].values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert {(r.doc_id, r.piece) for r in packed if r.piece == 0} == {(d, 0) for d, _ in seen[3][1]}


def test_token_files(spark, docs, empty):
    def run(d):
        path = new_path(spark, "edge-tokens")
        token_files.write_tokens(d, path, "byte_bpe_50k.json", 2)
        return token_files.digests(token_files.read_tokens(spark, path))

    rows = sorted(both(docs, empty, run), key=lambda r: r.start)
    assert len(rows) == len(ROWS) and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]


def test_licenses(docs, empty):
    assert both(docs, empty, licenses.scan) == []


PAGES = [(1, "http://a b", "<p>" + "x" * 200), (1, "http://a b", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (None, "u", "<p>" + "x" * 200), (3, "v", None), (4, "w", ""), (5, "", "short"), (6, "", "short")]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("payload", F.lit(2))
    for version in (1, 2):
        for df, n in ((pages, len(PAGES)), (pages.limit(0), 0)):
            path = new_path(spark, "edge-warc")
            archives.write_warc(df, path, version)
            rows = archives.read_warc(spark, path).collect()
            assert len(rows) == n
            if n:
                assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows if r.page_id and r.page_id < 3) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
                assert {r.record_type for r in rows if r.page_id != 2} == {"response"} and {r.payload_bytes for r in rows if r.page_id in (3, 4)} == {0}


def test_warc_of_one_page_id_with_several_payloads(spark):
    a, b, c = "<p>" + "a" * 200, "<p>" + "b" * 250, "<p>" + "c" * 1_000_000
    rows = [(1, "u", a), (5, "u", a), (5, "u", b), (5, "u", c), (9, "v", c), (9, "v", "<p>tiny"), (None, None, c)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for version in (1, 2):
        path = new_path(spark, "several")
        archives.write_warc(pages, path, version)
        # an archive of an attempt that was lost is not in the manifest
        with open(f"{path.removeprefix('file://')}/part-lost.warc.gz", "wb") as f:
            f.write(b"half")
        got = archives.read_warc(spark, path).collect()
        want = [(p, h.encode(), "revisit" if (p, h) in ((5, a), (9, c)) else "response") for p, _, h in rows]
        assert sorted((str(r.page_id), r.record_type, r.payload_digest, r.payload) for r in got) == sorted(
            (str(p), t, hashlib.sha256(h).hexdigest(), h if t == "response" else b"") for p, h, t in want
        )
        assert {(r.page_id, r.refers_to) for r in got if r.refers_to} == {(5, 1), (9, 5)}


def test_extraction(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = extraction.extract(pages).collect()
    assert len(rows) == len(PAGES) and {r.text for r in rows if r.page_id in (3, 4)} == {""}
    assert extraction.extract(pages.limit(0)).count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    data = [(k, [float(k % 3), 1.0]) for k in range(8)] + [(8, None), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [None, 1.0]), (None, [9.0, 9.0]), (0, [0.0, 1.0]), (12, [1.0]), (13, [])]
    vectors = mtree.quantised(spark.createDataFrame(data, "id long, v array<float>").withColumn("block", F.lit(1)), "id", "v")
    assert sorted(r.vec_id for r in vectors.collect()) == sorted([*range(8), 0, 12, 13])
    found = mtree.top_k(vectors.filter("vec_id = 0"), vectors, k=3).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in found] == [(1, 1, 65536), (2, 2, 65536), (3, 3, 65536)]
    assert mtree.top_k(vectors.filter("vec_id = 0"), vectors, k=50).count() == 9
    assert mtree.top_k(vectors.limit(0), vectors, k=3).count() == 0 and mtree.top_k(vectors, vectors.limit(0), k=3).count() == 0
