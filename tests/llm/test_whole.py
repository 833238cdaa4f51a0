"""Cases where an operator once did less than the whole job."""

import collections
import os
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import extraction, jaccard, licenses, mtree, quality


def test_a_group_of_copies_leaves_one_text(spark, sf_dir):
    """Every line of 12 exact copies is heavy; the first copy keeps them all, and a line that others share stays at its first place."""
    articles = ["\n".join(f"article {a} line {k} has words of its own" for k in range(8)) for a in range(3)]
    rows = [(100 * a + k, text) for a, text in enumerate(articles) for k in range(12)]
    rows += [(1000 + k, f"shared footer\nsingle document number {k} says {k * 7} things") for k in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    after = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, docs, sf_dir).collect()}
    assert len(after) == len(rows)
    assert [after[100 * a] for a in range(3)] == articles and not any(after[100 * a + k] for a in range(3) for k in range(1, 12))
    assert [i for i, t in after.items() if "shared footer" in t] == [1000]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_near(texts):
    """The pairs of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, by counting common shingles."""
    sets, holders, common = {i: shingles(t) for i, t in texts.items()}, collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s or [None]:
            holders[x].append(i)
    for ids in holders.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    size = {i: max(1, len(s)) for i, s in sets.items()}
    return {(a, b) for (a, b), n in common.items() if 5 * n >= 4 * (size[a] + size[b] - n)}


def smallest_of_each(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i for i in ids if find(i) == i}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_near_dedup_finds_every_similar_pair(spark, folder):
    folder = f"/root/testdata/{folder}"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    pairs = brute_near(texts)
    assert pairs
    kept = [r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, folder).collect()]
    assert sorted(kept) == sorted(smallest_of_each(texts, pairs))


def test_near_dedup_of_chains_and_threshold(spark):
    """Copies with some words replaced by new ones, near 0.8 from both sides, and chains that only neighbours link."""
    texts, at = {}, 0
    for group in range(12):
        words = [f"g{group}w{k}" for k in range(120)]
        for step in range(8):
            texts[at], at = " ".join(words), at + 1
            for j in range(1 + group // 4):
                words[(step * 31 + j * 12) % 115] = f"g{group}s{step}j{j}"
    pairs = brute_near(texts)
    assert len(pairs) > 60 and smallest_of_each(texts, pairs) != set(range(0, at, 8))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = [r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()]
    assert sorted(kept) == sorted(smallest_of_each(texts, pairs))


@pytest.mark.parametrize("rare_sets", [1, 3, 16])
def test_near_dedup_of_families_without_a_hub(spark, monkeypatch, rare_sets):
    """Texts that differ from a common one, which is not there, in places of their own, and some that share such places: most pairs
    share keys and few are similar, so the bounds on common shingles decide which are compared."""
    monkeypatch.setattr(jaccard, "RARE_SETS", rare_sets)
    rng = np.random.default_rng(rare_sets)
    texts = {}
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(100)]
        for k in range(30):
            words = list(base)
            for at in rng.choice(90, int(rng.integers(1, 6)), replace=False):
                words[at] = f"f{family}odd{k if k % 3 else k // 9}at{at}"
            texts[100 * family + k] = " ".join(words[: 100 - int(rng.integers(0, 12))])
    pairs = brute_near(texts)
    kept = smallest_of_each(texts, pairs)
    assert 10 < len(kept) < len(texts) - 10
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == sorted(kept)


def test_repeated_candidates_fill_one_place(spark):
    """The best candidates stand k times in the table; an id's two vectors of equal score are two candidates."""
    rng = np.random.default_rng(4)
    data = [(k, [float(x) for x in rng.integers(-3, 4, 3)]) for k in range(300)]
    data += [(900, [9.0, 9.0, 9.0])] * 5 + [(901, [8.0, 8.0, 8.0])] * 7 + [(902, [5.0, 5.0, -5.0]), (902, [5.0, -5.0, 5.0])]
    vectors = mtree.quantised(spark.createDataFrame(data, "id long, v array<float>").repartition(3), "id", "v", scale=1.0)
    rows = sorted({(i, tuple(map(int, v))) for i, v in data})
    got = collections.defaultdict(list)
    for r in mtree.top_k(vectors.filter("vec_id < 300 and vec_id % 10 = 0"), vectors, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for i, q in rows[:300:10]:
        want = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i)[:5]
        assert got[i] == [(j, -s) for s, j in want]


@pytest.mark.parametrize("bits", [20, 27, 40, 52])
def test_scores_of_large_values_are_exact(spark, bits):
    """Whole numbers beyond what a double holds, small candidates and large queries, ids above 2^53, and several blocks to search."""
    rng = np.random.default_rng(bits)
    ids = [(1 << 53) + k for k in range(400)]
    rows = [(i, [int(x) for x in (rng.integers(-4, 5, 3) if k % 2 else rng.integers(-(1 << bits), 1 << bits, 3))]) for k, i in enumerate(ids)]
    rows += [((1 << 54) + k, rows[0][1]) for k in range(300)]  # one vector under many ids
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    df = df.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    most = (1 << 63) - 1
    score = lambda q, v: max(-most - 1, min(most, sum(a * b for a, b in zip(q, v, strict=True))))
    want = {i: sorted((-score(q, v), j) for j, v in rows if j != i)[:5] for i, q in rows[:400:20]}
    old, mtree.BLOCK_ROWS = mtree.BLOCK_ROWS, 64
    try:
        got = collections.defaultdict(list)
        for r in mtree.top_k(df.filter(F.col("vec_id").isin(list(want))), df, k=5).orderBy("query_id", "rank").collect():
            got[r.query_id].append((-r.score, r.vec_id))
    finally:
        mtree.BLOCK_ROWS = old
    assert dict(got) == want


def test_same_words_of_long_texts():
    """Few words in random order score alike at any length, and so does prose of more words."""
    rng = np.random.default_rng(6)
    for n_words, least in ((40, 850), (2000, 50)):
        words = rng.integers(0, n_words, 60_000)
        scores = [quality.counts(" ".join(f"w{k}" for k in words[:n]).encode())[-1] for n in (1999, 2000, 2001, 7777, 60_000)]
        assert min(scores) >= least and max(scores) - min(scores) <= 30


def test_licenses_in_their_usual_layout(spark):
    """Texts wrapped at 78 characters under a title, and statements inside a paragraph, each found once and apart from their neighbours."""
    full = {n: t for n, t in sorted(licenses.TEMPLATES, key=lambda x: len(x[1])) if n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
    rows = [(k, "The Name License\n\nCopyright (c) 2020 Example\n\n" + "\n\n".join(textwrap.fill(p, 78) for p in t.split("\n")) + "\n\nint main;") for k, t in enumerate(full.values())]
    rows += [(10, "A story.\n(c) 2020 Example Media Ltd. Licensed under CC BY 4.0. Contact the editors for more. Licensed under CC BY-SA 4.0. The end.")]
    rows += [(11, "\n".join(["Licensed under the MIT License."] * 300)), (12, "The license of the editor was lost, and permission to print it was not given.")]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.first_line, r.last_line, r.license_id, r.different_words))
    for k, name in enumerate(full):
        assert got[k] == [(4, rows[k][1].count("\n") - 2, name, 0)]
    assert got[10] == [(1, 1, "CC-BY-4.0", 0), (1, 1, "CC-BY-SA-4.0", 0)]
    assert got[11] == [(k, k, "MIT", 0) for k in range(300)] and got[12] == []


def test_pages_of_other_languages_and_page_wide_forms():
    """A language without a list of function words is judged by length and links, and a form around the article does not hide it."""
    for line in ("Вчера вечером жители города собрались возле старой площади. ", "Wczoraj wieczorem mieszkańcy zebrali się przy starym rynku. ", "昨天晚上居民们聚集在古老的广场附近。"):
        body = (line * 20).strip()
        page = f"<body><nav>x</nav><div>{body}</div><div>{line}</div><div>{body}</div><footer>y</footer></body>"
        assert extraction.main_text(page).split("\n") == [body, line.strip(), body]
    english = "It was the day that they had to be at the house with all of us. " * 5
    codes = "alpha beta gamma delta " * 10
    assert extraction.main_text(f"<div>{english}</div><div>{english}</div><div>{codes}</div>").split("\n") == [english.strip()] * 2
    page = f"<form><nav>menu</nav><input><article><p>{english}</p><form>sign up</form></article></form>"
    assert extraction.main_text(page) == english.strip()
