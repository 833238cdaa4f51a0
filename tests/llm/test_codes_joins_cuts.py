"""Vector codes, the n-gram join and fill-in-the-middle against brute force."""

import hashlib
import re

import numpy as np
import pytest

from lodestone.llm import infilling, ngram_join, vector_codes
from tests.llm.test_whole import shingles

# ---- op12


def brute_components(rows, percent=80):
    """doc_id, size, component of rows of distinct ids, over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def _families(rng):
    """Texts whose pairs lie on both sides of 0.8: copies with words replaced, chains, and a passage with more or less around it."""
    texts = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(120)]
        for step in range(10):
            texts.append(" ".join(words))
            for j in range(1 + g // 2):
                words[(step * 31 + j * 12) % 115] = f"g{g}s{step}j{j}"
    passage = [f"p{k}" for k in range(100)]
    for own in range(40):
        texts.append(" ".join([f"o{own}x{k}" for k in range(own)] + passage))  # 0 to 28 % of its own
        texts.append(" ".join(passage[: 100 - own] + [f"e{own}x{k}" for k in range(int(rng.integers(0, 12)))]))
    texts += ["one", "one", "ONE two", "one two three four", "one  two\tthree\nfour", "a b c d e", "a b c d e f", ""]
    return texts


@pytest.mark.parametrize("percent", [80, 50])
def test_ngram_join_finds_every_link(spark, percent):
    texts = _families(np.random.default_rng(5))
    order = np.random.default_rng(6).permutation(len(texts)).tolist()
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(ngram_join.similar_documents(docs, percent=percent)) == brute_components(rows, percent)


def test_ngram_join_of_a_large_group(spark):
    """A third are copies, a third differ in a word or two, the rest shares a passage that is too short to link."""
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(300):
        if i % 3 == 0:
            t = list(words)
        elif i % 3 == 1:
            t = list(words)
            t[i % 57] = f"new{i}"
        else:
            t = words[:20] + [f"d{i}w{k}" for k in range(25)]
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(ngram_join.similar_documents(docs)) == brute_components(rows)


def test_ngram_join_of_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 1), (3, "a b c d e f", 2), (2, "other words here", 1), (9, None, 1), (8, "", 1), (None, " \n\t", 1), (7, "long " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()]
    want = [(None, 2, 3), (3, 2, 3), (3, 2, 3), (2, 1, 2), (9, 0, 9), (8, 0, 8), (None, 0, None), (7, 1, 7)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ngram_join.similar_documents(docs.filter("false")).collect() == []


def test_suffix_filter_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert ngram_join.at_most(x, y, 3) >= len(np.intersect1d(x, y))


def test_pairs_are_few_in_families(spark):
    """Pairs that are verified grow with the sets of a family, not with their pairs."""
    rows = [(i, " ".join([f"w{k}" if k != i % 90 else f"n{i}" for k in range(100)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = ngram_join.ordered_sets(docs, 400 * 96, 5, 80).cache()
    verified = spark.sparkContext.accumulator(0)
    kernel = ngram_join._verified

    def counting(percent):
        run = kernel(percent)

        def go(batches):
            def each():
                for b in batches:
                    verified.add(b.num_rows)
                    yield b

            yield from run(each())

        return go

    ngram_join._verified = counting
    try:
        ngram_join._links(sets, 80).collect()
    finally:
        ngram_join._verified = kernel
    assert 0 < verified.value < 8 * 400


# ---- op11


def brute_codes(vectors, parts, entries, rounds, scale=4096):
    """Codes, errors and codebooks in plain Python."""
    rows = {i: [int(np.floor(scale * x)) for x in v] for i, v in vectors}
    width = len(next(iter(rows.values()))) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in rows.items()}
    books = [[list(cut[i][p]) for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for x in cut.values():
                of.setdefault(nearest(x[p], book)[1], []).append(x[p])
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(book)]
    out = {}
    for i, x in cut.items():
        best = [nearest(x[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best))
    return out, books


@pytest.mark.parametrize(("entries", "spread"), [(16, 1.0), (5, 0.001), (70, 1.0)])
def test_codes_match_plain_python(spark, entries, spread):
    rng = np.random.default_rng(entries)
    vectors = [(int(i), np.round(rng.normal(0, spread, 24), 4).tolist()) for i in rng.permutation(160)]
    vectors[7] = (vectors[7][0], vectors[8][1])  # equal vectors, and ties
    df = spark.createDataFrame([(i, v, i % 3) for i, v in vectors], "id long, v array<double>, kind int").repartition(4)
    codes, books = vector_codes.compress(df, "id", "v", "kind", parts=4, entries=entries, rounds=3)
    want, want_books = brute_codes(vectors, 4, entries, 3)
    assert {r.id: (r.code, r.error) for r in codes.collect()} == want
    assert [b.tolist() for b in books] == want_books
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for i, (_, e) in want.items():
        sums[i % 3] = sums.get(i % 3, 0) + e
    assert {(r.kind, r.label_error) for r in vector_codes.with_label_error(codes, "kind").collect()} == set(sums.items())


def test_masks_hold_the_nearest_and_leave_others_out():
    """On clustered parts few distances are computed; the nearest entry is always among the candidates."""
    rng = np.random.default_rng(3)
    entries = rng.integers(-4000, 4000, (130, 8))
    x = entries[rng.integers(0, 130, 2000)] + rng.integers(-60, 60, (2000, 8))
    best, least, computed = vector_codes.Codebook(entries).nearest(x)
    away = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (best == away.argmin(axis=1)).all() and (least == away.min(axis=1)).all()
    assert computed < 0.6 * away.size


def test_odd_vectors(spark):
    v = [0.5, -0.25, 1.0, 2.0]
    rows = [(1, v, None, 5), (2, v, "a", 5), (2, [0.0] * 4, "a", 5), (None, v, None, 5), (3, None, "a", 5), (4, [], "a", 5), (5, [1.0, None, 0.0, 0.0], "b", 5), (6, [float("nan")] * 4, "b", 5)]
    rows += [(7, [float("inf")] * 4, "b", 5), (8, [1.0, 2.0], "b", 5), (9, [1e9] * 4, "b", 5), (10, [1.0, 2.0, 3.0], "b", 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, error int")
    codes, books = vector_codes.compress(df, "vec_id", "embedding", "label", parts=2, entries=4, rounds=1)
    got = [(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.with_label_error(codes, "label").collect()]
    assert sorted(got, key=repr) == sorted([(1, "0000", 0, 0), (2, "0000", 0, 0), (2, "0101", 0, 0), (None, "0000", 0, 0)], key=repr)
    assert [b.tolist() for b in books] == [[[2048, -1024], [0, 0]], [[4096, 8192], [0, 0]]]
    none, books = vector_codes.compress(df.filter("false"), "vec_id", "embedding", "label")
    assert none.collect() == [] and books == [] and vector_codes.with_label_error(none, "label").collect() == []


# ---- op13


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 4, 5, 17, 300, 5000):
        widths = rng.integers(1, 9, n)
        units, ends = infilling.SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
        assert [units.offset(k) for k in range(n + 1)] == ends.tolist()
        for lane in units.lanes:
            assert lane[0].sum() == n and lane[1].sum() == ends[-1]


def test_descents_are_short():
    """The gaps of a lane have three lengths at most, so every descent takes few steps."""
    units = infilling.SkipList(np.ones(200_000, np.uint8))
    assert len(units.lanes) >= 6
    for spans, _, _ in units.lanes[:-1]:
        assert len(set(spans.tolist()[:-1])) <= 3
    longest = [int(np.max(np.diff(np.append(down, len(below[0]) if k else units.units)))) for k, (below, (_, _, down)) in enumerate(zip([units.lanes[0], *units.lanes], units.lanes, strict=False))]
    assert max(longest[1:]) <= 12


def brute_fill(doc_id, text, unit=None):
    text = text or ""
    if unit is None:
        pieces = list(text)
    else:
        cuts = sorted({0, len(text), *(x for m in re.finditer(unit, text) for x in m.span())})
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(pieces), "plain", None, None, text
    a, b = sorted((h1 % (len(pieces) + 1), h2 % (len(pieces) + 1)))
    pre, mid, suf = ("".join(pieces[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if h4 % 100 < 20:
        return len(pieces), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(pieces), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", [None, r"\w+\s*", r"[^\n]*\n"])
def test_fill_in_middle_against_plain_python(spark, unit):
    rng = np.random.default_rng(4)
    alphabet = list("ab c\n<PSM>é漢🙂́İ")
    rows = [(i, "".join(rng.choice(alphabet, int(rng.integers(0, 60))))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "some text"), (None, None), (5, rows[5][1]), (302, "<P"), (303, "x<S>y"), (304, "🙂" * 300_000), (305, "word " * 100_000), (-7, "negative id")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(4)
    out = infilling.fill_in_middle(docs, unit=unit)
    got = out.withColumn("again", infilling.restored(out["output"], out["form"])).collect()
    want = [(i, *brute_fill(i, t, unit)) for i, t in rows]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(r.again for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(docs.filter("false")).collect() == []
