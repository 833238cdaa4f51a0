"""Ids of every text are the library's, packing has no large group, scores have no ceiling."""

import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import packing, quality, tokenizing


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def both(request):
    from tokenizers import Tokenizer

    return tokenizing.PieceEncoder(request.param), Tokenizer.from_file(tokenizing.resolve(request.param))


def ids_of(encoder, texts):
    offsets, ids = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def test_every_letter_before_a_mark(both):
    """Letters that normalising turns into a letter and a mark, too, and every other one."""
    encoder, library = both
    texts = [f"{chr(k)}{m}" for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k))[0] == "L" for m in "!,"]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    got = ids_of(encoder, texts)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert {"İ!", "क़,"} <= set(texts)


def test_strings_of_special_tokens(both):
    encoder, library = both
    token = encoder.special[-1]
    texts = [token, f"a {token} b", f"word{token}word", f"{token}\n{token}", f"x\n {token}", token[:-1], f"İ! {token}", None, "", "plain words, only."] * 3
    assert ids_of(encoder, texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    offsets, ids = encoder.encode(pa.array([f"a {token}", "b"]), end_id=7)
    assert [x[-1] for x in np.split(ids, offsets[1:-1])] == [7, 7]


@pytest.mark.parametrize("sizes", [[340, 510, 515, 520, 690, 700], list(range(560, 701)), list(range(660, 700)) + [683] * 20])
def test_no_partition_gets_the_whole_pool(spark, monkeypatch, sizes):
    """Sizes that leave gaps or room in every bin: partitions stay small, and what is packed takes about as many bins as packing all at once."""
    lengths = np.random.default_rng(1).choice(sizes, 6000).tolist()
    items = spark.createDataFrame(list(enumerate(map(int, lengths))), "uid long, length long").repartition(4)
    kernel = packing._pack_part

    def watched(capacity, turn):
        run = kernel(capacity, turn)

        def go(key, pdf):
            if len(pdf) > 700:
                raise ValueError(f"a partition of {len(pdf)} pieces")
            return run(key, pdf)

        return go

    monkeypatch.setattr(packing, "_pack_part", watched)
    placed = packing.place(items, 2048, part_pieces=500).collect()
    assert sorted(r.uid for r in placed) == list(range(6000))
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, lengths[r.uid]))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    whole = len(packing.pack_sizes(np.array(lengths), 2048)[2])  # best-fit decreasing over everything at once
    assert len(bins) <= 1.01 * whole + 1


def test_scores_have_no_ceiling():
    at = quality.RULES.index("symbol_share") + len(quality.COUNTS)
    scores = [quality.counts((" ".join(["#" * n] * 30)).encode())[at] for n in (1, 2, 5, 1000)]
    assert scores == sorted(set(scores)) and scores[0] == quality.UNIT and scores[-1] < quality.GRID
    assert quality.score(0.5) == 500 and quality.score(2.0**31) < quality.GRID
