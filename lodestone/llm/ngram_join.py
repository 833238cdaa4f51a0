"""Documents joined by the Jaccard similarity of their word n-grams, by rare-first prefixes.

Tokens are the distinct n-grams of a document, ordered by the number of sets that have them, rarest first. Two sets x and y
with |x| <= |y| of similarity t or more have a = t / (1 + t) (|x| + |y|) tokens in common or more, so the first one of them
stands among the first |x| - 2t / (1 + t) |x| + 1 tokens of x and the first |y| - t |y| + 1 of y. Sets meet under the tokens
of these prefixes and pass a length filter (|x| >= t |y|) and a positional one (what is left behind the common token is
enough) inside the join. Each pair that is left is verified once: its prefixes exactly, then a suffix filter, which bounds
what the rests can have in common by cutting both at the same tokens, then the rests exactly.

How the order is found, without a row for each n-gram:

1. Texts are dealt into slices, equal texts into one. A slice sends each of its distinct hashes once, with its count, to the
   bucket of the hash's first bits, as packed arrays; an n-gram that very many sets have is one entry of each slice.
2. A bucket adds up the counts and answers each slice with a byte for each of its hashes: 0 for an n-gram of one set only,
   else a half octave of the number of sets.
3. Back in its slice each set drops the n-grams that no other set has: they come first in the order and are common to
   nothing. A set whose prefix is all such has no partner and goes.

Groups of similar sets are no groups of pairs: under each token the set with the most company under all of its tokens and the
smallest one are hubs, which every other one is compared with. Only under tokens that still hold several components do sets meet pair by pair, by classes of sizes, so that sets meet
those alone whose sizes the filters admit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Staged, shuffle_partitions, text_bytes, tidy, worker_cache
from lodestone.llm.simhash import _LAST, components

SLICE_TOKENS = 2_000_000
KNOWN_WORDS = 200_000  # about 200 bytes each
CLASS = 1.05  # from a class of sizes to the next
_DEPTH = 3  # of the suffix filter
_SHORT, _LONG = np.uint64(32), np.uint64(56)
_FACTORS = np.random.default_rng(20_250_301).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """XXH64 (seed 42) of words, kept while the worker lives, up to ``KNOWN_WORDS`` at a time."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(words: list[bytes], n: int) -> np.ndarray:
    """The distinct 64-bit hashes of the n-grams of ``words``, ascending; fewer words are one n-gram, none are none."""
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_cache().setdefault("ngram-words", _Words())
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : k + len(total)] * _FACTORS[k % 64] ** np.uint64(1 + k // 64)
    return np.unique(_mixed(total))


def _name(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _named(n: int):
    """``doc_id, row, node, size``: each text's set by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = [], []
            for text in batch.column(1):
                hashes = ngram_hashes((text.as_py() or b"").lower().split(), n)
                nodes.append(_name(hashes))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _signed(nodes), pa.array(sizes, pa.int64())], names=["doc_id", "row", "node", "size"])

    return run


def _dealt(slices: int):
    """``slice, text``: each text with words in small letters and single spaces, once from each task, and its slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen = set()
        for batch in batches:
            at, texts = [], []
            for text in batch.column(0):
                joined = b" ".join((text.as_py() or b"").lower().split())
                key = xxhash.xxh3_128_intdigest(joined)
                if joined and key not in seen:
                    seen.add(key)
                    at.append(key % slices)
                    texts.append(joined)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(texts, pa.binary())], names=["slice", "text"])

    return run


def _sets(table: pa.Table, n: int) -> dict[int, np.ndarray]:
    """The distinct sets of a slice by name."""
    out = {}
    for text in table.column("text"):
        hashes = ngram_hashes(text.as_py().split(b" "), n)
        out[_name(hashes)] = hashes
    return out


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash by its first 32 bits; buckets ascend with hashes."""
    return ((hashes >> _SHORT) * np.uint64(buckets) >> _SHORT).astype(np.int64)


def _counted(n: int, buckets: int):
    """``bucket, slice, low, places, counts``: the last 32 bits of a slice's distinct hashes, and where more than one of its sets has one, how many."""

    def run(table: pa.Table) -> pa.Table:
        at = table.column("slice")[0].as_py()
        hashes, counts = np.unique(np.concatenate(list(_sets(table, n).values())), return_counts=True)
        of = _buckets(hashes, buckets)
        edges = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        rows = []
        for a, b in zip(edges, [*edges[1:], len(of)], strict=True):
            more = np.flatnonzero(counts[a:b] > 1)
            rows.append((int(of[a]), at, hashes[a:b].astype(np.uint32).tobytes(), more.astype(np.uint32).tobytes(), counts[a:b][more].astype(np.uint32).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "slice", "low", "places", "counts"])

    return run


def _weighed(table: pa.Table) -> pa.Table:
    """``slice, bucket, classes``: a byte for each hash that a slice sent, 0 if one set alone has it."""
    low = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("low")]
    counts = []
    for hashes, places, several in zip(low, table.column("places"), table.column("counts"), strict=True):
        one = np.ones(len(hashes), np.int64)
        one[np.frombuffer(places.as_py(), np.uint32)] = np.frombuffer(several.as_py(), np.uint32)
        counts.append(one)
    distinct, at = np.unique(np.concatenate(low), return_inverse=True)
    sets = np.bincount(at, np.concatenate(counts), len(distinct))
    classes = np.where(sets > 1, 1 + np.floor(2 * np.log2(np.maximum(sets, 1))), 0).astype(np.uint8)[at]
    ends = np.cumsum([len(x) for x in low])[:-1]
    packed = pa.array([x.tobytes() for x in np.split(classes, ends)], pa.binary())
    return pa.table([table.column("slice"), table.column("bucket"), packed], names=["slice", "bucket", "classes"])


def prefix_length(size: int, percent: int) -> int:
    """Of a set that meets smaller ones: |x| - t |x| + 1, the product rounded up."""
    return size + percent * -size // 100 + 1


def _ordered(n: int, percent: int):
    """``node, size, alone, tokens``: the n-grams of each set that others have, in the order of all; ``alone`` is the number of the rest.

    Sets that have no partner are left out.
    """

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _sets(texts, n)
        answers = answers.sort_by("bucket")
        every = np.unique(np.concatenate(list(sets.values()))) if sets else np.zeros(0, np.uint64)
        classes = np.frombuffer(b"".join(answers.column("classes").to_pylist()), np.uint8)
        out = []
        for node, hashes in sets.items():
            mine = classes[np.searchsorted(every, hashes)]
            shared = np.flatnonzero(mine)
            alone = len(hashes) - len(shared)
            if alone < prefix_length(len(hashes), percent):
                tokens = np.sort((mine[shared].astype(np.uint64) << _LONG) | (hashes[shared] >> np.uint64(8)))
                out.append((node, len(hashes), alone, tokens.view(np.int64)))
        lists = pa.ListArray.from_arrays(np.cumsum([0, *(len(x[3]) for x in out)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *(x[3] for x in out)]))
        sizes = [pa.array([x[k] for x in out], pa.int64()) for k in (1, 2)]
        return pa.table([_signed([x[0] for x in out]), *sizes, lists], names=["node", "size", "alone", "tokens"])

    return run


def at_most(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """A bound of what two ascending arrays have in common: cut both at the same token, a part has no more than its shorter side."""
    least = min(len(x), len(y))
    if depth == 0 or least < 2:
        return least
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    return at_most(x[:at], y[:middle], depth - 1) + at_most(x[at:], y[middle:], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, sizes: tuple[int, int], alone: tuple[int, int], percent: int) -> bool:
    """Whether 100 |x and y| >= percent |x or y|, for the tokens in order that other sets have too."""
    need = -(-percent * sum(sizes) // (100 + percent))
    # up to the last token that is in both prefixes the count is exact, and the rests are bounded
    cut = min(t[prefix_length(size, percent) - own - 1] for t, size, own in zip((x, y), sizes, alone, strict=True))
    a, b = int(np.searchsorted(x, cut, "right")), int(np.searchsorted(y, cut, "right"))
    head = len(np.intersect1d(x[:a], y[:b], assume_unique=True))
    if head + at_most(x[a:], y[b:], _DEPTH) < need:
        return False
    return head + len(np.intersect1d(x[a:], y[b:], assume_unique=True)) >= need


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in ("ta", "tb")]
            flat = [(c.values.to_numpy(), c.offsets.to_numpy().tolist()) for c in sides]
            sizes, alone = (list(zip(*(batch.column(f"{c}{s}").to_pylist() for s in "ab"), strict=True)) for c in ("size_", "alone_"))
            good = []
            for k in range(batch.num_rows):
                x, y = (values[at[k] : at[k + 1]] for values, at in flat)
                good.append(similar(x, y, sizes[k], alone[k], percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def _similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that are similar, each verified once."""
    side = [sets.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("alone").alias(f"alone_{c}"), F.col("tokens").alias(f"t{c}")) for c in "ab"]
    return pairs.join(side[0], "a").join(side[1], "b").mapInArrow(tidy(_verified(percent)), "a long, b long")


def _enough(size: Column, at: Column, size2: Column, at2: Column, percent: int) -> Column:
    """The length and the positional filter for sets that have a common token at these places (from 1)."""
    long_enough = 100 * F.least(size, size2) >= percent * F.greatest(size, size2)
    return long_enough & ((100 + percent) * (1 + F.least(size - at, size2 - at2)) >= percent * (size + size2))


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / float(np.log(CLASS)) + 1e-9)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect whatever is similar."""
    length = F.col("size") - F.ceil(percent * F.col("size") / 100) + 1
    mine = F.posexplode(F.slice("tokens", F.lit(1), F.greatest(length - F.col("alone"), F.lit(0)).cast("int"))).alias("k", "token")
    prefix = Staged(sets.select("node", "size", "alone", mine).select("token", "node", "size", (F.col("alone") + F.col("k") + 1).alias("at")), "prefix-tokens")
    held = Staged(prefix.df.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("size", "node", "at")).alias("least")).filter("n > 1"), "held-tokens").df
    shared = prefix.df.join(held.select("token", "n"), "token")
    company = Staged(shared.groupBy("node").agg(F.sum("n").alias("company")), "company").df
    known = shared.join(company, "node").groupBy("token").agg(F.max(F.struct("company", "node", "size", "at")).alias("most"))
    hubs = held.join(known, "token").select("token", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{h}.{c}") for c in ("node", "size", "at")]) for h in ("least", "most")]))).alias("hub"))
    hubs = Staged(hubs, "hubs").df
    stars = prefix.df.join(hubs, "token").filter((F.col("node") != F.col("hub.node")) & _enough(F.col("size"), F.col("at"), F.col("hub.size"), F.col("hub.at"), percent))
    both = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    pairs = Staged(stars.select(*both(F.col("node"), F.col("hub.node"))).distinct(), "star-pairs").df
    near = Staged(_similar_pairs(pairs, sets, percent), "star-links").df
    roots = components(near)
    placed = Staged(shared.drop("n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed-tokens").df
    split = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("token")
    open_ = Staged(placed.join(split, "token", "left_semi"), "open-tokens").df
    prefix.drop()
    size, at = F.col("size"), F.col("at")
    short = size - F.ceil(2 * percent * size / (100 + percent)) + 1
    index = open_.filter(at <= short).select("token", _size_class(size).alias("class"), *[F.col(c).alias(f"{c}_x") for c in ("node", "size", "at", "root")])
    # a smaller partner has |x| >= t |y|, and what y has left behind the token must be enough for both sizes
    largest = F.least(size, F.floor((100 + percent) * (1 + size - at) / percent) - size)
    least = F.ceil(percent * size / 100)
    classes = F.when(least <= largest, F.sequence(_size_class(least), _size_class(largest)))
    probe = open_.select("token", F.explode(classes).alias("class"), *[F.col(c).alias(f"{c}_y") for c in ("node", "size", "at", "root")])
    before = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("node_x") < F.col("node_y")))
    enough = _enough(F.col("size_x"), F.col("at_x"), F.col("size_y"), F.col("at_y"), percent)
    met = index.join(probe, ["token", "class"]).filter((F.col("root_x") != F.col("root_y")) & before & enough)
    rest = met.select(*both(F.col("node_x"), F.col("node_y"))).distinct().join(pairs, ["a", "b"], "left_anti")
    more = Staged(_similar_pairs(rest, sets, percent), "more-links").df
    return near.unionByName(more)


def ordered_sets(docs: DataFrame, tokens: int, n: int, percent: int) -> DataFrame:
    """``node, size, alone, tokens`` of the sets that may have partners; ``tokens`` is the number of n-grams of all texts, for the size of slices.

    Slices and buckets have about ``SLICE_TOKENS`` entries, fewer for small inputs so that all tasks have work, more where
    otherwise a slice would send a bucket less than 64.
    """
    several = 4 * shuffle_partitions(docs.sparkSession)
    slices = max(1, min(max(several, tokens // SLICE_TOKENS), int((tokens / 64) ** 0.5)))
    dealt = docs.select(text_bytes()).mapInArrow(tidy(_dealt(slices)), "slice long, text binary")
    counted = dealt.groupBy("slice").applyInArrow(_counted(n, slices), "bucket long, slice long, low binary, places binary, counts binary")
    answers = counted.groupBy("bucket").applyInArrow(_weighed, "slice long, bucket long, classes binary")
    return dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_ordered(n, percent), "node long, size long, alone long, tokens array<long>")


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    Two rows are linked if ``percent`` / 100 or more of the distinct n-grams of words that one of them has are common to both.
    component_id is the smallest doc_id that links reach, the row's own included, null if all are null. A text with fewer
    words than ``n`` is one n-gram; a null, empty or blank one has none, and is its own component. Rows with one or a null
    doc_id are documents of their own; equal sets are one. Other columns are not read. Sets and n-grams are told apart by 64
    and 56 bits of hashing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.xxhash64("text").alias("row"))
    named = Staged(rows.mapInArrow(tidy(_named(n)), "doc_id long, row long, node long, size long"), "named-sets").df
    tokens = named.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    with_words = named.filter("size > 0")
    sets = Staged(ordered_sets(docs, tokens, n, percent), "ordered-sets")
    roots = components(_links(sets.df, percent))
    sets.drop()
    first = with_words.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("first")).join(roots, "node", "left")
    first = Staged(first.select("node", "first", F.coalesce("root", "node").alias("root")), "set-roots").df
    least = first.groupBy("root").agg(F.min("first").alias("least"))
    classes = first.join(least, "root").select("node", F.when(F.col("least") < _LAST, F.col("least")).alias("component_id"))
    found = with_words.join(classes, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return found.unionByName(named.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
