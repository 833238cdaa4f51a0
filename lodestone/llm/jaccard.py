"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and MinHash propose, whole shingle sets decide.

Two texts of similarity 0.8 differ in about 10 of 64 SimHash bits, and at that radius a grid of segment counts holds nearly
all pairs in its cells. So SimHash (``simhash.links``) proposes the pairs within its radius, and MinHash those beyond: each
set of shingles gets ``BANDS`` keys of ``BAND_ROWS`` minima, and a pair of similarity s shares no key with probability
(1 - s^5)^40: 1.3e-7 at s = 0.8 and less above. Every pair that shares a key is compared by its whole sets, or is already
connected by pairs that were, or cannot be similar:

1. Each set is compared with one hub under each of its keys, the set with the most company under all of its own keys. This
   joins a group of near copies in a number of comparisons that is linear in its size.
2. Under keys that still hold several components, shingles are counted over the sets there. Two sets have at most as many
   shingles in common as they share rare ones (in ``RARE_SETS`` sets or fewer; found by joining on the rare shingle) plus the
   fewer of their frequent ones. A pair whose bound is too low for ``percent`` is not compared; in families of texts that
   differ from a common one in places of their own, this leaves almost none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Staged, text_bytes, tidy
from lodestone.llm.simhash import _LAST, components, links, majority_bits, pick

BANDS = 40
BAND_ROWS = 5
RARE_SETS = 16  # that a rare shingle is in at most
_CHUNK = 2048  # shingles that are hashed at a time
_rng = np.random.default_rng(20_240_101)
_XOR = _rng.integers(0, 2**64, (BANDS * BAND_ROWS, 1), np.uint64)
_ODD = _rng.integers(0, 2**63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The XXH64 hashes (seed 42) of a text's word shingles in order; a shorter text is one shingle, and none without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins, ends, strict=True)), np.uint64, n)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, ((hashes[k : k + _CHUNK] ^ _XOR) * _ODD).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets is ``percent`` / 100 or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(shingle: int):
    """For each text its set's name, size and band keys, and its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                prints.append(majority_bits(hashes))
                distinct = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(distinct.tobytes(), 42))
                sizes.append(len(distinct))
                keys.append(band_keys(distinct))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), signed[0], pa.array(sizes, pa.int64()), signed[1], bands], names=["doc_id", "row", "node", "size", "fp", "bands"])

    return run


def _arrays(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), flat)], names=["node", "hashes"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            sides = [(c.values.to_numpy(), c.offsets.to_numpy().tolist()) for c in (batch.column(1), batch.column(3))]
            for k in range(batch.num_rows):
                a, b = (flat[at[k] : at[k + 1]] for flat, at in sides)
                good.append(similar(a, b, percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in (batch.column(0), batch.column(2))], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar; ``sets(node, hashes)`` has each node's shingles."""
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "sa", "b", "sb")
    return both.mapInArrow(tidy(_verify(percent)), "a long, b long")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _close(points: DataFrame, radius: int) -> DataFrame:
    """``a, b``: nodes whose SimHashes differ in ``radius`` bits or fewer; equal ones are paired with the smallest of them."""
    equal = Staged(points.groupBy("fp").agg(F.min("node").alias("first")), "prints").df
    same = points.join(equal, "fp").filter("node != first").select(*_pair("node", "first"))
    near = links(equal.select("fp"), radius)
    ends = [equal.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")) for c in "ab"]
    return same.unionByName(near.join(ends[0], "a").join(ends[1], "b").select(*_pair("na", "nb")))


def _bounded(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the pairs of nodes of different components in ``open_(key, node, root)`` that may be similar.

    Pairs under a key are weighed inside the join, which gives out those whose bound is high enough, and each at one key.
    """
    nodes = Staged(open_.groupBy("node").agg(F.first("root").alias("root"), F.sort_array(F.collect_list("key")).alias("keys")), "open-nodes").df
    held = Staged(nodes.join(sets, "node").select("node", "root", F.size("hashes").alias("size"), F.explode("hashes").alias("hash")), "open-shingles").df
    counts = held.groupBy("hash").agg(F.count("*").alias("n"))
    rare = held.join(counts.filter(F.col("n").between(2, RARE_SETS)).select("hash"), "hash")
    often = Staged(held.join(counts.filter(F.col("n") > RARE_SETS).select("hash"), "hash").groupBy("node").agg(F.count("*").alias("often")), "frequent").df
    sized = (
        nodes.join(held.groupBy("node").agg(F.first("size").alias("size")), "node")
        .join(often, "node", "left")
        .withColumn("often", F.coalesce("often", F.lit(0)))
    )
    sized = Staged(sized, "weighed").df

    def reach(common, sizes):
        """Whether so many common shingles are enough: 100 c >= p (m + n - c)."""
        return (100 + percent) * common >= percent * sizes

    def of(df: DataFrame, c: str, *more: str) -> DataFrame:
        return df.select(
            *more, *[F.col(x).alias(f"{x}_{c}") for x in ("node", "root", "size", "often")],
            *([F.col("keys").alias(f"keys_{c}")] if "keys" in df.columns else []),
        )

    # a set whose frequent shingles are too few even for the best partner has none without a rare one in common
    worth = sized.filter(100 * F.col("often") >= percent * F.col("size")).withColumn("key", F.explode("keys"))
    left, right = of(worth, "a", "key"), of(worth, "b", "key")
    fits = reach(F.least("often_a", "often_b"), F.col("size_a") + F.col("size_b"))
    once = F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))
    under_keys = left.join(right, "key").filter((F.col("root_a") < F.col("root_b")) & fits & once).select(*_pair("node_a", "node_b"))
    holders = rare.select("hash", "node", "root")
    shared = (
        holders.select("hash", F.col("node").alias("a"), F.col("root").alias("ra"))
        .join(holders.select("hash", F.col("node").alias("b"), F.col("root").alias("rb")), "hash")
    )
    shared = shared.filter((F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("rare"))
    sides = [sized.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("often").alias(f"often_{c}")) for c in "ab"]
    weighed = shared.join(sides[0], "a").join(sides[1], "b").filter(reach(F.col("rare") + F.least("often_a", "often_b"), F.col("size_a") + F.col("size_b")))
    return under_keys.unionByName(weighed.select("a", "b")).distinct()


def _classes(docs: DataFrame, shingle: int, percent: int, radius: int) -> DataFrame:
    """``least``: the smallest (id, row) of each component of distinct shingle sets, in a struct."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.xxhash64("text").alias("row"))
    prints = Staged(hashed.mapInArrow(tidy(_sets(shingle)), "doc_id long, row long, node long, size long, fp long, bands array<long>"), "shingle-sets")
    name = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "row")
    points = Staged(prints.df.groupBy("node").agg(F.min(name).alias("first"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "sets").df
    prints.drop()
    keyed = points.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = Staged(keyed.join(shared, "key"), "buckets").df  # keys that one set alone has are gone
    company = Staged(buckets.groupBy("node").agg(F.sum("n").alias("company")), "company").df
    hubs = buckets.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    stars = buckets.join(hubs, "key").filter("node != hub").select(*_pair("node", "hub"))
    pairs = Staged(stars.unionByName(_close(points.select("node", "fp"), radius)).distinct(), "pairs").df
    # the shingles of the sets in a pair, from one text of each; every set that shares a key is in one
    paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    owners = points.select("node", "first.id", "first.row").join(paired, "node", "left_semi")
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("row"), text_bytes().alias("text"))
    texts = named.join(owners, ["id", "row"]).select("node", "text").dropDuplicates(["node"])
    sets = Staged(texts.mapInArrow(tidy(_arrays(shingle)), "node long, hashes array<long>"), "set-shingles")
    near = Staged(_links(pairs, sets.df, percent), "near").df
    roots = components(near)
    placed = Staged(buckets.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed").df
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    open_ = placed.join(split, "key", "left_semi")
    more = Staged(_links(_bounded(open_, sets.df, percent).join(pairs, ["a", "b"], "left_anti"), sets.df, percent), "more-near").df
    if not more.isEmpty():
        roots = components(near.unionByName(more))
    sets.drop()
    owned = points.select("node", "first").join(roots, "node", "left")
    return owned.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("least")).select("least")


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 3) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component (null last, ties by the text's hash), one of repeated rows.

    Two rows are linked if the sets of their ``shingle``-word shingles have a Jaccard similarity of ``percent`` / 100 or
    more; texts without words, null ones too, are all alike. ``radius`` is that of SimHash; what is linked does not depend on it.
    """
    chosen = _classes(docs, shingle, percent, radius).select("least.id", "least.row").distinct()
    return pick(docs, chosen)
