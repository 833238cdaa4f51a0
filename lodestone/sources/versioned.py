"""A keyed table of versions: rows are appended, dead ones are named by place, and a manifest says what belongs together.

``data/_segment=<name>`` has the rows of one write, parted by a bucket of the first key and then by columns that filters skip
folders by. ``dead/<vector>`` has the places (file and row number) of rows that a later write replaced or deleted, and
``side/<name>`` what a user of the table keeps beside it and commits with it, such as counts. Nothing
that is written is ever changed. ``manifest-<version>.json`` names the segments and vectors of a version; it is written aside
and renamed, so a crash at any point leaves the old version or the new one, and readers see one of them whole.

A write of m rows reads the keys of the buckets that it touches and writes m rows and places. Segments of like size are
merged, four into one, without their dead rows, so their number grows with the logarithm of the table, and each row is
written that often at most. One writer at a time: a manifest that is already there is not replaced.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.staging import children, exists, read_text, remove, write_text_once

LEAST_BUCKETS = 8
BUCKET_ROWS = 4_000_000  # about; a larger table gets more buckets
TIER = 4  # segments of like size that are merged into one
KEPT = 2  # versions whose files stay

_OWN = ("_file", "_row", "_bucket", "_segment")
_EMPTY = {"version": 0, "schema": None, "segments": [], "vectors": [], "side": [], "epochs": {}}


class VersionedTable:
    """Rows told apart by ``keys``, which are not null; the first one decides the bucket."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], parted_by: list[str] | None = None, least_buckets: int = LEAST_BUCKETS):
        self.spark, self.path, self.keys, self.parted_by, self.least_buckets = spark, path.rstrip("/"), keys, parted_by or [], least_buckets

    # ---- versions

    def versions(self) -> list[int]:
        names = (n for n in children(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json"))
        return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in names)

    def manifest(self, version: int | None = None) -> dict:
        """What version ``version`` is made of, the last one without it."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        return json.loads(read_text(self.spark, f"{self.path}/manifest-{version}.json")) if version else json.loads(json.dumps(_EMPTY))

    def _commit(self, base: dict, segments: list[dict], vectors: list[dict], schema: T.StructType, epoch: tuple[str, int] | None = None, side: list[str] | None = None) -> None:
        alive = {s["name"] for s in segments}
        vectors = [v for v in vectors if alive & set(v["of"])]
        new = {
            "version": base["version"] + 1, "schema": schema.jsonValue(), "segments": segments, "vectors": vectors,
            "side": base["side"] if side is None else side, "epochs": base["epochs"] | (dict([epoch]) if epoch else {}),
        }
        if not write_text_once(self.spark, f"{self.path}/manifest-{new['version']}.json", json.dumps(new)):
            raise RuntimeError(f"version {new['version']} of {self.path} was written by another writer")

    def vacuum(self, keep: int = KEPT) -> None:
        """Deletes what none of the last ``keep`` versions names: older versions, and what crashed writes left."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        used = {x["name"] for m in kept for x in (*m["segments"], *m["vectors"])} | {x for m in kept for x in m["side"]}
        for v in known[:-keep]:
            remove(self.spark, f"{self.path}/manifest-{v}.json")
        for folder in ("data", "dead", "side"):
            for name in children(self.spark, f"{self.path}/{folder}"):
                if name.removeprefix("_segment=") not in used:
                    remove(self.spark, f"{self.path}/{folder}/{name}")

    # ---- reading

    def _bucket(self, modulus: int) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(modulus)).cast("int")

    def _scan(self, m: dict, segments: list[dict]) -> DataFrame:
        """All rows of ``segments``, dead ones too, with ``_file`` and ``_row``."""
        schema = T.StructType.fromJson(m["schema"]).add("_bucket", T.IntegerType()).add("_segment", T.StringType())
        paths = [f"{self.path}/data/_segment={s['name']}" for s in segments]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.withColumns({"_file": F.substring_index("_metadata.file_path", "/data/", -1), "_row": F.col("_metadata.row_index")})

    def _live(self, m: dict, segments: list[dict]) -> DataFrame:
        names = {s["name"] for s in segments}
        rows = self._scan(m, segments)
        vectors = [f"{self.path}/dead/{v['name']}" for v in m["vectors"] if names & set(v["of"])]
        return rows.join(self.spark.read.schema("_file string, _row long").parquet(*vectors), ["_file", "_row"], "left_anti") if vectors else rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one without it; a table that nothing was written to has no columns."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(m["schema"]) if m["schema"] else T.StructType()
        return self._live(m, m["segments"]).select(*[f.name for f in schema]) if m["segments"] else self.spark.createDataFrame([], schema)

    # ---- writing

    def _write(self, rows: DataFrame) -> dict | None:
        """A segment of ``rows``; None if there are none. Buckets that are large or small are split or put together by Spark."""
        n = rows.count()
        if not n:
            return None
        modulus = self.least_buckets
        while modulus * BUCKET_ROWS < n:
            modulus *= 2
        name = uuid.uuid4().hex
        out = rows.withColumn("_bucket", self._bucket(modulus)).hint("rebalance", "_bucket")
        out.write.partitionBy("_bucket", *self.parted_by).parquet(f"{self.path}/data/_segment={name}")
        return {"name": name, "rows": n, "modulus": modulus}

    def places(self, keys: DataFrame, m: dict | None = None) -> DataFrame:
        """``_file, _row`` and all columns of the live rows that have one of ``keys``, some or all of the table's; only their buckets are read."""
        m = self.manifest() if m is None else m
        by = [k for k in self.keys if k in keys.columns]
        found = None
        for modulus in sorted({s["modulus"] for s in m["segments"]}):
            touched = [r[0] for r in keys.select(self._bucket(modulus)).distinct().collect()]  # at most ``modulus`` numbers
            part = self._live(m, [s for s in m["segments"] if s["modulus"] == modulus]).filter(F.col("_bucket").isin(touched))
            part = part.join(keys.select(*by).distinct(), by, "left_semi")
            found = part if found is None else found.unionByName(part)
        return found

    def replace(self, keys: DataFrame, rows: DataFrame | None, epoch: tuple[str, int] | None = None, side: list[str] | None = None) -> bool:
        """One version: the live rows that have one of ``keys`` go, and ``rows`` come.

        With an ``epoch`` (a writer's name and its number) the same batch again changes nothing, as a stream's foreachBatch
        needs: False if it was there already. ``side`` names what belongs to this version beside the rows.
        """
        m = self.manifest()
        if self.applied(epoch, m):
            return False
        schema = T.StructType.fromJson(m["schema"]) if m["schema"] else None
        if rows is not None and schema is not None:
            if sorted(rows.columns) != sorted(f.name for f in schema):
                raise ValueError(f"the table has the columns {[f.name for f in schema]}, not {rows.columns}")
            rows = rows.select(*[f.name for f in schema])
        new = None if rows is None else self._write(rows)
        vectors = list(m["vectors"])
        if m["segments"]:
            name = uuid.uuid4().hex
            self.places(keys, m).select("_file", "_row").write.parquet(f"{self.path}/dead/{name}")
            per_segment = self.spark.read.parquet(f"{self.path}/dead/{name}").groupBy(F.regexp_extract("_file", "^_segment=([^/]*)/", 1).alias("of")).agg(F.count("*").alias("n")).collect()  # a row for each segment
            if per_segment:
                vectors.append({"name": name, "rows": sum(r.n for r in per_segment), "of": [r.of for r in per_segment]})
        known = schema or T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        self._commit(m, [*m["segments"], *([new] if new else [])], vectors, known, epoch, side)
        return True

    def applied(self, epoch: tuple[str, int] | None, m: dict | None = None) -> bool:
        """Whether this writer's batch is in the table."""
        return epoch is not None and (self.manifest() if m is None else m)["epochs"].get(epoch[0], -1) >= epoch[1]

    def overwrite(self, rows: DataFrame, side: list[str] | None = None) -> None:
        """One version that has ``rows`` alone; their keys differ."""
        new = self._write(rows)
        self._commit(self.manifest(), [new] if new else [], [], T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]), None, side)

    def upsert(self, rows: DataFrame, order: list[str] | None = None, epoch: tuple[str, int] | None = None) -> bool:
        """``rows`` take the place of those with the same keys, in every column; of equal keys in ``rows`` the last by ``order``, and then by all columns, counts."""
        rest = [c for c in rows.columns if c not in self.keys]
        by = F.struct(*(order or []), *rest)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), by).alias("_last")).select(*self.keys, "_last.*").select(*rows.columns)
        return self.replace(last.select(*self.keys), last, epoch)

    def delete(self, keys: DataFrame, epoch: tuple[str, int] | None = None) -> bool:
        """The rows that have one of ``keys`` (some or all of the table's, the first among them) go. No file is written again."""
        return self.replace(keys, None, epoch) if self.manifest()["segments"] else False

    def compact(self, everything: bool = False) -> int:
        """Merges each ``TIER`` segments of like size, or all into one, without dead rows; how many there were less how many there are."""
        m = self.manifest()
        segments, before = list(m["segments"]), len(m["segments"])
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in segments:
                tiers.setdefault(0 if everything else (s["rows"].bit_length() + 1) // 2, []).append(s)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= (1 if everything else TIER)]
            if not full:
                break
            merged = tiers[full[0]]
            new = self._write(self._live(m, merged).drop(*_OWN))
            segments = [s for s in segments if s not in merged] + ([new] if new else [])
            if everything:
                break
        if segments != m["segments"]:
            self._commit(m, segments, m["vectors"], T.StructType.fromJson(m["schema"]))
        return before - len(segments)
