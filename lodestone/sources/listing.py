"""Files of a folder or bucket as a data source, for batches and streams, in the order of their keys.

A partition is a prefix, so tasks list side by side; extensions, sizes and the start of the key are options, applied while
listing, before any file is opened. (Filters of a query are not pushed down: Spark 4.1 keeps what was pushed with the
loaded table, and a second query of the same DataFrame without a filter would lose rows.) Content is read only if asked for, a file at a time. A stream's offset is the last key
that it has seen: it takes up keys that sort after it, as uploads named by date do.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "lodestone_files"
BATCH = 1000  # rows of a listing at a time
MAX_BATCH_BYTES = 64 << 20
ARROW = [("key", pa.string()), ("filename", pa.string()), ("extension", pa.string()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Prefix(InputPartition):
    """Keys below ``folder`` (of one level only, if not ``deep``), after ``start`` and up to ``end``."""

    def __init__(self, folder: str, deep: bool, start: str = "", end: str | None = None):
        self.folder, self.deep, self.start, self.end = folder, deep, start, end


def _children(files, root: str, folder: str) -> list[tuple[str, object]]:
    """(key, entry) of what is in a folder, in key order; a folder's key ends with a slash. Hidden and temporary names are passed over."""
    from pyarrow import fs

    out = []
    for x in files.get_file_info(fs.FileSelector(posixpath.join(root, folder) if folder else root, allow_not_found=True)):
        if x.base_name and x.base_name[0] not in "._":
            out.append((folder + x.base_name + ("/" if x.type == fs.FileType.Directory else ""), x))
    return sorted(out, key=lambda p: p[0])


def _walk(files, root: str, part: Prefix) -> Iterator[tuple[str, object]]:
    """The files of a partition in key order; folders outside the range of keys are not opened."""
    for key, x in _children(files, root, part.folder):
        if part.end is not None and key > part.end and not (key.endswith("/") and part.end.startswith(key)):
            return
        if key.endswith("/"):
            # a folder all of whose keys sort at or before the start has nothing new
            if part.deep and (key > part.start or part.start.startswith(key)):
                yield from _walk(files, root, Prefix(key, True, part.start, part.end))
        elif key > part.start:
            yield key, x


def _last_key(files, root: str, folder: str = "") -> str:
    """The greatest key, found by going down the last folders only."""
    for key, _ in reversed(_children(files, root, folder)):
        found = _last_key(files, root, key) if key.endswith("/") else key
        if found:
            return found
    return ""


class _Reading:
    """What batches and streams share: prefixes to partitions, files to rows."""

    def __init__(self, options: dict):
        self.path, self.content = options["path"], options.get("content", "false").lower() == "true"
        self.extensions = [x for x in options.get("extensions", "").split(",") if x]
        self.least, self.most, self.prefix = int(options.get("least", 0)), int(options.get("most", 2**63 - 1)), options.get("prefix", "")

    def prefixes(self, start: str = "", end: str | None = None) -> list[Prefix]:
        files, root = _store(self.path)
        folders = [key for key, _ in _children(files, root, "") if key.endswith("/")]
        folders = [f for f in folders if (f > start or start.startswith(f)) and (end is None or f <= end)]
        return [Prefix("", False, start, end)] + [Prefix(f, True, start, end) for f in folders if f.startswith(self.prefix) or self.prefix.startswith(f)]

    def _wanted(self, row: dict) -> bool:
        right = self.least <= row["size_bytes"] <= self.most and (not self.extensions or row["extension"] in self.extensions)
        return right and row["key"].startswith(self.prefix)

    def rows(self, part: Prefix) -> Iterator[pa.RecordBatch]:
        files, root = _store(self.path)
        held, size = [], 0
        for key, x in _walk(files, root, part):
            row = {"key": key, "filename": x.base_name, "extension": posixpath.splitext(x.base_name)[1].lower(), "size_bytes": x.size, "modified": x.mtime}
            if not self._wanted(row):
                continue
            if self.content:
                if held and size + x.size > MAX_BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
                with files.open_input_stream(x.path) as stream:
                    row["content"] = stream.read()
                size += x.size
            held.append(row)
            if len(held) == BATCH:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema([*ARROW, *([("content", pa.binary())] if self.content else [])]))


class _Batch(DataSourceReader, _Reading):
    def __init__(self, options: dict):
        _Reading.__init__(self, options)

    def partitions(self) -> list[Prefix]:
        return self.prefixes()

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class _Stream(DataSourceStreamReader, _Reading):
    def __init__(self, options: dict):
        _Reading.__init__(self, options)

    def initialOffset(self) -> dict:
        return {"key": ""}

    def latestOffset(self) -> dict:
        return {"key": _last_key(*_store(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Prefix]:
        return self.prefixes(start["key"], end["key"])

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class FileListing(DataSource):
    """``key, filename, extension, size_bytes, modified`` and, with the option ``content``, ``content`` of the files below the option ``path``.

    Further options: ``extensions`` (with commas between them, lower case with their dot), ``least`` and ``most`` bytes, and
    the ``prefix`` that keys begin with.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        columns = "key string, filename string, extension string, size_bytes long, modified timestamp"
        return columns + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def _options(path: str, content: bool, extensions: list[str] | None, least: int, most: int | None, prefix: str) -> dict[str, str]:
    options = {"path": path, "content": str(content).lower(), "extensions": ",".join(extensions or []), "least": str(least), "prefix": prefix}
    return options if most is None else {**options, "most": str(most)}


def files_of(
    spark: SparkSession, path: str, content: bool = False, extensions: list[str] | None = None, least: int = 0, most: int | None = None, prefix: str = ""
) -> DataFrame:
    """The files below ``path``; empty where there are none or no such folder. Hidden and temporary files (``.``, ``_``) are left out."""
    spark.dataSource.register(FileListing)
    return spark.read.format(NAME).options(**_options(path, content, extensions, least, most, prefix)).load()


def new_files(
    spark: SparkSession, path: str, content: bool = False, extensions: list[str] | None = None, least: int = 0, most: int | None = None, prefix: str = ""
) -> DataFrame:
    """A stream of the files below ``path`` whose keys sort after all that came before."""
    spark.dataSource.register(FileListing)
    return spark.readStream.format(NAME).options(**_options(path, content, extensions, least, most, prefix)).load()
