"""WARC archives from pages, by way of the legacy ARC format.

``arc_archive`` writes pages as ARC records of either version. ``read_arc`` parses the version block, the header lines
that it announces and the declared lengths. ``convert`` makes the equivalent WARC records: identifiers from the content,
timestamps in ISO form, types by URL scheme, digests, and revisits for payloads that another record has. ``write_warc`` and
``read_warc`` do this over tables; an archive is a file of gzip members in the shared folder, at most about ``SHARD_BYTES``.
A task names its archives by its attempt and lists them in a manifest that Spark commits with the task, and archives are read
by the manifest: what a lost or repeated attempt has written is never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Staged, shuffle_partitions, tidy

SHARD_BYTES = 8 << 20
_READ_BYTES = 1 << 16
REVISIT_BYTES = 100  # shorter payloads are always stored
DATE = "20240101000000"
# fixed values: the header fields of the two versions of the ARC format, and names of the WARC format
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lodestone:warc")


class Page(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    content: bytes


def arc_archive(pages: list[Page], name: str, version: int = 1, date: str = DATE) -> bytes:
    """An uncompressed ARC file: the version block, then a header line and an HTTP response per page."""
    info = f"{version} 0 lodestone\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out, at = [], 0

    def add(url: str, kind: str, code: str, content: bytes) -> None:
        nonlocal at
        checksum = hashlib.sha1(content).hexdigest()  # noqa: S324  the format's checksum, not a safeguard
        more = f"{code} {checksum} - {at} {name} " if version == 2 else ""
        record = f"{url} 0.0.0.0 {date} {kind} {more}{len(content)}\n".encode() + content + b"\n"
        out.append(record)
        at += len(record)

    add(f"filedesc://{name}", "text/plain", "200", info)
    for page in pages:
        url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), page.url or "urn:none")
        number = "" if page.page_id is None else f"X-Page-Id: {page.page_id}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(page.payload)}\r\n\r\n"
        add(url, "text/html", "200", head.encode() + page.payload)
    return b"".join(out)


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first. Its field list decides how the following header lines are read."""
    fields = ARC_FIELDS[1]
    at, first = 0, True
    while at < len(raw):
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line does not end")
        line = raw[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:
            at = end + 1
            continue
        # the version block's own header line is of its version, which only its content tells: the length comes last in both
        parts = line.split(" ")
        length = int(parts[-1])
        content = raw[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError("an ARC record is shorter than its declared length")
        if first:
            lines = content.decode("utf-8", "replace").split("\n")
            fields = lines[1].split() if len(lines) > 1 and lines[1].split() else ARC_FIELDS[int(lines[0].split()[0])]
            first = False
        values = [" ".join(parts[: len(parts) - len(fields) + 1]), *parts[len(parts) - len(fields) + 1 :]]  # an old URL may hold spaces
        yield ArcRecord(dict(zip(fields, values, strict=True)), content)
        at = end + 1 + length


def record_id(source: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{source}:{digest}')}>"


def _date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _http(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, gap, payload = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return head + gap, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, payload


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def convert(arc: bytes, originals: dict[tuple[int, str], int]) -> Iterator[bytes]:
    """The WARC record, as a gzip member, of each ARC record. ``originals``: by page and payload digest, the page that it revisits."""
    for fields, content in read_arc(arc):
        uri, date = fields["URL"], _date(fields["Archive-date"])
        if uri.startswith("filedesc://"):
            block = f"software: lodestone\r\nformat: WARC File Format 1.1\r\ndescription: converted from {uri}\r\n".encode()
            yield _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(uri, hashlib.sha256(content).hexdigest())), ("WARC-Date", date), ("WARC-Filename", uri.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")], block)
            continue
        if not content.startswith(b"HTTP/"):
            digest = hashlib.sha256(content).hexdigest()
            yield _record([("WARC-Type", "resource"), ("WARC-Record-ID", record_id(uri, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Block-Digest", f"sha256:{digest}"), ("Content-Type", fields["Content-type"])], content)
            continue
        head, http, payload = _http(content)
        digest, page = hashlib.sha256(payload).hexdigest(), http.get("x-page-id")
        source = page if page is not None else uri
        original = originals.get((int(page), digest)) if page is not None else None
        block = content if original is None else head
        headers = [
            ("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", record_id(source, digest)), ("WARC-Date", date),
            ("WARC-Target-URI", uri), ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response"),
        ]
        if original is not None:
            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(original, digest)), ("X-Refers-To-Page", str(original))]
        yield _record(headers, block)


def read_members(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each WARC record in a stream of gzip members, by the declared lengths."""
    rest = read(_READ_BYTES)
    while rest:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                raise ValueError("an archive ends inside a record")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else read(_READ_BYTES)
        rest = rest or read(_READ_BYTES)
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, block[: int(headers["content-length"])]


MANIFEST = "manifest.parquet"  # file string, records long, bytes long


def _write(path: str, arc_version: int, run_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(path)
        held: list[Page] = []
        originals: dict[tuple[int, str], int] = {}
        size = k = 0

        def close() -> pa.RecordBatch:
            nonlocal size, k
            name = f"part-{run_id}-{task.partitionId():06d}-{task.taskAttemptId()}-{k:05d}"
            n = 0
            with store.open_output_stream(f"{base}/{name}.warc.gz") as f:
                for member in convert(arc_archive(held, f"{name}.arc", arc_version), originals):
                    f.write(member)
                    n += len(member)
            row = pa.RecordBatch.from_pydict({"file": [f"{name}.warc.gz"], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([n], pa.int64())})
            held.clear()
            originals.clear()
            size, k = 0, k + 1
            return row

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(Page(page_id, url, payload))
                if first is not None and first != page_id and page_id is not None:
                    originals[page_id, digest] = first
                size += len(payload)
                if size >= SHARD_BYTES:
                    yield close()
        if held:
            yield close()

    return run


def write_warc(pages: DataFrame, path: str, arc_version: int = 1, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one WARC record per row under ``path`` (a URI that pyarrow can write) and returns its manifest, ``file, records, bytes``.

    Of rows with equal payloads of ``REVISIT_BYTES`` or more, those with the smallest page_id are responses and the others
    revisits of it. Null html is an empty payload. Rows with a null page_id, and repeated rows of the smallest, are responses.
    Rows with one page_id and different payloads go by the digest of each. An empty table writes no archive. A second
    write to one path adds to its archives.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = (
        pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
        .withColumn("digest", F.sha2("payload", 256))
    )
    groups = rows.filter(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # written, so that Spark knows its size when it picks the join
    groups = Staged(groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "equal-payloads").df
    joined = rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", "first")
    manifest = joined.mapInArrow(tidy(_write(path, arc_version, uuid.uuid4().hex[:8])), "file string, records long, bytes long")
    manifest.write.mode("append").parquet(f"{path}/{MANIFEST}")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{path}/{MANIFEST}")


READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _read(path: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/{name}") as f:
                    for headers, block in read_members(f.read):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        _, http, payload = _http(block)
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"the payload of {headers['warc-record-id']} does not have its digest")
                        page, refers = http.get("x-page-id"), headers.get("x-refers-to-page")
                        # a revisit keeps the response's HTTP headers, whose length is that of the full payload
                        rows.append(
                            (None if page is None else int(page), headers["warc-target-uri"], kind, payload if with_payload else None, int(http["content-length"]), digest, None if refers is None else int(refers))
                        )
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The responses and revisits under ``path``, archive by archive in parallel; a revisit has no payload, but its size and digest."""
    manifest = spark.read.schema("file string").parquet(f"{path}/{MANIFEST}")
    files = manifest.repartition(shuffle_partitions(spark), "file")
    return files.mapInArrow(tidy(_read(path, with_payload)), READ)
