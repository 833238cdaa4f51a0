"""Files into documents: listings, parsers by format, and what is already indexed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import strip, strip_markdown

# fixed values: the kinds of files that are read, and the shortest text that counts as one
EXTENSIONS = [".pdf", ".docx", ".doc", ".rtf", ".md", ".txt"]
LEAST_CHARS = 20
REGISTRY = "filename string, hash string, chunks long, chars long, indexed_at string"


def listing(spark: SparkSession, path: str, extensions: list[str] | None = None, content: bool = False) -> DataFrame:
    """``path, filename, extension, size_bytes, modified, fingerprint`` (and ``content``) of the files below ``path``, wherever Spark can read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    out = df.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), ext.alias("extension"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"), fingerprint(F.col("length"), F.col("modificationTime")).alias("fingerprint"), *(["content"] if content else []),
    )
    return out.filter(F.col("extension").isin(extensions or EXTENSIONS))


def fingerprint(size: Column, modified: Column) -> Column:
    return F.concat_ws("_", size.cast("string"), F.unix_seconds(modified.cast("timestamp")).cast("string"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The files that are indexed; none where there is no registry, and lines that do not parse are left out."""
    try:
        return spark.read.schema(REGISTRY).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], REGISTRY)


def not_indexed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that the registry does not have with this name and fingerprint."""
    return files.join(known.select("filename", F.col("hash").alias("fingerprint")), ["filename", "fingerprint"], "left_anti")


def registry_entries(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """A registry row for each file of ``chunks(filename, content)``."""
    sums = chunks.groupBy("filename").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
    return (
        files.select("filename", F.col("fingerprint").alias("hash"))
        .join(sums, "filename")
        .withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    )


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}docPr"


class DocxBlock(NamedTuple):
    style: str | None
    text: str
    table: bool
    page: int  # from 1, by manual page breaks


def _docx_run(node: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n"}
    return "".join((x.text or "") if x.tag == f"{_W}t" else "" if x.get(f"{_W}type") == "page" else marks.get(x.tag, "") for x in node.iter())


def docx_blocks(content: bytes) -> list[DocxBlock]:
    """The paragraphs and tables of a DOCX file in order, tables as Markdown, list items with their indent, and last the descriptions of images."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")  # noqa: S314  the parser resolves no external entities
    out: list[DocxBlock] = []
    images: list[DocxBlock] = []
    page = 1
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            page += any(x.get(f"{_W}type") == "page" for x in node.iter(f"{_W}br"))
            style, item = node.find(f"{_W}pPr/{_W}pStyle"), node.find(f"{_W}pPr/{_W}numPr")
            level = None if item is None else item.find(f"{_W}ilvl")
            prefix = "" if item is None else "  " * int(level.get(f"{_W}val", "0") if level is not None else 0) + "- "
            text = _docx_run(node)
            out.append(DocxBlock(None if style is None else style.get(f"{_W}val"), prefix + text if text.strip() else "", False, page))
            images += [DocxBlock(None, f"[image: {x.get('descr').strip()}]", False, page) for x in node.iter(_DRAWING) if (x.get("descr") or "").strip()]
        elif node.tag == f"{_W}tbl":
            rows = [[" ".join(_docx_run(c).split()).replace("|", "\\|") for c in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")]
            if rows:
                out.append(DocxBlock(None, markdown_table(rows), True, page))
    return out + images


def markdown_table(rows: list[list[str]]) -> str:
    """Rows of escaped cells as a Markdown table; shorter rows end in empty cells."""
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines else ""


def docx_pages(content: bytes) -> tuple[int | None, int | None, list[int]]:
    """First page, last page and all pages that have text."""
    pages = sorted({b.page for b in docx_blocks(content) if b.text.strip() and not b.table and not b.text.startswith("[image: ")})
    return (pages[0], pages[-1], pages) if pages else (None, None, [])


def docx_text(content: bytes) -> str:
    """Paragraphs, then tables."""
    blocks = docx_blocks(content)
    return "\n".join(b.text for b in blocks if not b.table) + "".join("\n\n" + b.text for b in blocks if b.table)


def docx_sections(content: bytes) -> list[tuple[str | None, str]]:
    """(heading, text) at each heading or title style; the tables come last, without a heading."""
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    tables = []
    for style, text, table, _ in docx_blocks(content):
        if table:
            tables.append(text)
        elif style and re.match(r"heading|title", style, re.I):
            out.append((text.strip(), []))
        else:
            out[-1][1].append(text)
    done = [(h, "\n".join(t).strip()) for h, t in out]
    return [(h, t) for h, t in done if h or t] + ([(None, "\n\n".join(tables))] if tables else [])


def rtf_text(content: bytes) -> str:
    """The plain text of RTF: control words go, paragraphs break lines, hex and Unicode escapes are resolved, groups of fonts, colours and pictures are left out."""
    raw, out, hidden, skip = content.decode("latin-1"), [], [False], 0
    for m in re.finditer(r"\\u(-?\d+) ?|\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", raw, re.S):
        uni, hexa, word, _, symbol, brace, text = m.groups()
        if brace == "{":
            hidden.append(hidden[-1])
        elif brace == "}":
            if len(hidden) > 1:
                hidden.pop()
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer") or symbol == "*":
            hidden[-1] = True
        elif hidden[-1]:
            continue
        elif uni:
            out.append(chr(int(uni) % 65536))
            skip = 1
        elif hexa:
            out.append("" if skip else bytes([int(hexa, 16)]).decode("cp1251", "replace"))
            skip = 0
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif text:
            out.append(text[1:] if skip and text[:1] == "?" else text)
            skip = 0
    return "".join(out).strip()


Port = Callable[[bytes], str]


def parse(files: DataFrame, ports: dict[str, Port] | None = None) -> DataFrame:
    """``path, filename, extension, text, error`` of ``listing(..., content=True)``.

    Text and Markdown are decoded with replacement, DOCX and RTF by the parsers here; for other kinds ``ports`` has
    a function of the bytes, and only these kinds' bytes go to Python. A failure or a text of under ``LEAST_CHARS`` characters gives an error and no text.
    """
    readers: dict[str, Port] = {".docx": docx_text, ".rtf": rtf_text} | (ports or {})

    @F.pandas_udf("text string, error string")
    def read(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, ext in zip(content, extension, strict=True):
            try:
                rows.append((readers[ext](raw), None) if ext in readers else (None, "unsupported"))
            except Exception as e:  # noqa: BLE001  any broken file is a row with an error
                rows.append((None, type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "error"])

    plain = F.col("extension").isin(".txt", ".md") & ~F.col("extension").isin(*readers)
    parsed = files.withColumn(
        "_p",
        F.when(plain, F.struct(F.col("content").cast("string").alias("text"), F.lit(None).cast("string").alias("error"))).otherwise(read(F.when(~plain, F.col("content")), "extension")),
    )
    text = F.when(F.col("extension") == ".md", strip_markdown(F.col("_p.text"))).otherwise(F.col("_p.text"))
    short = F.coalesce(F.length(strip(text)), F.lit(0)) < LEAST_CHARS
    error = F.coalesce(F.col("_p.error"), F.when(short, "too_short"))
    return parsed.select("path", "filename", "extension", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """``id, question, expected_answer, source_hint`` from a JSON array; blank questions are left out."""
    df = spark.read.schema("id string, question string, expected_answer string, source_hint string").json(path, multiLine=True)
    return df.filter(F.length(F.trim("question")) > 0)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark runs from JSON lines, those that do not parse left out."""
    return spark.read.schema("ts timestamp, dataset string, filename string, metrics map<string,double>").option("mode", "DROPMALFORMED").json(path)


def model_list(spark: SparkSession, body: str, part: str = "") -> DataFrame:
    """``id, name, prompt_price, completion_price`` per million tokens of a service's model list in JSON, by name."""
    schema = "data array<struct<id string, name string, pricing struct<prompt string, completion string>>>"
    rows = spark.createDataFrame([(body,)], "body string").select(F.explode(F.from_json("body", schema)["data"]).alias("m"))
    price = lambda f: F.round(F.col(f"m.pricing.{f}").try_cast("double") * 1e6, 6)
    return (
        rows.filter(F.contains(F.lower("m.id"), F.lit(part.lower())))
        .select("m.id", "m.name", price("prompt").alias("prompt_price"), price("completion").alias("completion_price"))
        .orderBy(F.lower("name"))
    )
