"""Text into chunks: fixed strides in built-in functions, recursive separators as a table function, islands of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import strip

# fixed values: where texts are cut, from the best place to the worst, and the sizes of chunks
GENERAL = ["\n# ", "\n## ", "\n### ", "\n#### ", "\n\n", "\n", " ", ""]
LEGAL = ["\nГлава ", "\nРаздел ", "\nЧасть ", "\nСтатья ", "\n§ ", "\nПункт ", "\n\n", "\n", " ", ""]
SIZES = {"general": (550, 200), "legal": (1000, 250)}
TABLE_LINE = r"^\|.+\|\s*$"
CHUNK_ROWS = 512  # chunks that leave Python together


def stride_chunks(df: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """``df`` with ``chunk_index, chunk``: windows of ``size`` characters every ``size - overlap``; the last may be shorter."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    out = df.select("*", F.posexplode(starts).alias("chunk_index", "_start"))
    return out.withColumn("chunk", F.substring(F.col(text), F.col("_start") + 1, F.lit(size))).drop("_start")


def split_recursively(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Pieces of at most ``size`` characters where a separator allows: cut at the first separator that occurs, each at its
    piece's head; pieces that are still too long go on with the next ones; neighbours are merged up to ``size``, and a
    chunk begins with as many whole pieces of the one before as fit in ``overlap``."""
    out: list[str] = []

    def merge(pieces: list[str]) -> None:
        held: list[str] = []
        length = 0
        for p in pieces:
            if held and length + len(p) > size:
                emit(held)
                while held and (length > overlap or length + len(p) > size):
                    length -= len(held.pop(0))
            held.append(p)
            length += len(p)
        if held:
            emit(held)

    def emit(held: list[str]) -> None:
        chunk = "".join(held).strip()
        if chunk:
            out.append(chunk)

    def cut(text: str, seps: list[str]) -> None:
        at = next((k for k, s in enumerate(seps) if not s or s in text), len(seps) - 1)
        sep, rest = seps[at], seps[at + 1 :]
        if sep:
            parts = text.split(sep)
            pieces = [p for p in [parts[0], *(sep + x for x in parts[1:])] if p]
        else:
            pieces = list(text)
        small: list[str] = []
        for p in pieces:
            if len(p) <= size:
                small.append(p)
                continue
            if small:
                merge(small)
                small = []
            if rest:
                cut(p, rest)
            else:
                emit([p])
        if small:
            merge(small)

    if text:
        cut(text, separators)
    return out


def recursive_chunks(df: DataFrame, domain: str = "general", text: str = "text", size: int | None = None, overlap: int | None = None) -> DataFrame:
    """``df`` without its text, and with ``chunk_index, chunk``; rows whose ``content_type`` is table stay one chunk in the general domain.

    Splitting at the first separator that fits, and again inside what is still too long, is no built-in operation; texts go
    through it one at a time, and come out a few hundred chunks a batch. The other columns are repeated for each chunk, the
    text is not: its copies would grow with the square of its length.
    """
    size, overlap = size or SIZES[domain][0], SIZES[domain][1] if overlap is None else overlap
    separators = LEGAL if domain == "legal" else GENERAL
    whole = domain != "legal" and "content_type" in df.columns
    fields = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in fields]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.select(names)
            kinds = batch.column("content_type").to_pylist() if whole else [None] * batch.num_rows
            rows, index, chunks = [], [], []

            def found(k: int) -> pa.RecordBatch:
                out = [*others.take(pa.array(rows[:k], pa.int64())).columns, pa.array(index[:k], pa.int32()), pa.array(chunks[:k], pa.string())]
                del rows[:k], index[:k], chunks[:k]
                return pa.RecordBatch.from_arrays(out, names=[*names, "chunk_index", "chunk"])

            for k, (t, kind) in enumerate(zip(batch.column(text), kinds, strict=True)):
                parts = [t.as_py()] if kind == "table" else split_recursively(t.as_py() or "", size, overlap, separators)
                for i in range(0, len(parts), CHUNK_ROWS):
                    some = parts[i : i + CHUNK_ROWS]
                    rows += [k] * len(some)
                    index += range(i, i + len(some))
                    chunks += some
                    if len(rows) >= CHUNK_ROWS:
                        yield found(CHUNK_ROWS)
            if rows:
                yield found(len(rows))

    return df.mapInArrow(split, T.StructType([*fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType())]))


def register_chunker(spark: SparkSession, name: str = "chunk_text") -> None:
    """A table function for SQL: ``chunk_text(text, size, overlap)`` gives ``chunk_index, chunk``, to be called with LATERAL."""

    @F.udtf(returnType="chunk_index int, chunk string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(split_recursively(text or "", size, overlap, GENERAL))

    spark.udtf.register(name, ChunkText)


def _runs(df: DataFrame, key: str, text: str, mark: Callable[[Column], Column], starts: Callable[[Column, Column], Column]) -> DataFrame:
    """``key, runs``: the runs of lines of each text; one starts at the first line and where ``starts(mark, mark of the line before)``.

    Inside the row and in one pass, so nothing is shuffled: a line that starts a run gets a line break in front, others a
    space, so that joined lines have two line breaks together only where a run starts, and are split there.
    """
    rows = df.select(key, F.split(text, "\n").alias("_lines"))
    rows = rows.withColumn("_marks", F.transform("_lines", mark))
    led = lambda x, i: F.concat(F.when(F.coalesce(starts(F.get("_marks", i), F.get("_marks", i - 1)), F.lit(False)) & (i > 0), "\n").otherwise(" "), x)
    joined = F.substring(F.array_join(F.transform("_lines", led), "\n"), F.lit(2), F.lit((1 << 31) - 1))
    return rows.select(key, F.transform(F.split(joined, "\n\n"), lambda r: F.replace(r, F.lit("\n "), F.lit("\n"))).alias("runs"))


def islands(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, segment, kind, content``: runs of table lines and of other lines, without blank segments, in order."""
    first = lambda r: F.substring_index(r, "\n", 1)
    part = lambda r: F.struct(F.when(first(r).rlike(TABLE_LINE), "table").otherwise("text").alias("kind"), strip(r).alias("content"))
    rows = _runs(df, key, text, lambda x: x.rlike(TABLE_LINE), lambda now, before: now != before)
    parts = rows.select(key, F.filter(F.transform("runs", part), lambda x: F.length(x["content"]) > 0).alias("parts"))
    # the outer form, as Spark would test the plain one's array first, with the whole expression put into the test for each line
    return parts.select(key, F.posexplode_outer("parts").alias("segment", "part")).filter("part is not null").select(key, "segment", "part.kind", "part.content")


def sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, section, heading, content``: the text between Markdown headings; what comes before the first has a null heading."""
    heading = lambda x: F.nullif(F.regexp_extract(x, r"^#{1,6}\s+(.*)$", 1), F.lit(""))
    rows = _runs(df, key, text, heading, lambda now, _: now.isNotNull())
    runs = rows.select(key, F.posexplode_outer("runs").alias("nth", "run"), heading(F.substring_index(F.get("runs", F.lit(0)), "\n", 1)).isNotNull().cast("int").alias("led"))
    first = F.substring_index("run", "\n", 1)
    named = runs.filter("run is not null").select(key, (F.col("nth") + F.col("led")).alias("section"), heading(first).alias("heading"), "run", F.length(first).alias("skip"))
    body = F.when(F.col("heading").isNull(), F.col("run")).otherwise(F.substring("run", F.col("skip") + 1, F.length("run")))
    return named.select(key, "section", "heading", strip(body).alias("content")).filter((F.length("content") > 0) | F.col("heading").isNotNull())


def merge_pages(df: DataFrame, by: str = "source", page: str = "page", text: str = "text") -> DataFrame:
    """``by, content, page_start, page_end, pages``: the pages of each source in order, parted by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    return df.groupBy(by).agg(
        F.array_join(F.transform(ordered, lambda x: x[text]), "\n\n").alias("content"), F.min(page).alias("page_start"), F.max(page).alias("page_end"),
        F.array_sort(F.collect_set(page)).alias("pages"),
    )


def with_heading(heading: Column, content: Column) -> Column:
    return F.when(heading.isNotNull(), F.concat(heading, F.lit("\n\n"), content)).otherwise(content)


def numbered(df: DataFrame, by: str, order: list[Column], start: Column | int = 0) -> DataFrame:
    """``chunk_index`` within ``by``; ``start`` may be the next free index of each group."""
    return df.withColumn("chunk_index", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1 + start)
