"""Pages of documents from what an extractor's port finds: blocks of text with their places, cells of tables, and recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import better_text, markdown_table

LEAST_CHARS = 40  # a page with fewer is recognised from its image


def page_texts(blocks: DataFrame, line_height: int = 10) -> DataFrame:
    """``path, page, text`` from ``blocks(path, page, x, y, text)``: by line, then from left to right."""
    placed = F.struct((F.round(F.col("y") / line_height) * line_height).alias("line"), "x", "text")
    ordered = F.transform(F.array_sort(F.collect_list(placed)), lambda b: b["text"])
    return blocks.groupBy("path", "page").agg(F.array_join(ordered, "\n").alias("text"))


def assembled(texts: DataFrame, tables: DataFrame, recognised: DataFrame | None = None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``path, page, content_type, text``: a document for each page and for each of its tables; a page with tables has no text of its own.

    ``texts(path, page, text)``, ``tables(path, page, nth, cells)``; ``recognised(path, page, text)`` is what a port read from
    the images of pages with fewer than ``least_chars`` characters: it counts there if it is half as long again.
    """
    if recognised is not None:
        seen = recognised.select("path", "page", F.col("text").alias("_seen"))
        both = texts.join(seen, ["path", "page"], "full_outer")
        short = F.length(F.trim(F.coalesce("text", F.lit("")))) < least_chars
        texts = both.select(
            "path", "page",
            F.when(short & F.col("_seen").isNotNull(), better_text(F.coalesce("text", F.lit("")), F.col("_seen"))).otherwise(F.col("text")).alias("text"),
        )
    plain = texts.join(tables.select("path", "page").distinct(), ["path", "page"], "left_anti").filter(F.length(F.trim("text")) > 0)
    grids = tables.filter(F.size("cells") > 0).select("path", "page", F.lit("table").alias("content_type"), markdown_table(F.col("cells")).alias("text"))
    return plain.select("path", "page", F.lit("text").alias("content_type"), "text").unionByName(grids)


def wants_recognition(text: Column, enabled: bool = True, least_chars: int = LEAST_CHARS) -> Column:
    return F.lit(enabled) & (F.length(F.trim(F.coalesce(text, F.lit("")))) < least_chars)
