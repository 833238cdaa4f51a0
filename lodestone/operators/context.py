"""The context of an answer: numbered fragments under a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import base_name

# fixed values: how fragments are labelled and joined
SEPARATOR = "\n\n---\n\n"
SEPARATOR_CHARS = 6  # what the budget counts for it
CHARS_PER_TOKEN = 4


def header(number: Column, source: Column, page: Column, page_start: Column, page_end: Column, doc_date: Column, article: Column, content_type: Column) -> Column:
    """[n] name, with a table mark, a date, and the article or else the pages."""
    place = (
        F.when(article.isNotNull(), F.concat(F.lit(", ст. "), article))
        .when(page_start.isNotNull() & page_end.isNotNull() & (page_start != page_end), F.concat(F.lit(" (стр. "), page_start.cast("string"), F.lit("-"), page_end.cast("string"), F.lit(")")))
        .when(page.isNotNull(), F.concat(F.lit(" (стр. "), page.cast("string"), F.lit(")"))).otherwise("")
    )
    table = F.when(content_type == "table", " (таблица)").otherwise("")
    date = F.coalesce(F.concat(F.lit(" от "), doc_date), F.lit(""))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), base_name(source), table, date, place)


def within_budget(df: DataFrame, by: str, chars: Column, budget: Column | int) -> DataFrame:
    """The rows before the first that overflows; the first row always stays, and nothing after an overflow comes back."""
    w = Window.partitionBy(by).orderBy("rank")
    spent = F.coalesce(F.sum(chars + SEPARATOR_CHARS).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = (spent + chars > budget) & (F.col("rank") > 1)
    return df.withColumn("_over", F.max(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_over = 0").drop("_over")


def joined(df: DataFrame, by: str, part: str) -> DataFrame:
    """``by, context, n_parts``: the parts in rank order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part))), lambda x: x[part])
    return df.groupBy(by).agg(F.array_join(parts, SEPARATOR).alias("context"), F.count("*").alias("n_parts"))


def recent_turns(messages: DataFrame, by: str, order: str, n: int, least_chars: int = 3) -> DataFrame:
    """The last n messages of each conversation that are not blank or shorter than ``least_chars``, without a last one by the user, oldest first."""
    said = messages.filter(F.length(F.trim("content")) >= least_chars)
    w = Window.partitionBy(by)
    nth = F.row_number().over(w.orderBy(F.desc(order)))
    said = said.withColumn("_nth", nth)
    said = said.filter(~((F.col("_nth") == 1) & (F.col("role") == "user"))).withColumn("_nth", F.row_number().over(w.orderBy(F.desc(order))))
    return said.filter(F.col("_nth") <= n).withColumn("position", F.row_number().over(w.orderBy(order))).drop("_nth")


def older_turns(messages: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The messages before the last n of each conversation, with their ``position``: what a rolling summary takes in."""
    w = Window.partitionBy(by)
    placed = messages.withColumn("_nth", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("position", F.row_number().over(w.orderBy(order)))
    return placed.filter(F.col("_nth") > n).drop("_nth")


def transcript(turns: DataFrame, by: str, most_chars: int = 200) -> DataFrame:
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring("content", 1, most_chars))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])
    return turns.groupBy(by).agg(F.array_join(lines, "\n").alias("transcript"))
