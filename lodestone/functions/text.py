"""Text functions as columns: cleaning, markup, page classes, hashes and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters that count as readable, the classes of a page and the lengths that part them
READABLE = " .,;:!?-—\n\t()[]«»\"'"
GARBLED_BELOW = 0.6
SCAN_BELOW = 50
OCR_GAIN = 1.5
#: HTML entities that markup cleaning resolves, the ampersand last
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&copy;", "©"), ("&amp;", "&")]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def clean_extracted(c: Column) -> Column:
    """Joins words that a line break hyphenates, collapses white space and line breaks, drops ornamental lines."""
    c = F.replace(c, F.lit("-\n"), F.lit(""))
    c = F.regexp_replace(c, r"(?U)[^\S\n]+", " ")
    c = F.regexp_replace(c, r"(?Um)^[•\-=~*]{3,}\s*$", "")
    return strip(F.regexp_replace(c, r"\n{2,}", "\n"))


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_markdown(c: Column) -> Column:
    """Plain text of Markdown: images become their captions, links their texts, heading and emphasis marks go."""
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\(([^)]+)\)", "[image: $1]($2)")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    c = F.regexp_replace(c, r"(?Um)^#{1,6}\s+", "")
    return strip(unescape(F.regexp_replace(c, "[*_`~]+", "")))


def readable_share(c: Column) -> Column:
    """The share of letters, digits and ordinary punctuation; null for an empty text."""
    odd = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}" + "".join(map(re.escape, READABLE)) + "]", "")
    return F.length(odd) / F.nullif(F.length(c), F.lit(0))


def is_table(c: Column) -> Column:
    return F.contains(c, F.lit("|")) & F.contains(c, F.lit("---"))


def is_garbled(c: Column) -> Column:
    return F.coalesce(~is_table(c) & (readable_share(c) < GARBLED_BELOW), F.lit(False))


def page_class(c: Column, has_tables: Column | None = None) -> Column:
    """empty, scan, garbled or text by length and readable share; table where the page has tables and no good text."""
    plain = F.when(F.length(c) == 0, "empty").when(F.length(c) < SCAN_BELOW, "scan").when(is_garbled(c), "garbled").otherwise("text")
    return plain if has_tables is None else F.when(has_tables & (plain != "text"), "table").otherwise(plain)


def tabular_lines(c: Column) -> Column:
    """Lines with two tabs or a run of four spaces."""
    return F.size(F.filter(F.split(c, "\n"), lambda line: line.rlike("\t[^\t]*\t|    ")))


def needs_ocr(c: Column, min_chars: int, enabled: bool = True) -> Column:
    return F.lit(enabled) & (F.length(strip(c)) < min_chars)


def better_text(extracted: Column, recognised: Column) -> Column:
    """The recognised text only if it is more than half again as long."""
    return F.when(F.length(recognised) > OCR_GAIN * F.length(extracted), recognised).otherwise(extracted)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def article_number(c: Column) -> Column:
    return first_match(c, r"(?U)Статья\s+(\d+[\.\d]*)")


def date_in_name(c: Column) -> Column:
    return first_match(c, r"(\d{4}-\d{2}-\d{2})")


def base_name(c: Column) -> Column:
    """The last part of a path; unknown where there is none."""
    return F.coalesce(F.nullif(F.element_at(F.split(c, "/"), -1), F.lit("")), F.lit("unknown"))


def sanitised(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def markdown_table(rows: Column) -> Column:
    """A Markdown table of an array of rows (arrays of cells): short rows padded, pipes escaped, the first row as header."""
    width = F.array_max(F.transform(rows, F.size))

    def line(cells: Column) -> Column:
        full = F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells)))
        return F.concat(
            F.lit("| "),
            F.array_join(F.transform(full, lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "),
            F.lit(" |"),
        )

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")


def highlighted(c: Column, phrase: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every occurrence of ``phrase``, whatever its case, between two marks."""
    return F.regexp_replace(c, "(?iu)(" + "".join(re.escape(x) if not x.isalnum() else x for x in phrase) + ")", f"{before}$1{after}")
