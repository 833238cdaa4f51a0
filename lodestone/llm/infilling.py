"""Fill-in-the-middle: a text is cut at two ranks of its units and put together as prefix, suffix and middle.

A unit is a code point, or what a pattern matches. The cuts are ranks of units, and the output needs them in code points; an
indexable skip list over the text's units answers both. Lane 0 has an entry for each unit; about a quarter of a lane's entries
are in the lane above. An entry says how many units and how many code points lie between it and the next one of its lane, so a
descent that adds up widths reaches a rank exactly in a number of steps that grows with the logarithm of the text.

Which entries are in a lane follows a golden-ratio sequence of their numbers: reruns agree, and the gaps of a lane have three
lengths at most, so no descent is longer than another by much. A text is a row that stays where it is: nothing is shuffled, and
Python gives back three numbers a text, from which the JVM puts the output together.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the marks of the three parts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_GOLDEN = np.uint32(2_654_435_769)  # 2**32 over the golden ratio
_TOP = 4  # a lane of so few entries has none above


class SkipList:
    """Units of the given widths in code points, under express lanes."""

    def __init__(self, widths: np.ndarray):
        self.units, self.points = len(widths), int(widths.sum(dtype=np.int64))
        self.widths = widths  # lane 0: each entry spans one unit
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # from the lowest up: units, code points, the entry below
        if self.units <= _TOP:
            return
        ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        below = np.arange(self.units, dtype=np.uint32)
        tickets, share = below * _GOLDEN, 1 << 32
        while len(below) > _TOP:
            share >>= 2
            chosen = np.flatnonzero(tickets < share)  # entry 0 has ticket 0 and is in every lane
            below, tickets = below[chosen], tickets[chosen]
            to = np.append(below[1:], np.uint32(self.units))
            self.lanes.append((to - below, ends[to] - ends[below], chosen.astype(np.uint32)))

    def offset(self, rank: int) -> int:
        """The code points before unit ``rank``; ``rank`` may be the number of units."""
        if rank >= self.units:
            return self.points
        at = done = points = 0
        for units, span, down in reversed(self.lanes):
            while done + (step := int(units[at])) <= rank:
                done, points, at = done + step, points + int(span[at]), at + 1
            at = int(down[at])
        for width in self.widths[at : at + rank - done].tolist():
            points += width
        return points


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """The code points of each unit: one each, or what the pattern matches from left to right and the stretches between matches."""
    if unit is None:
        return np.ones(len(text), np.uint8)
    cuts = sorted({0, len(text), *(x for m in unit.finditer(text) for x in m.span())})
    return np.diff(np.array(cuts, np.int64))


def _cuts(unit: str | None):
    pattern = None if unit is None else re.compile(unit)

    def run(texts: pa.Array, marked: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        rows = []
        for k in range(len(texts)):  # one text at a time as a Python object
            text = texts[k].as_py()
            if not marked[k].as_py():
                rows.append((len(text) if pattern is None else len(unit_widths(text, pattern)), None, None))
                continue
            units = SkipList(unit_widths(text, pattern))
            a, b = sorted(h.as_py() % (units.units + 1) for h in (first[k], second[k]))
            start, end = units.offset(a), units.offset(b)
            rows.append((units.units, start, end - start))
        names, columns = ("n", "prefix", "middle"), zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return F.arrow_udf(run, "n long, prefix long, middle long")


def fill_in_middle(docs: DataFrame, unit: str | None = None, percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs(doc_id, text)``.

    n is the number of units. ``percent`` of the texts take a form with parts, and of those ``spm_percent`` have the suffix
    first; two draws are the ranks of the cuts. All draws come from the SHA-256 of ``seed:doc_id``. Empty texts and texts that
    have a mark of their own stay plain: the output is the text and the parts are null. A null text is empty; a null doc_id
    draws as an empty one, and rows of one doc_id draw alike. Other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), digest.alias("draws"))
    draw = [F.conv(F.substring("draws", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.col("text")
    own_mark = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | own_mark | (draw[2] % 100 >= percent)
    form = F.when(plain, "plain").when(draw[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), draw[0].alias("h1"), draw[1].alias("h2"))
    cut = rows.withColumn("cut", _cuts(unit)("text", F.col("form") != "plain", "h1", "h2"))
    start, length = F.col("cut.prefix").cast("int"), F.col("cut.middle").cast("int")
    prefix, middle = F.substring(text, F.lit(1), start), F.substring(text, start + 1, length)
    suffix = F.substring(text, start + length + 1, F.length(text))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    return cut.select("doc_id", F.col("cut.n").alias("n"), "form", F.col("cut.prefix").alias("prefix_chars"), F.col("cut.middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part has a mark, so the marks that are found are those between the parts."""
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
    part = lambda k: F.get(parts, F.lit(k))  # noqa: E731  part 0 is what stands before the first mark: nothing
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
