"""Tokens of the search index, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a token is, and the endings that the stemmer takes off
TOKEN = "[a-zа-яё0-9]{2,}"
LATIN_ENDINGS = ["tion", "sion", "ment", "ness", "able", "ible", "ful", "less", "ous", "ive"]
RUSSIAN_ENDINGS = [
    "ости", "ость", "ений", "ение", "ания", "ями", "ого", "ать", "ить", "ыть", "ять", "ути", "яти", "ей", "ой", "ий", "ый", "ая", "яя", "ое", "ее",
    "ие", "ые", "ов", "ев", "ам", "ям", "ом", "ем", "ах", "ях", "ки", "ка", "ик", "ы", "и", "у", "ю", "я", "е", "а",
]
LEAST_STEM = 3
LEAST_RUSSIAN = 5


def _without(token: Column, endings: list[str]) -> Column:
    """The token without the longest of the endings that leaves ``LEAST_STEM`` letters.

    The leftmost match is the longest ending; tokens whose last letters no ending has never meet the expression.
    """
    shortest = min(2, *map(len, endings))
    last = sorted({e[-shortest:] for e in endings})
    return F.when(F.right(token, F.lit(shortest)).isin(*last), F.regexp_replace(token, f"(?<=.{{{LEAST_STEM}}})(?:{'|'.join(endings)})$", "")).otherwise(token)


def tokenize_raw(text: Column) -> Column:
    """Lower-case runs of two or more Latin or Cyrillic letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def stem(token: Column) -> Column:
    latin = F.octet_length(token) == F.length(token)
    first = F.left(token, F.lit(1))
    russian = (first.between("а", "я") | (first == "ё")) & (F.length(token) >= LEAST_RUSSIAN)
    return F.when(latin, _without(token, LATIN_ENDINGS)).when(russian, _without(token, RUSSIAN_ENDINGS)).otherwise(token)


def tokenize(text: Column) -> Column:
    return F.transform(tokenize_raw(text), stem)


_LATIN, _RUSSIAN = (re.compile(f"(?<=.{{{LEAST_STEM}}})(?:{'|'.join(endings)})$") for endings in (LATIN_ENDINGS, RUSSIAN_ENDINGS))
_TOKENS = re.compile(TOKEN)


def tokens_of(text: str) -> list[str]:
    """What ``tokenize_raw`` gives, inside a task."""
    return _TOKENS.findall(text.lower())


def stem_of(token: str) -> str:
    """What ``stem`` gives, inside a task."""
    if token.isascii():
        return _LATIN.sub("", token)
    return _RUSSIAN.sub("", token) if ("а" <= token[0] <= "я" or token[0] == "ё") and len(token) >= LEAST_RUSSIAN else token
