"""The Porter stemmer with the two later rules (bli to ble, logi to log), applied to distinct terms only."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWELS = frozenset("aeiou")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out: list[str] = []
    for c in word:
        out.append("v" if c in _VOWELS or (c == "y" and out and out[-1] == "c") else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    """How many times a vowel run is followed by a consonant run."""
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x or y."""
    return len(word) > 2 and _shape(word).endswith("cvc") and word[-1] not in "wxy"


_TWO = dict(p.split(":") for p in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize "
    "ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
).split())
_THREE = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_FOUR = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(word: str, ends) -> str | None:
    return max((e for e in ends if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    end = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else ""
    if not end or "v" not in _shape(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _double(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _short_end(w) else w


def _final_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and "v" in _shape(w[:-1]) else w


def _replace(w: str, rules: dict[str, str]) -> str:
    end = _longest(w, rules)
    return w[: -len(end)] + rules[end] if end and _measure(w[: -len(end)]) else w


def _drop(w: str) -> str:
    end = _longest(w, _FOUR)
    if not end or (end == "ion" and not w[:-3].endswith(("s", "t"))):
        return w
    return w[: -len(end)] if _measure(w[: -len(end)]) > 1 else w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    return _tidy(_drop(_replace(_replace(_final_y(_past(_plural(word))), _TWO), _THREE)))


class StemBuffer:
    """Letters added one by one or in runs, then stemmed as one word."""

    def __init__(self) -> None:
        self._letters: list[str] = []
        self._result = ""

    def add(self, letters: str) -> None:
        self._letters += letters

    def stem(self) -> None:
        self._result = stem("".join(self._letters))
        self._letters = []

    def __len__(self) -> int:
        return len(self._result)

    def __str__(self) -> str:
        return self._result


@F.pandas_udf(StringType())
def stem_column(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in words:
        yield s.map(stem, na_action="ignore")


def stem_terms(terms: DataFrame, column: str = "token") -> DataFrame:
    """column, stem of the distinct terms of a table."""
    return terms.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("stem", stem_column(column))


def stem_tokens(tokens: DataFrame, column: str = "token") -> DataFrame:
    """A long table of tokens with each replaced by its stem; only distinct terms are stemmed."""
    stems = stem_terms(tokens, column).withColumnRenamed("stem", "_stem")
    return tokens.join(stems, column, "left").withColumn(column, F.col("_stem")).drop("_stem").select(tokens.columns)


_WORD = re.compile(r"[A-Za-z]+")


@F.pandas_udf(StringType())
def _stem_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _WORD.sub(lambda m: stem(m.group().lower()), t), na_action="ignore")


def stem_text(text: Column) -> Column:
    """A text with every run of ASCII letters lower-cased and stemmed; all else stays."""
    return _stem_text(text)
