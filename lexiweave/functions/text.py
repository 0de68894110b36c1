"""Scalar functions on tokens, labels and numbers, as column expressions."""

from __future__ import annotations

import enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Scheme(enum.Enum):
    """How a term is weighted in a document."""

    BOOLEAN = "boolean"
    OCCURRENCES = "occurrences"
    FREQUENCY = "frequency"
    TFIDF = "tfidf"

    @classmethod
    def parse(cls, name: str | Scheme) -> Scheme:
        if isinstance(name, Scheme):
            return name
        try:
            return cls(name.strip().lower())
        except (ValueError, AttributeError):
            raise ValueError(f"unknown weighting scheme: {name!r}") from None


def normalize_token(token: Column) -> Column:
    """Runs of white space become one underscore; case is kept."""
    return F.regexp_replace(token, r"\s+", "_")


def normalize_label(label: Column) -> Column:
    return F.lower(F.replace(label, F.lit(" "), F.lit("_")))


def drop_empty(tokens: Column) -> Column:
    """Without null and empty tokens."""
    return F.filter(tokens, lambda x: x.isNotNull() & (F.length(x) > 0))


def tokenize(text: Column, lower: bool = True) -> Column:
    r"""Split at every ASCII non-word character; null and empty texts have no tokens.

    Tokens are lower-cased after the split: some letters that are no ASCII word characters have a lower case that is.
    """
    tokens = drop_empty(F.split(text, r"\W"))
    return F.coalesce(F.transform(tokens, F.lower) if lower else tokens, F.array().cast("array<string>"))


def term_key(field: Column, token: Column) -> Column:
    """The key of a token of a named field."""
    return F.concat_ws("_", field, token)


def sigmoid(score: Column) -> Column:
    """A decision value as a number between 0 and 1."""
    return 1 / (1 + F.exp(-2 * score))


def dead_zone(weight: Column, least: float = 0.001) -> Column:
    """Weights too small to show are zero."""
    return F.when(F.abs(weight) < least, F.lit(0.0)).otherwise(weight)


def truncated(number: Column, width: int = 5) -> Column:
    """The first characters of a number's text."""
    return F.substring(number.cast("string"), 1, width)
