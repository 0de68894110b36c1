"""Operations on whole corpora: fields, samples, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_fields(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Multi-field documents with only the named fields; a document that has none of them stays, empty."""
    return docs.withColumn("fields", F.filter("fields", lambda f: f["name"].isin(keep)))


def sample(docs: DataFrame, n: int, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """Exactly n rows (all, if there are fewer) drawn by a hash of the key and the seed, the same in every run."""
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return docs.orderBy(draw, key).limit(n)


def complement(docs: DataFrame, drawn: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key was not drawn."""
    return docs.join(drawn.select(key), key, "left_anti")


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for o in others:
        out = out.unionByName(o)
    return out
