"""Scores of attributes against class labels, and selection by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions.session import kept
from lexiweave.operators import chunks
from lexiweave.operators.lexicon import Lexicon
from lexiweave.operators.weighting import in_chunks, vectors


def contingency(vectors: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """attr_id, label, total: weights summed by cell, with the marginals (label null), (attr_id null) and both null.

    vectors: doc_id, attr_id, value; labels: doc_id, label. Without labels, what is given is a table of summed(), here and
    below.
    """
    return (vectors if labels is None else _summed(vectors, labels)).cube("attr_id", "label").agg(F.sum("o").alias("total"))


def summed(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """attr_id, label, o: the non-zero weights of labelled documents, summed by cell."""
    if in_chunks(docs):
        return chunks.cells(docs, lexicon.terms, lexicon.scheme.value, lexicon.doc_num, lexicon.normalize)
    return _summed(vectors(docs, lexicon), docs.select("doc_id", "label"))


def _summed(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    return vectors.join(labels, "doc_id").filter("value <> 0").groupBy("attr_id", "label").agg(F.sum("value").alias("o"))


def cells(vectors: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """attr_id, label, o, ta, tc, t: every non-zero cell with its row, column and grand totals. The cells are written, so
    that vectors are read once."""
    o = kept(vectors if labels is None else _summed(vectors, labels), "cells")
    rows = Window.partitionBy("attr_id")
    column = o.groupBy("label").agg(F.sum("o").alias("tc"))
    grand = column.agg(F.sum("tc").alias("t"))
    return o.withColumn("ta", F.sum("o").over(rows)).join(F.broadcast(column), "label").crossJoin(F.broadcast(grand))


def cell_scores(vectors: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """attr_id, label, score: each cell's signed share of the log-likelihood ratio, usable as a weight for the label."""
    return cells(vectors, labels).select("attr_id", "label", (2 * F.col("o") * F.log(F.col("o") / (F.col("ta") * F.col("tc") / F.col("t")))).alias("score"))


def log_likelihood(vectors: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """attr_id, score: the log-likelihood ratio of every attribute with a non-zero weight."""
    return cell_scores(vectors, labels).groupBy("attr_id").agg(F.sum("score").alias("score"))


def chi_square(vectors: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """attr_id, score: the 2 x 2 statistic of the attribute against each label, summed over labels."""
    c = cells(vectors, labels)
    column = c.select("label", "tc").distinct()
    # labels that an attribute lacks count too: their cell is 0
    full = c.select("attr_id", "ta", "t").distinct().crossJoin(F.broadcast(column)).join(c.select("attr_id", "label", "o"), ["attr_id", "label"], "left").fillna(0.0, ["o"])
    a, ta, tc, t = (F.col(x) for x in ("o", "ta", "tc", "t"))
    b, k = ta - a, tc - a
    d = t - a - b - k
    statistic = F.try_divide(t * (a * d - k * b) * (a * d - k * b), tc * (t - tc) * ta * (t - ta))
    return full.groupBy("attr_id").agg(F.sum(F.coalesce(statistic, F.lit(0.0))).alias("score"))


def nth_score(scores: DataFrame, n: int) -> DataFrame:
    """One row: the n-th best score, or the worst if there are fewer."""
    return scores.orderBy(F.desc("score")).limit(n).agg(F.min("score").alias("score"))


def select_best(terms: DataFrame, scores: DataFrame, n: int, digits: int | None = None) -> DataFrame:
    """The terms whose score is at least the n-th best; ties at that place are all kept. All terms if there are not more
    than n; unscored terms count as -1. The n-th best comes from a bounded sort, so no task sees all terms."""
    if n < 1:
        raise ValueError("n must be positive")
    s = terms.select("token", "attr_id", "df").join(scores.select("attr_id", "score"), "attr_id", "left").fillna(-1.0, ["score"])
    if digits is not None:
        s = s.withColumn("score", F.round("score", digits))
    s = kept(s, "scores")
    return s.crossJoin(F.broadcast(nth_score(s, n).withColumnRenamed("score", "_least"))).filter("score >= _least").drop("_least")


def top_per_label(weights: DataFrame, n: int) -> DataFrame:
    """attr_id, label, score, rank of the n largest signed weights of each label; ties go to the larger attr_id."""
    w = Window.partitionBy("label").orderBy(F.desc("score"), F.desc("attr_id"))
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
