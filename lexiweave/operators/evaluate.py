"""Decisions from scores, and what they are worth against expected labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.operators import chunks
from lexiweave.operators.lexicon import Lexicon
from lexiweave.operators.weighting import in_chunks, vectors


def document_scores(vectors: DataFrame, weights: DataFrame, digits: int = 6) -> DataFrame:
    """doc_id, label, score: the weights (attr_id, label, score) of a document's features, summed."""
    return vectors.join(weights, "attr_id").groupBy("doc_id", "label").agg(F.round(F.sum(F.col("value") * F.col("score")), digits).alias("score"))


def judged(docs: DataFrame, lexicon: Lexicon, weights: DataFrame, digits: int = 6) -> DataFrame:
    """document_scores() of documents under a lexicon."""
    if in_chunks(docs):
        return chunks.label_scores(docs, lexicon.terms, weights, lexicon.scheme.value, lexicon.doc_num).withColumn("score", F.round("score", digits))
    return document_scores(vectors(docs, lexicon), weights, digits)


def best_label(docs: DataFrame, scores: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, predicted: the label with the largest score of 0 or more, the last by id of equals; the first label of
    all if there is none."""
    top = scores.filter("score >= 0").join(labels, "label").groupBy("doc_id").agg(F.max_by("label", F.struct("score", "label_id")).alias("top"))
    default = labels.filter("label_id = 0").select(F.col("label").alias("_first"))
    return docs.select("doc_id").join(top, "doc_id", "left").crossJoin(F.broadcast(default)).select("doc_id", F.coalesce("top", "_first").alias("predicted"))


def best_labels(scores: DataFrame, labels: DataFrame, ratio: float, digits: int = 6) -> DataFrame:
    """doc_id, label, scaled: labels whose score, scaled to 0..1 within the document, is at least ratio. Of equal scores
    the last label stays; a document whose scores are all equal has none."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be in (0, 1]")
    w = Window.partitionBy("doc_id")
    scaled = F.round(F.try_divide(F.col("score") - F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)), digits)
    kept = scores.withColumn("scaled", scaled).filter(F.col("scaled") >= ratio).join(labels, "label")
    return kept.groupBy("doc_id", "scaled").agg(F.max_by("label", "label_id").alias("label")).select("doc_id", "label", "scaled")


def confusion(pairs: DataFrame) -> DataFrame:
    """predicted, expected, n."""
    return pairs.groupBy("predicted", "expected").agg(F.count("*").alias("n"))


def precision_recall(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """label, support, precision, recall of each label, and accuracy over all."""
    cells = confusion(pairs)
    by = lambda c, n: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(n))
    right = cells.filter("predicted = expected").select(F.col("expected").alias("label"), F.col("n").alias("hit"))
    overall = cells.agg((F.sum(F.when(F.col("predicted") == F.col("expected"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    rows = by("expected", "support").join(by("predicted", "claimed"), "label", "full").join(right, "label", "left").fillna(0, ["support", "claimed", "hit"])
    share = lambda of: F.round(F.try_divide("hit", of), digits)
    return rows.crossJoin(F.broadcast(overall)).select("label", "support", share("claimed").alias("precision"), share("support").alias("recall"), F.round("accuracy", digits).alias("accuracy"))


def regression(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """mse and squared correlation of the columns predicted and expected."""
    v, y = F.col("predicted").cast("double"), F.col("expected").cast("double")
    r = F.corr(v, y)
    return pairs.agg(F.round(F.avg((v - y) * (v - y)), digits).alias("mse"), F.round(r * r, digits).alias("squared_correlation"))
