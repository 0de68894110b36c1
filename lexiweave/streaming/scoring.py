"""Scoring of a stream of texts under a fitted lexicon: a stream joined with static tables, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiweave.functions.text import tokenize
from lexiweave.operators.lexicon import Lexicon
from lexiweave.operators.models import Classifier
from lexiweave.operators.weighting import vectors


def start_classifying(texts: DataFrame, model: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Classify a stream of texts (doc_id, text) with the classifier saved at `model`, which is loaded again whenever its
    lexicon has been written anew. Each micro-batch has a folder of its own under `out`, written whole, so that one that
    is repeated after a failure leaves nothing twice."""
    spark = texts.sparkSession
    held = [Classifier.load(spark, model)]

    def classify(batch: DataFrame, number: int) -> None:
        if held[0].needs_refreshing():
            held[0] = Classifier.load(spark, model)
        docs = batch.select("doc_id", tokenize(F.col("text")).alias("tokens"))
        held[0].scores(docs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(classify).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_vectors(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, attr_id, value: a row for each known term of each text (doc_id, text) of a stream.

    Terms are counted within the row of their text, so only one join by term is left to each micro-batch. Null and empty
    texts have no rows.
    """
    return vectors(texts.select("doc_id", tokenize(F.col("text")).alias("tokens")), lexicon, l2=False)
