"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the shared folder
and reread as the next stage's docs. All but the last return the columns of documents.

Defined cases, stage by stage: documents without words (null, empty, blank texts) go in the first stage, and so do those
that the classifier rejects; a document that loses every line with words goes in the second; one document of each class
of near duplicates (the least doc_id, so there are no ties) stays in the third; the last has a row for each piece of a
document in a window. Rows with a null doc_id are scored by the first stage, left as they are by the second and third,
and packed by the last. Rows that repeat a doc_id are judged alike, lose the same lines where their own text has them,
stay or go together, and are packed as rows of their own. Further columns of documents are kept whatever their names
until the last stage. An empty table gives an empty table; without labels of both classes every document with words is
kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiweave.llm import line_dedup, ngram_join, packing, quality
from lexiweave.llm._spark import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_duplicate_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the trained classifier nor differencing can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None
