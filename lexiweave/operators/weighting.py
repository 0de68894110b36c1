"""Weighted vectors of documents in long form: doc_id, attr_id, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions.text import Scheme
from lexiweave.operators import chunks
from lexiweave.operators.lexicon import Lexicon, counts_and_totals, field_counts


def weight(scheme: Column, doc_num: Column, multi: bool) -> Column:
    """The weight of a row with occ, n_tokens and df.

    A term in every document has TF-IDF 0 in flat documents, and its frequency in multi-field ones.
    """
    frequency = F.col("occ") / F.col("n_tokens")
    idf = F.log(doc_num / F.col("df"))
    tfidf = F.when(F.col("df") == doc_num, frequency).otherwise(frequency * idf) if multi else frequency * idf
    return (
        F.when(scheme == Scheme.BOOLEAN.value, F.lit(1.0)).when(scheme == Scheme.OCCURRENCES.value, F.col("occ").cast("double"))
        .when(scheme == Scheme.FREQUENCY.value, frequency).otherwise(tfidf)
    )


def weighted(counts: DataFrame, lexicon: Lexicon, scheme: str | Scheme | None = None) -> DataFrame:
    """doc_id, token, attr_id, value of flat counts (doc_id, token, occ, n_tokens); unknown terms are left out."""
    s = F.lit(Scheme.parse(scheme or lexicon.scheme).value)
    return counts.join(lexicon.terms, "token").select("doc_id", "token", "attr_id", weight(s, F.lit(lexicon.doc_num), False).alias("value"))


def field_weighted(counts: DataFrame, lexicon: Lexicon, keep_zeros: bool = False) -> DataFrame:
    """As weighted(), from multi-field counts: each field by its own scheme or the default; fields that the lexicon
    lacks and zero weights are left out."""
    if lexicon.fields is not None:
        counts = counts.join(lexicon.fields.select("field"), "field", "left_semi")
    s = F.lit(lexicon.scheme.value)
    for name, own in lexicon.field_schemes:
        s = F.when(F.col("field") == name, own.value).otherwise(s)
    out = counts.join(lexicon.terms, "token").select("doc_id", "token", "attr_id", weight(s, F.lit(lexicon.doc_num), True).alias("value"))
    return out if keep_zeros else out.filter("value <> 0")


def vectors(docs: DataFrame, lexicon: Lexicon, scheme: str | Scheme | None = None, l2: bool | None = None) -> DataFrame:
    """doc_id, attr_id, value of documents under a fitted lexicon, which may know other documents.

    Multi-field documents take their schemes from the lexicon alone; l2 is the lexicon's `normalize` if not given.
    """
    l2 = lexicon.normalize if l2 is None else l2
    if in_chunks(docs):
        return chunks.vectors(docs, lexicon.terms, Scheme.parse(scheme or lexicon.scheme).value, lexicon.doc_num, l2)
    out = field_weighted(field_counts(docs), lexicon) if "fields" in docs.columns else weighted(counts_and_totals(docs), lexicon, scheme)
    out = out.select("doc_id", "attr_id", "value")
    return l2_normalized(out) if l2 else out


def in_chunks(docs: DataFrame) -> bool:
    """Whether documents are worked on in chunks: flat ones that are no stream."""
    return "fields" not in docs.columns and not docs.isStreaming


def l2_normalized(vectors: DataFrame) -> DataFrame:
    """Values divided by the length of their document's vector; a zero vector stays."""
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc_id")))
    return vectors.withColumn("value", F.coalesce(F.try_divide("value", length), F.lit(0.0)))


def first_positions(vectors: DataFrame, terms: DataFrame) -> DataFrame:
    """The literal outcome of filtering terms without renumbering ids: of the k features of a document that survive,
    the first k positions by id are written, filtered ones among them with 0."""
    known = vectors.join(terms.select("attr_id", F.lit(True).alias("_in")), "attr_id", "left")
    by_doc = Window.partitionBy("doc_id")
    placed = known.withColumns({"_pos": F.row_number().over(by_doc.orderBy("attr_id")), "_k": F.count("_in").over(by_doc)})
    return placed.filter("_pos <= _k").select("doc_id", "attr_id", F.when(F.col("_in"), F.col("value")).otherwise(0.0).alias("value"))


def remapped(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors under the new ids of a table old_id, new_id."""
    return vectors.join(ids.select(F.col("old_id").alias("attr_id"), "new_id"), "attr_id").select("doc_id", F.col("new_id").alias("attr_id"), "value")
