"""Document fingerprints: a homomorphic hash of the multiset of a document's paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm._spark import table

#: Lanes of 16 bits; sums are taken modulo 2**16. 1024 lanes make finding a second multiset as hard as a lattice problem.
LANES = 1024
#: Paragraphs whose lanes are held at a time.
AT_ONCE = 256


def lanes_of(paragraph: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(paragraph).digest(2 * LANES), "<u2")


def paragraphs(text: str) -> list[str]:
    """Lines without white space around them, empty ones left out."""
    return [p for p in map(str.strip, text.split("\n")) if p]


def _summed(parts: list[str]) -> np.ndarray:
    total = np.zeros(LANES, "<u2")
    for i in range(0, len(parts), AT_ONCE):
        data = b"".join([hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(2 * LANES) for p in parts[i : i + AT_ONCE]])
        total += np.frombuffer(data, "<u2").reshape(-1, LANES).sum(0, dtype="<u2")
    return total


def fingerprint(parts: Iterable[str]) -> bytes:
    total = np.zeros(LANES, "<u2")
    for p in parts:
        total += lanes_of(p.encode())
    return total.tobytes()


def insert(state: bytes, paragraph: str) -> bytes:
    """The fingerprint after a paragraph is added, from the fingerprint alone."""
    return (np.frombuffer(state, "<u2") + lanes_of(paragraph.encode())).tobytes()


def delete(state: bytes, paragraph: str) -> bytes:
    """The fingerprint after one copy of a paragraph is removed."""
    return (np.frombuffer(state, "<u2") - lanes_of(paragraph.encode())).tobytes()


def combine(a: bytes, b: bytes) -> bytes:
    """The fingerprint of two documents' paragraphs together."""
    return (np.frombuffer(a, "<u2") + np.frombuffer(b, "<u2")).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            n, state, digest, null = [], [], [], b.column(1).is_null().to_numpy(zero_copy_only=False)
            for text in b.column(1).to_pylist():
                parts = paragraphs(text or "")
                total = _summed(parts).tobytes()
                n.append(len(parts))
                state.append(total)
                digest.append(hashlib.blake2b(total, digest_size=16).hexdigest())
            mask = lambda x, t: pa.array([None if k else v for k, v in zip(null, x)], t)
            yield pa.RecordBatch.from_arrays([b.column(0), mask(n, pa.int32()), mask(state, pa.binary()), mask(digest, pa.string())], names=["doc_id", "n_paragraphs", "fingerprint", "digest"])


_OUT = "doc_id bigint, n_paragraphs int, fingerprint binary, digest string"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, fingerprint (the 2 KiB sum) and digest (32 hex digits of it, to group or join by).

    Each paragraph is hashed to 1024 lanes, which are added modulo 2**16: two documents have equal fingerprints if they
    have the same paragraphs as often, in any order, and insert(), delete() and combine() follow an edit without the
    text. One scan, no shuffle.

    A null text gives nulls; a text without paragraphs the zero fingerprint; repeated paragraphs count as often as they
    occur; repeated rows and null doc_ids are rows of their own; columns besides doc_id and text are ignored; an empty
    table gives an empty table.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, _OUT)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, paragraph, copies) to the sum of each document's changes within a batch."""
    for b in batches:
        by: dict[int, list] = {}
        for doc, text, copies in zip(*[b.column(k).to_pylist() for k in range(3)]):
            if doc is None or not copies:
                continue
            for p in paragraphs(text or ""):
                n, lanes = by.get(doc, (0, np.zeros(LANES, "<u2")))
                by[doc] = n + copies, lanes + lanes_of(p.encode("utf-8", "surrogatepass")) * np.uint16(copies % (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(by, pa.int64()), pa.array([n for n, _ in by.values()], pa.int64()), pa.array([x.tobytes() for _, x in by.values()], pa.binary())], names=["doc_id", "n", "change"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (doc_id, n, change) sorted by doc_id to one sum for each; what one task holds is one sum."""
    doc, n, total = None, 0, np.zeros(LANES, "<u2")

    def row() -> pa.RecordBatch:
        state = total.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([n], pa.int32()), pa.array([state], pa.binary()), pa.array([hashlib.blake2b(state, digest_size=16).hexdigest()])], names=["doc_id", "n_paragraphs", "fingerprint", "digest"])

    for b in batches:
        for d, k, change in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if d != doc:
                if doc is not None:
                    yield row()
                doc, n, total = d, 0, np.zeros(LANES, "<u2")
            n, total = n + k, total + np.frombuffer(change, "<u2")
    if doc is not None:
        yield row()


def apply_edits(prints: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows of fingerprints() after a table of edits (doc_id, paragraph, copies), without reading any text: copies
    more (or, if negative, fewer) of a paragraph. A document that prints lacks begins empty.

    Edits are added up in each batch before they are shuffled, so a document with very many of them is a few sums in
    each task. Null doc_ids, null paragraphs and null or zero copies change nothing; rows of prints without a doc_id or
    a fingerprint are left out; of rows that repeat a doc_id the sum is taken, as of parts of one document; an empty
    table of edits gives prints as they are; other columns are ignored.
    """
    schema = "doc_id bigint, n bigint, change binary"
    known = prints.filter("doc_id is not null and fingerprint is not null").select(F.col("doc_id").cast("bigint"), F.col("n_paragraphs").cast("bigint").alias("n"), F.col("fingerprint").alias("change"))
    new = edits.select(F.col("doc_id").cast("bigint"), F.col("paragraph").cast("string"), F.col("copies").cast("bigint")).mapInArrow(_changes, schema)
    return known.unionAll(new).repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_added, _OUT)


def equal_groups(prints: DataFrame) -> DataFrame:
    """digest, first_doc_id (the least, which settles ties) and n_docs for each digest that several rows share, rows that
    repeat a document among them; null and empty texts are left out; null doc_ids count and are never first unless all
    are null; other columns are ignored; an empty table gives an empty table."""
    return prints.filter("n_paragraphs > 0").groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_docs")).filter("n_docs > 1")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLES: dict[str, str] = {}
