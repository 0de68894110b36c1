"""Line deduplication by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm._spark import bloom, discard, fresh_name, table, written

#: Lines of fewer characters are not matched one edit apart: short ones are alike by chance.
MIN_CHARS = 20
#: Lines of as many characters are matched if equal: all but blank ones.
EXACT_CHARS = 1
#: Lengths of the pieces that an edit may leave whole.
_STEPS = np.unique(np.round(4 * 1.25 ** np.arange(90)).astype(np.int64))
#: Keys of one bucket; the number of buckets grows with the input, the work in one does not.
BUCKET_KEYS = 2_000_000
_KEY, _ID = 5, 6  # bytes of a key within its bucket, and of the line that has it
_ID_BITS = (1 << 8 * _ID) - 1
#: Partitions of the buckets at most; beyond, a task takes several buckets, one after another.
MOST_PARTS = 20_000
#: Occurrences of one line from which they are looked up in a broadcast, so that they need not meet in one task.
HOT = 200_000


def _trimmed(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the white space at their ends; blank spans are empty."""
    at = np.flatnonzero(tx.classes(cp) != tx.SPACE)
    if not len(at):
        return s, s.copy()
    i, j = np.searchsorted(at, s), np.searchsorted(at, e) - 1
    some = j >= i
    return np.where(some, at[np.minimum(i, len(at) - 1)], s), np.where(some, at[np.maximum(j, 0)] + 1, s)


def lines(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number within it, start, end) of every line; an empty text has one empty line."""
    n = len(off) - 1
    feed = np.flatnonzero(cp == 10)
    per = np.searchsorted(feed, off[1:]) - np.searchsorted(feed, off[:-1]) + 1
    doc = np.repeat(np.arange(n), per)
    first = np.cumsum(per) - per
    nth = np.arange(len(doc)) - first[doc]
    s, e = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    s[first], e[first + per - 1] = off[:-1], off[1:]
    s[nth > 0], e[nth < per[doc] - 1] = feed + 1, feed
    return doc, nth, s, e


def _found(b: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, ...]:
    """(row, number within it, start, end, lower-cased code points) of the trimmed lines of a batch that count."""
    cp, off = tx.codepoints(b.column(1))
    doc, nth, s, e = lines(cp, off)
    s, e = _trimmed(cp, s, e)
    at = np.flatnonzero(e - s >= min_chars)
    return doc[at], nth[at], s[at], e[at], tx.lowered(cp)


def _hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tx.Spans(low).hash(s, e), tx.Spans(low ^ np.uint32(0x15A4E35)).hash(s, e)


def _line_rows(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            doc, nth, s, e, low = _found(b, min_chars)
            h, g = _hashes(low, s, e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(nth, pa.int32()), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=["doc_id", "line_no", "h", "g"])


_ROWS = "doc_id bigint, line_no int, h bigint, g bigint"
_PACKED = "bucket int, entries binary"


def _bucketed(found: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Keys with the lines that have them, packed to one row a bucket."""
    keys, ids = (np.concatenate([f[i] for f in found]) for i in range(2))
    bucket = (keys >> tx.U(8 * _KEY)) % tx.U(buckets)
    by = np.argsort(bucket, kind="stable")
    packed = np.empty((len(keys), _KEY + _ID), np.uint8)
    packed[:, :_KEY] = keys[by].view(np.uint8).reshape(-1, 8)[:, :_KEY]
    packed[:, _KEY:] = ids[by].view(np.uint8).reshape(-1, 8)[:, :_ID]
    there, first = np.unique(bucket[by], return_index=True)
    ends = [*first[1:].tolist(), len(keys)]
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([packed[i:j].tobytes() for i, j in zip(first.tolist(), ends)], pa.binary())], names=["bucket", "entries"])


def _packed(found: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    some: list[tuple[np.ndarray, np.ndarray]] = []
    for f in found:
        some.append(f)
        if sum(len(k) for k, _ in some) > BUCKET_KEYS:
            yield _bucketed(some, buckets)
            some = []
    if sum(len(k) for k, _ in some):
        yield _bucketed(some, buckets)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group, line) by group, for each bucket, of the keys that several lines have."""
    for t in tx.groups(batches, "bucket"):
        bucket = t.column("bucket").to_numpy()
        at = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        for i, j in zip(at, [*at[1:], len(bucket)]):
            packed = np.frombuffer(b"".join(t.column("entries").slice(i, j - i).to_pylist()), np.uint8).reshape(-1, _KEY + _ID)
            wide = np.zeros((len(packed), 16), np.uint8)
            wide[:, :_KEY], wide[:, 8 : 8 + _ID] = packed[:, :_KEY], packed[:, _KEY:]
            key, line = wide.view(tx.U).T
            by = np.argsort(key)
            key, line = key[by], line[by]
            same = key[1:] == key[:-1]
            often = np.zeros(len(key), bool)
            often[1:] |= same
            often[:-1] |= same
            key, line = key[often], line[often]
            by = np.lexsort((line, key))
            key, line = key[by], line[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
            key, line = key[new], line[new]
            group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
            keep = np.bincount(group)[group] > 1
            yield group[keep], line[keep]


def _end_keys(batches: Iterator[pa.RecordBatch], min_chars: int, id_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What one edit must leave whole in a line, with its length: about three quarters of it, in one of four ways.

    Of the halves of a line one stays as it is. If it is the first, then so does a quarter at the other end or the one
    that follows the half, and likewise from behind. A line is entered under its own length and that of a line shorter
    by one.
    """
    step = lambda x: _STEPS[np.maximum(np.searchsorted(_STEPS, x, "right") - 1, 0)]
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            _, _, s, e, low = _found(b, min_chars)
            span = tx.Spans(low)
            h, first = np.unique(span.hash(s, e), return_index=True)  # repeated lines once
            s, e = s[first], e[first]
            line = h & tx.U(id_bits)
            for base in (e - s, e - s - 1):
                half, rest = step(base // 2), step(base // 4)
                length = base.astype(tx.U) * tx.U(0x9E3779B97F4A7C15)
                head, tail = span.hash(s, s + half), span.hash(e - half, e)
                for k, x in enumerate((head + span.hash(e - rest, e) * tx.U(3), span.hash(s, s + half + rest), tail * tx.U(3) + span.hash(s, s + rest), span.hash(e - half - rest, e))):
                    yield tx.mix(x ^ length ^ tx.U(k + 1)), line


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, line in _met(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(line).view(np.int64))], names=["line"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The deletion neighbourhood of each line: its own hash and that of it without each of its characters."""
    for whole in batches:
        for b in tx.slices(whole, "text", 1 << 16):
            cp, off = tx.codepoints(b.column(1))
            n = np.diff(off)
            line = np.repeat(np.arange(len(n)), n + 1)
            pos = np.arange(len(line)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1) - 1  # -1: nothing deleted
            s, e = off[line], off[line + 1]
            cut = np.where(pos < 0, e, s + pos)
            past = np.minimum(cut + 1, e)
            whole_hash = tx.Spans(cp)
            left, right = whole_hash.raw(s, cut), whole_hash.raw(past, e)
            key = tx.mix((left + right * tx.power(int(n.max(initial=0)) + 1)[cut - s]) ^ ((e - s - (past - cut)).astype(tx.U) * tx.U(0xD6E8FEB86659FD93)))
            # deleting any of a run of equal characters gives the same variant
            keep = (pos <= 0) | (cp[np.minimum(cut, len(cp) - 1)] != cp[np.maximum(cut - 1, 0)])
            yield key[keep], b.column(0).to_numpy(zero_copy_only=False).view(tx.U)[line[keep]]


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs x < y of lines that share a variant."""
    for group, line in _met(batches):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(first, len(group)))
        later = np.repeat(first + size, size) - 1 - np.arange(len(group))
        for part in np.array_split(np.arange(len(group)), max(1, int(later.sum()) // 2_000_000)):
            x, y = np.repeat(part, later[part]), tx.ragged(part + 1, later[part])
            yield pa.RecordBatch.from_arrays([pa.array(line[x].view(np.int64)), pa.array(line[y].view(np.int64))], names=["x", "y"])


def _meeting(packed: DataFrame, buckets: int, reduce, schema: str) -> DataFrame:
    parts = min(buckets, MOST_PARTS)
    return packed.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(reduce, schema).distinct()


def _texts(batches: Iterator[pa.RecordBatch], min_chars: int, wanted: np.ndarray, id_bits: int) -> Iterator[pa.RecordBatch]:
    """The trimmed, lower-cased lines that the filter lets through, with their hashes."""
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            _, _, s, e, low = _found(b, min_chars)
            h, g = _hashes(low, s, e)
            at = np.flatnonzero(tx.maybe(h & tx.U(id_bits), wanted))
            text = [low[i:j].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for i, j in zip(s[at].tolist(), e[at].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(g[at].view(np.int64)), pa.array(text, pa.string())], names=["h", "g", "text"])


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = None, id_bits: int = _ID_BITS) -> DataFrame:
    """doc_id, line_no (from 0), first_doc_id, first_line_no, edits of every line that an earlier line repeats.

    Lines are compared without the white space around them and in lower case; those of fewer than `exact_chars`
    characters (`min_chars` if None) are left alone, and those of fewer than `min_chars` can only be equal. A line is a
    duplicate if any line before it in the order (doc_id, line_no) is equal (edits 0) or one insertion, deletion or
    substitution away (edits 1); of these the earliest is given, and edits says how far it is.

    Equal lines meet by hash. For the others, lines first meet by what one edit must leave whole of them. Only lines
    that have this in common with another emit their deletion neighbourhood as hashed keys; lines with equal keys are
    joined and verified by edit distance. Keys travel in packed rows of a bucket each, with 48 bits of their line's
    hash; lines that have these bits in common with another are verified against each other too, and what is found is
    carried under both hashes of the line.

    Rows with a null doc_id or text have no lines; rows that repeat a doc_id are taken together, and of lines with the
    same doc_id and number the earliest stays in each; other columns are ignored; an empty table gives an empty table.
    """
    return _with_hashes(docs, min_chars, exact_chars, id_bits).drop("h", "g").distinct()


def _with_hashes(docs: DataFrame, min_chars: int, exact_chars: int | None, id_bits: int = _ID_BITS) -> DataFrame:
    """The rows of duplicate_lines() with the hashes of each line."""
    least = min_chars if exact_chars is None else exact_chars
    pairs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    occurrences = written(pairs.mapInArrow(lambda it: _line_rows(it, least), _ROWS), "lines")
    distinct = written(occurrences.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("n")), "distinct-lines")
    buckets = 1 + 8 * distinct.count() // BUCKET_KEYS
    ends = pairs.mapInArrow(lambda it: _packed(_end_keys(it, min_chars, id_bits), buckets), _PACKED)
    line = F.col("h").bitwiseAND(F.lit(id_bits))
    met = _meeting(ends, buckets, _close, "line bigint").withColumn("met", F.lit(True))
    twins = F.count("*").over(Window.partitionBy("line"))
    close = distinct.select("h", "g", "at", line.alias("line")).join(met, "line", "left").withColumn("twins", twins).filter("met or twins > 1").select("h", "g", "at", "line", (F.col("twins") > 1).alias("twin"))
    close = written(close, "close-lines")
    sent = docs.sparkSession.sparkContext.broadcast(bloom(close.select("line")))
    read = pairs.mapInArrow(lambda it: _texts(it, min_chars, sent.value, id_bits), "h bigint, g bigint, text string")
    return _duplicates(read, occurrences, distinct, close)


def _duplicates(read: DataFrame, occurrences: DataFrame, distinct: DataFrame, close: DataFrame) -> DataFrame:
    texts = written(read.dropDuplicates(["h", "g"]).join(close, ["h", "g"]).select("h", "g", "line", "twin", "text", "at"), "close-texts")
    discard(close)
    buckets = 1 + (texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // BUCKET_KEYS
    keys = texts.select("line", "text").mapInArrow(lambda it: _packed(_variants(it), buckets), _PACKED)
    two = _meeting(keys, buckets, _partners, "x bigint, y bigint").unionAll(texts.filter("twin").select(F.col("line").alias("x"), F.col("line").alias("y")).distinct())
    side = lambda n: texts.select(F.col("line").alias(n), F.col("text").alias(f"{n}t"), F.col("at").alias(f"{n}a"), F.struct("h", "g").alias(f"{n}h"))
    near = (
        two.join(side("x"), "x").join(side("y"), "y")
        .filter(F.levenshtein("xt", "yt", 1) == 1)
        .select(F.when(F.col("xa") < F.col("ya"), F.col("yh")).otherwise(F.col("xh")).alias("later"), F.least("xa", "ya").alias("before"))
        .groupBy("later").agg(F.min("before").alias("before")).select("later.h", "later.g", "before")
    )
    near = written(near, "near-lines")
    discard(texts)
    # lines whose text occurs again or is near an earlier one
    marked = distinct.select("h", "g", "at", "n").join(near, ["h", "g"], "left").filter("n > 1 or before is not null")
    marked = written(marked, "marked-lines")
    discard(near)
    each = occurrences.select("h", "g", F.struct("doc_id", "line_no").alias("me"))
    # lines that occur very often, of which there can be only so many, are looked up where they stand
    large = F.broadcast(marked.filter(F.col("n") >= HOT).select("h", "g", F.struct("at", "before").alias("_large")))
    known = each.join(large, ["h", "g"], "left")
    hit = known.filter("_large is not null").select("h", "g", "me", "_large.at", "_large.before").unionAll(
        known.filter("_large is null").drop("_large").join(marked.filter(F.col("n") < HOT), ["h", "g"]).select("h", "g", "me", "at", "before")
    )
    first = F.when(F.col("before") < F.col("at"), F.col("before")).otherwise(F.col("at"))
    return (
        hit.withColumns({"first": first, "edits": F.when(F.col("before") < F.col("at"), 1).otherwise(0)})
        .filter("first < me")
        .select(F.col("me.doc_id").alias("doc_id"), F.col("me.line_no").alias("line_no"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), "edits", "h", "g")
    )


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            out, drop = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            some, keep = [i for i, d in enumerate(drop) if d], [True] * len(out)
            cp, off = tx.codepoints(b.column(at).take(pa.array(some, pa.int64())))
            doc, _, s, e = lines(cp, off)
            h, g = (x.view(np.int64).tolist() for x in _hashes(tx.lowered(cp), *_trimmed(cp, s, e)))
            first = np.searchsorted(doc, np.arange(len(some))).tolist()
            for i, k in zip(some, first):
                if out[i] is None:
                    continue
                gone, every = {(d["line_no"], d["h"], d["g"]) for d in drop[i]}, out[i].split("\n")
                rest = [x for n, x in enumerate(every) if (n, h[k + n], g[k + n]) not in gone]
                if len(rest) < len(every):
                    out[i], keep[i] = "\n".join(rest), any(map(str.strip, rest))
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))


def drop_duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int | None = EXACT_CHARS) -> DataFrame:
    """The documents without the lines that duplicate_lines() lists, each where its own text is that of a duplicate, as
    rows that repeat a doc_id may differ; a document that loses a line and has no other words is dropped.

    n_chars, if there is such a column, is set to the length of the text, and left alone where that is null. Rows with a
    null doc_id or text stay as they are, empty and blank texts too; of equal lines that with the least (doc_id, number)
    stays; of repeated rows each loses the same lines; all columns are kept, whatever their names; an empty table gives
    an empty table.
    """
    of, what = fresh_name("line_doc", docs.columns), fresh_name("line_drop", docs.columns)
    drop = _with_hashes(docs, min_chars, exact_chars).groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("line_no", "h", "g")).alias(what))
    joined = docs.join(drop, docs["doc_id"] == drop[of], "left").drop(of)
    out = joined.mapInArrow(lambda it, at=docs.columns.index("text"): _cut(it, at), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(table(spark, sf_dir, "documents"), exact_chars=EXACT_CHARS)


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {
    "op7_line_dedup": rf"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
 lines AS (SELECT * FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, lower(regexp_replace(ls[i], '^\s+|\s+$', '', 'g')) AS t
   FROM docs, unnest(range(1, len(ls) + 1)) AS r(i)) WHERE length(t) >= {EXACT_CHARS}),
 one AS (SELECT t, min((doc_id, line_no)) AS f FROM lines GROUP BY t),
 ends AS (SELECT t, f, length(t) AS n, left(t, length(t) // 2) AS p, right(t, length(t) // 2) AS s,
   left(t, (length(t) - 1) // 2) AS p1, right(t, (length(t) - 1) // 2) AS s1 FROM one WHERE length(t) >= {MIN_CHARS}),
 cand AS (
   SELECT a.t AS at1, b.t AS bt1, a.f AS af, b.f AS bf FROM ends a JOIN ends b ON a.n = b.n AND a.p = b.p AND a.t <> b.t UNION
   SELECT a.t, b.t, a.f, b.f FROM ends a JOIN ends b ON a.n = b.n AND a.s = b.s AND a.t <> b.t UNION
   SELECT a.t, b.t, a.f, b.f FROM ends a JOIN ends b ON a.n = b.n + 1 AND a.p1 = b.p UNION
   SELECT a.t, b.t, a.f, b.f FROM ends a JOIN ends b ON a.n = b.n + 1 AND a.s1 = b.s),
 near1 AS (SELECT * FROM cand WHERE
   CASE WHEN length(at1) = length(bt1) THEN len(list_filter(range(1, length(at1) + 1), lambda i: at1[i] <> bt1[i])) = 1
   ELSE len(list_filter(range(1, length(at1) + 1), lambda i: left(at1, i - 1) || substr(at1, i + 1) = bt1)) > 0 END),
 near AS (SELECT at1 AS t, bf AS o FROM near1 UNION ALL SELECT bt1, af FROM near1),
 best AS (SELECT one.t, one.f, min(o) AS o FROM one LEFT JOIN near ON near.t = one.t AND near.o < one.f GROUP BY ALL)
SELECT doc_id, line_no, CAST(coalesce(o, f)[1] AS BIGINT) AS first_doc_id, CAST(coalesce(o, f)[2] AS INTEGER) AS first_line_no,
  CASE WHEN o IS NULL THEN 0 ELSE 1 END AS edits
FROM lines JOIN best USING (t) WHERE coalesce(o, f) < (doc_id, line_no)
"""
}
