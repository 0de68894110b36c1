"""Byte-level BPE encoding and decoding with padded numpy matrices."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm._spark import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens that are decoded at a time.
DECODED = tx.SLICE // 4
_NONE = np.iinfo(np.int32).max
_WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024)
_MULT = tx.U(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Tokens, and an open-addressing table from a pair of ids to the id (which is the rank) they merge to."""

    tokens: list[bytes]
    byte_ids: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    shift: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None:
                    pairs[a << 32 | b] = r
        bits = max(4, int(2.5 * len(pairs)).bit_length())
        keys, merged = np.full(1 << bits, ~tx.U(0)), np.full(1 << bits, _NONE, np.int32)
        todo, vals = np.fromiter(pairs, tx.U, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = (todo * _MULT) >> tx.U(64 - bits)
        while len(todo):
            _, first = np.unique(slot, return_index=True)
            first = first[keys[slot[first]] == ~tx.U(0)]
            keys[slot[first]], merged[slot[first]] = todo[first], vals[first]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, vals, slot = todo[left], vals[left], (slot[left] + tx.U(1)) & tx.U((1 << bits) - 1)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        return cls(tokens, np.array([ranks[bytes([i])] for i in range(256)], np.int32), keys, merged, 64 - bits)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged id of each pair, or _NONE; a negative id is padding."""
        out = np.full(a.shape, _NONE, np.int32)
        at = np.flatnonzero((a >= 0).ravel() & (b >= 0).ravel())
        key = a.ravel()[at].astype(tx.U) << tx.U(32) | b.ravel()[at].astype(tx.U)
        slot, flat = (key * _MULT) >> tx.U(self.shift), out.ravel()
        while len(at):
            k = self.keys[slot]
            hit = k == key
            flat[at[hit]] = self.merged[slot[hit]]
            on = ~hit & (k != ~tx.U(0))
            at, key, slot = at[on], key[on], (slot[on] + tx.U(1)) & tx.U(len(self.keys) - 1)
        return flat.reshape(a.shape)


def _long(word: bytes, v: Vocabulary) -> np.ndarray:
    """The same merges for one very long pre-token, with a heap over linked neighbours instead of a matrix row."""
    import heapq

    ids = v.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    n = len(ids)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    first = v.pair(np.array(ids[:-1]), np.array(ids[1:]))
    heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != _NONE).tolist()]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def merged(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(v.pair(np.array([a]), np.array([b]))[0])
        return known[a, b]

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j], nxt[i] = r, -1, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for p, q in ((prv[i], i), (i, nxt[i])):
            if p >= 0 and q < n and (m := merged(ids[p], ids[q])) != _NONE:
                heapq.heappush(heap, (m, p, ids[p], ids[q]))
    return np.array([x for x in ids if x >= 0], np.int32)


def merge_words(found: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of distinct pre-tokens: (flat ids, start of each, number of each)."""
    n = np.fromiter(map(len, found), np.int64, len(found))
    data = v.byte_ids[np.frombuffer(b"".join(found), np.uint8)] if len(found) else np.zeros(0, np.int32)
    begin = np.cumsum(n) - n
    flat, start, count, at = [], np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), 0
    low = 0
    for width in _WIDTHS:
        rows = np.flatnonzero((n > low) & (n <= width))
        low = width
        for rows in np.split(rows, range(1 << 15, len(rows), 1 << 15)):
            if not len(rows):
                continue
            m = np.full((len(rows), width), -1, np.int32)
            m[np.arange(width) < n[rows, None]] = data[tx.ragged(begin[rows], n[rows])]
            rank = v.pair(m[:, :-1], m[:, 1:])
            live, col = rows, np.arange(width)
            while len(live):
                if rank.shape[1]:
                    p = rank.argmin(1)
                    best = rank[np.arange(len(live)), p]
                    stop = best == _NONE
                else:
                    stop = np.ones(len(live), bool)
                if stop.any():  # a finished row leaves the matrix
                    done = m[stop]
                    k = (done >= 0).sum(1)
                    start[live[stop]], count[live[stop]] = at + np.cumsum(k) - k, k
                    flat.append(done[done >= 0])
                    at += int(k.sum())
                    on = ~stop
                    live, m, rank = live[on], m[on], rank[on]
                    if not len(live):
                        break
                    p, best = p[on], best[on]
                w, r = m.shape[1], np.arange(len(live))
                m = np.where(col[: w - 1] <= p[:, None], m[:, : w - 1], m[:, 1:])
                m[r, p] = best
                if w > 2:
                    rank = np.where(col[: w - 2] < p[:, None], rank[:, : w - 2], rank[:, 1:])
                    left, right = np.flatnonzero(p > 0), np.flatnonzero(p < w - 2)
                    rank[left, p[left] - 1] = v.pair(m[left, p[left] - 1], m[left, p[left]])
                    rank[right, p[right]] = v.pair(m[right, p[right]], m[right, p[right] + 1])
                else:
                    rank = rank[:, :0]
    for i in np.flatnonzero(n > _WIDTHS[-1]).tolist():
        ids = _long(found[i], v)
        flat.append(ids)
        start[i], count[i] = at, len(ids)
        at += len(ids)
    return np.concatenate(flat) if flat else np.zeros(0, np.int32), start, count


def pretokens(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of the usual byte-level BPE pattern (contractions, letters, numbers, other
    signs, each with one blank before it, and white space), found from character classes without a regex."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = tx.classes(cp)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = cut[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    space = kind == tx.SPACE
    # the last white-space character of a run goes with what follows if it is a blank, else it stands alone
    head = np.flatnonzero(first & ~space)
    head = head[(head > 0) & ~cut[head]]
    after = head[space[head - 1]]
    first[after - 1] = True
    blank = after[cp[after - 1] == 32]
    first[blank] = False
    # contractions: a lone apostrophe that begins a token, then s, t, m, d, re, ve, ll
    c = np.flatnonzero((cp == 39) & first & ~space)
    c = c[c + 1 < n]
    c = c[(kind[c + 1] == tx.LETTER) & ~cut[c + 1]]
    if len(c):
        x = cp[c + 1]
        y = np.where((c + 2 < n) & ~cut[np.minimum(c + 2, n)], cp[np.minimum(c + 2, n - 1)], 0)
        one = np.isin(x, [115, 116, 109, 100])
        two = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        took = np.where(one, 2, np.where(two, 3, 0))
        c, took = c[took > 0], took[took > 0]
        first[c + 1] = False
        end = c + took
        end = end[end < n]
        # a blank that is followed by a letter or sign keeps its own start, set above
        first[end[~space[end] | cut[end]]] = True
    s = np.flatnonzero(first)
    return s, np.append(s[1:], n)


class Known:
    """Encoded pre-tokens of this worker by hash, sorted; forgotten when there are too many."""

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.count, self.flat, self.used = np.zeros(0, tx.U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1 << 20, np.int32), 0

    def find(self, keys: np.ndarray, words, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """(start in flat, number) of the ids of sorted distinct keys; words(which) gives the bytes of unknown ones."""
        if len(self.keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            flat, start, count = merge_words(words(new), v)
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(flat)), np.int32)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.start = np.insert(self.start, at[new], start + self.used)
            self.count = np.insert(self.count, at[new], count)
            self.used += len(flat)
            at = np.searchsorted(self.keys, keys)
        return self.start[at], self.count[at]


_known: dict[str, Known] = {}


def _encode(batches: Iterator[pa.RecordBatch], v: Vocabulary, path: str = "") -> Iterator[pa.RecordBatch]:
    token_bytes = np.frombuffer(b"".join(v.tokens), np.uint8)
    width = np.fromiter(map(len, v.tokens), np.int32, len(v.tokens))
    begin = np.cumsum(width, dtype=np.int64) - width
    known = _known.setdefault(path, Known())
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            cp, off = tx.codepoints(b.column(1))
            s, e = pretokens(cp, off)
            keys, first, which = np.unique(tx.Spans(cp).hash(s, e), return_index=True, return_inverse=True)

            def words(new, cp=cp, s=s[first], e=e[first]):
                text = cp.tobytes().decode("utf-32-le")
                return [text[i:j].encode() for i, j in zip(s[new].tolist(), e[new].tolist())]

            start, count = known.find(keys, words, v)
            n = count[which]
            ids = known.flat[tx.ragged(start[which], n)]
            sums = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=sums[1:])
            bound = sums[np.searchsorted(s, off)]
            # decode again and compare with the bytes of the text
            col = tx.as_strings(b.column(1))
            text_off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
            there = (np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8))[text_off[0] : text_off[-1]]
            w = width[ids]
            back, ends = token_bytes[tx.ragged(begin[ids], w)], np.zeros(len(ids) + 1, np.int64)
            np.cumsum(w, out=ends[1:])
            ok = np.diff(ends[bound]) == np.diff(text_off)
            if len(back) == len(there):
                wrong = np.searchsorted(text_off - text_off[0], np.flatnonzero(back != there), "right") - 1
                ok[wrong] = False
            else:
                ok &= [back[ends[i] : ends[j]].tobytes() == there[x:y].tobytes() for i, j, x, y in zip(bound[:-1], bound[1:], text_off[:-1] - text_off[0], text_off[1:] - text_off[0])]
            null = col.is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32), pa.int32(), mask=np.append(null, False)) if null.any() else pa.array(bound.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), lists, pa.array(np.diff(bound).astype(np.int32), mask=null), pa.array(ok, mask=null)],
                names=["doc_id", "token_ids", "n_tokens", "round_trip"],
            )


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of every document: doc_id, token_ids, n_tokens, round_trip (decoding gave the text's bytes again).

    One scan, no shuffle: distinct pre-tokens of each Arrow batch are encoded once, in matrices of like length where
    every row merges its leftmost pair of least rank each round. A pre-token of over 1,024 bytes would take as many rounds
    over as wide a row; it is merged in the same order with a heap instead. Only the vocabulary (a file of fixed size that the
    driver reads) is broadcast.

    A null text gives null ids, count and flag; an empty text no ids and 0; repeated rows and null or repeated doc_ids
    are rows of their own; columns besides doc_id and text are ignored; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _encode(it, shared.value, vocabulary), "doc_id bigint, token_ids array<int>, n_tokens int, round_trip boolean"
    )


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some tokens each (one document at least): decoding takes a hundred bytes and more a token."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODED, "right")))
        yield batch.slice(at, to - at)
        at = to
    tx.release()


def _decode(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    odd = len(v.tokens)  # stands for ids without a token
    every = [*v.tokens, b"\xef\xbf\xbd"]
    data, width = np.frombuffer(b"".join(every), np.uint8), np.fromiter(map(len, every), np.int64, len(every))
    begin = np.cumsum(width) - width
    for b in (s for whole in batches for s in _parts(whole)):
        col = b.column(1)
        flat, null = col.flatten(), col.is_null().to_numpy(zero_copy_only=False)
        n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.where((ids < 0) | (ids >= odd), odd, ids)
        ids = np.where(width[ids] == 0, odd, ids)
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(width[ids], out=ends[1:])
        out = data[tx.ragged(begin[ids], width[ids])].tobytes()
        bound = ends[np.append(0, np.cumsum(n))].tolist()
        texts = [None if k else out[i:j].decode("utf-8", "replace") for k, i, j in zip(null, bound[:-1], bound[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, token_ids. Null ids give null; no ids the empty text; an id that the vocabulary
    lacks, a null id and bytes that are not UTF-8 give U+FFFD; repeated rows and null doc_ids are rows of their own;
    other columns are ignored; an empty table gives an empty table."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    return encoded.select(F.col("doc_id").cast("bigint"), F.col("token_ids").cast("array<int>")).mapInArrow(lambda it: _decode(it, shared.value), "doc_id bigint, text string")


def bpe_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return decode(encode(table(spark, sf_dir, "documents")))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe, "bpe_decode": bpe_decode}
ORACLES = {"bpe_decode": "SELECT doc_id, text FROM documents"}
