"""Token counts of a unigram tokenizer by dynamic programming over a trie of distinct pre-tokens.

The pieces are those of a public model file. That file holds a byte-pair model, whose scores are minus the merge ranks
and no log-probabilities, and no file of a unigram model is at hand; tokenizers are not trained here. So the
log-probability of a piece is taken from its rank by Zipf's law: log p = -log((rank + 1) * log(number of pieces)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm._spark import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_GAP = 0x2581  # the sign that stands for a blank
#: A character without a piece costs this much more than the worst piece, as the public tokenizer library has it.
UNKNOWN_PENALTY = 10.0
#: Characters up to which pre-tokens share a trie.
LONG = 64
_SPREAD = tx.U(0x9E3779B97F4A7C15)
_LENGTH = tx.U(0xD6E8FEB86659FD93)  # keeps pieces of different lengths apart


@dataclass
class Pieces:
    """Polynomials of the pieces, sorted, with their scores; a table of bits that most other strings miss; `longest`
    in characters."""

    keys: np.ndarray
    scores: np.ndarray
    bits: np.ndarray
    longest: int
    worst: float

    @classmethod
    def of(cls, scored: dict[str, float]) -> Pieces:
        found = list(scored)
        n = np.fromiter(map(len, found), np.int64, len(found))
        end = np.cumsum(n)
        cp = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
        keys = tx.Spans(cp).raw(end - n, end) ^ (n.astype(tx.U) * _LENGTH)
        order = np.argsort(keys)
        scores = np.fromiter(scored.values(), float, len(found))
        bits = np.zeros(1 << 20, bool)
        bits[(keys * _SPREAD) >> tx.U(44)] = True
        return cls(keys[order], scores[order], bits, int(n.max()), float(scores.min()))

    def find(self, polynomial: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of the strings of this length are pieces, the scores of those)."""
        key = polynomial ^ tx.U(length * int(_LENGTH) & (1 << 64) - 1)
        maybe = np.flatnonzero(self.bits[(key * _SPREAD) >> tx.U(44)])
        key = key[maybe]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return maybe[hit], self.scores[at[hit]]

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The pieces of a model file with log-probabilities: the model's own, or by rank from a byte-pair model, whose
        scores are whole numbers."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        own = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))}
        return cls.of(by_rank(own) if all(x == int(x) for x in own.values()) else own)


def by_rank(scored: dict[str, float]) -> dict[str, float]:
    """Log-probabilities by Zipf's law, from scores of which only the order counts."""
    order = sorted(scored, key=lambda x: (-scored[x], x))
    return {x: -float(np.log((i + 1) * np.log(max(len(order), 3)))) for i, x in enumerate(order)}


def _utf8(cp: np.ndarray) -> np.ndarray:
    return 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)


def best_counts(cp: np.ndarray, start: np.ndarray, length: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, score) of the best segmentation of each span.

    The spans go into a trie: sorted, each row shares with the one before it the nodes of their common prefix. Level by
    level, every new node takes the best of its ancestors' forward scores plus the piece between; the last node of a
    span holds its count. A character that no piece covers costs the worst score less UNKNOWN_PENALTY and counts as its
    UTF-8 bytes. Of equal scores the one with fewer tokens is taken.

    A span of over LONG characters is a trie of one branch: no prefix is shared, so all its pieces are looked up at
    once and the same recurrence runs along the branch.
    """
    n = len(start)
    tokens, score = np.zeros(n, np.int32), np.zeros(n)
    unknown = p.worst - UNKNOWN_PENALTY
    for i in np.flatnonzero(length > LONG).tolist():
        tokens[i], score[i] = _branch(cp[start[i] : start[i] + length[i]], p, unknown)
    bounds = [0, 4, 8, 16, 32, LONG]
    for low, high in zip(bounds[:-1], bounds[1:]):
        rows = np.flatnonzero((length > low) & (length <= high))
        if len(rows):
            width = int(length[rows].max())
            per = max(1, (1 << 21) // (width + 1))
            for i in range(0, len(rows), per):
                part = rows[i : i + per]
                tokens[part], score[part] = _trie(cp, start[part], length[part], width, p, unknown)
    return tokens, score


def _trie(cp, start, length, width, p, unknown):
    m = np.zeros((len(start), width), np.uint32)
    m[np.arange(width) < length[:, None]] = cp[tx.ragged(start, length)]
    order = np.lexsort(m.T[::-1])
    m, start, length = m[order], start[order], length[order]
    same = np.zeros((len(m), width), bool)
    same[1:] = np.logical_and.accumulate(m[1:] == m[:-1], axis=1)
    inside = np.arange(width) < length[:, None]
    fresh = inside & ~same
    # the row that first has each prefix; column d is the prefix of length d
    own = np.zeros((len(m), width + 1), np.int64)
    own[:, 1:] = np.maximum.accumulate(np.where(fresh, np.arange(len(m))[:, None], 0), axis=0)
    best = np.full((len(m), width + 1), -np.inf)
    count = np.zeros((len(m), width + 1), np.int32)
    best[:, 0] = 0.0
    for d in range(1, width + 1):
        r = np.flatnonzero(fresh[:, d - 1])
        if not len(r):
            continue
        a = own[r, d - 1]
        b, c = best[a, d - 1] + unknown, count[a, d - 1] + _utf8(m[r, d - 1])
        h = np.zeros(len(r), tx.U)
        for k in range(1, min(d, p.longest) + 1):
            h = tx.extend(h, m[r, d - k])
            hit, scores = p.find(h, k)
            if not len(hit):
                continue
            a = own[r[hit], d - k]
            x, y = best[a, d - k] + scores, count[a, d - k] + 1
            if k == 1:  # a character with a piece is never unknown
                b[hit], c[hit] = x, y
                continue
            win = (x > b[hit]) | ((x == b[hit]) & (y < c[hit]))
            b[hit[win]], c[hit[win]] = x[win], y[win]
        best[r, d], count[r, d] = b, c
    last = own[np.arange(len(m)), length]
    tokens, score = np.zeros(len(m), np.int32), np.zeros(len(m))
    tokens[order], score[order] = count[last, length], best[last, length]
    return tokens, score


def _branch(cp: np.ndarray, p: Pieces, unknown: float) -> tuple[int, float]:
    n = len(cp)
    ends, lengths, scores = [], [], []
    for lo in range(0, n, 1 << 20):  # ends of the pieces that are looked up together
        hi = min(n, lo + (1 << 20))
        h = np.zeros(hi - lo, tx.U)
        for k in range(1, min(hi, p.longest) + 1):
            skip = max(0, k - 1 - lo)  # ends before which there are too few characters
            h = tx.extend(h[max(0, skip - max(0, k - 2 - lo)) :], cp[lo + skip - k + 1 : hi - k + 1])
            hit, s = p.find(h, k)
            ends.append(hit + lo + skip)
            lengths.append(np.full(len(hit), k))
            scores.append(s)
    end, size, score = (np.concatenate(x) for x in (ends, lengths, scores))
    by = np.lexsort((size, end))
    at = np.searchsorted(end[by], np.arange(n + 1)).tolist()
    size, score, cost = size[by].tolist(), score[by].tolist(), _utf8(cp).tolist()
    best, count = [0.0] * (n + 1), [0] * (n + 1)
    for i in range(n):
        lo, hi = at[i], at[i + 1]
        if lo < hi and size[lo] == 1:  # a character with a piece is never unknown
            b, c = best[i] + score[lo], count[i] + 1
            lo += 1
        else:
            b, c = best[i] + unknown, count[i] + cost[i]
        for e in range(lo, hi):
            k = i + 1 - size[e]
            x, y = best[k] + score[e], count[k] + 1
            if x > b or (x == b and y < c):
                b, c = x, y
        best[i + 1], count[i + 1] = b, c
    return count[n], best[n]


def pretokens(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points with a gap sign for each blank and one before each text, new offsets, starts, ends).

    Pre-tokens begin at a gap sign after any other character and on both sides of a line feed; no piece crosses these.
    """
    n = len(off) - 1
    size = np.diff(off)
    some = size > 0
    out = np.empty(len(cp) + int(some.sum()), np.uint32)
    new = np.zeros(n + 1, np.int64)
    np.cumsum(size + some, out=new[1:])
    head = np.zeros(len(out), bool)
    head[new[:-1][some]] = True
    out[~head] = np.where(cp == 32, _GAP, cp)
    out[head] = _GAP
    gap, feed = out == _GAP, out == 10
    first = head
    first[1:] |= (gap[1:] & ~gap[:-1]) | feed[1:] | feed[:-1]
    s = np.flatnonzero(first)
    return out, new, s, np.append(s[1:], len(out)) if len(s) else s


_known: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def counts_of(col: pa.Array, p: Pieces, cache: str | None = None, most: int = 1_500_000) -> np.ndarray:
    """Tokens of each text of a string column."""
    cp, off = tx.codepoints(col)
    cp, off, s, e = pretokens(cp, off)
    keys, first, which = np.unique(tx.Spans(cp).hash(s, e), return_index=True, return_inverse=True)
    known, kept = _known.get(cache, (np.zeros(0, tx.U), np.zeros(0, np.int32)))
    if len(known) > most:
        known, kept = known[:0], kept[:0]
    at = np.searchsorted(known, keys)
    new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != keys) if len(known) else np.arange(len(keys))
    if len(new):
        got, _ = best_counts(cp, s[first[new]], (e - s)[first[new]], p)
        known, kept = np.insert(known, at[new], keys[new]), np.insert(kept, at[new], got)
        at = np.searchsorted(known, keys)
        if cache is not None:
            _known[cache] = known, kept
    sums = np.zeros(len(s) + 1, np.int64)
    if len(s):
        np.cumsum(kept[at][which], out=sums[1:])
    return np.diff(sums[np.searchsorted(s, off)]) if len(off) > 1 else np.zeros(0, np.int64)


def count_batches(batches: Iterator[pa.RecordBatch], p: Pieces, cache: str) -> Iterator[pa.RecordBatch]:
    """From batches (doc_id, text) to batches (doc_id, n_tokens)."""
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts_of(b.column(1), p, cache), pa.int64(), mask=null)], names=["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens: the number of pieces in the best unigram segmentation of each whole text with the pieces of
    the public model file at `model` (read on the driver, of fixed size, broadcast) and log-probabilities by their rank,
    see the head of this module; so counts are near, and not equal, to those of the model's own byte-pair encoder. One
    scan, no shuffle: distinct
    pre-tokens are inserted in a trie and scored once per shared prefix; a worker keeps the counts of those it has met.

    A null text counts null, an empty one 0; repeated rows and null or repeated doc_ids are rows of their own; columns
    besides doc_id and text are ignored; an empty table gives an empty table. Of segmentations with equal scores, the
    one with fewer tokens counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: count_batches(it, shared.value, model), "doc_id bigint, n_tokens bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
