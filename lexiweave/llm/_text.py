"""Vectorised text primitives shared by the operators of this subpackage.

Arrow string columns are turned into flat code-point arrays, on which words, pre-tokens and lines are spans;
any span is hashed in constant time from one running polynomial sum modulo 2**64.
"""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_B = U(0x9E3779B97F4A7C15 | 1)
_BINV = U(pow(int(_B), -1, 1 << 64))
_TOP = 0x32400  # beyond lie only marks, variation selectors and private-use characters
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Bytes of text that are worked on at a time; the arrays over them take some hundred times as much.
SLICE = 1 << 20


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, its length-preserving lower case)."""
    kind = np.zeros(_TOP + 1, np.uint8)
    low = np.arange(_TOP + 1, dtype=np.uint32)
    for i in range(_TOP):
        c = chr(i)
        g = unicodedata.category(c)[0]
        if g == "L":
            kind[i] = LETTER
            if (x := c.lower()) != c and len(x) == 1:
                low[i] = ord(x)
        elif g == "N":
            kind[i] = NUMBER
        elif c.isspace() and not 0x1C <= i <= 0x1F:
            kind[i] = SPACE
    return kind, low


def classes(cp: np.ndarray) -> np.ndarray:
    return tables()[0][np.minimum(cp, _TOP)]


def lowered(cp: np.ndarray) -> np.ndarray:
    return np.where(cp < _TOP, tables()[1][np.minimum(cp, _TOP)], cp)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, b in enumerate((_B, _BINV)):
            p = np.full(m, b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Hashes of any spans of a code-point array."""

    def __init__(self, cp: np.ndarray):
        power, _ = _power(len(cp) + 1)
        self.sum = np.zeros(len(cp) + 1, U)
        np.cumsum((cp.astype(U) + U(0x51ED27)) * power[:-1], out=self.sum[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The unscrambled polynomial, for callers that combine spans."""
        return (self.sum[end] - self.sum[start]) * _power(len(self.sum))[1][start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


def extend(polynomial: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The polynomial of a span (see Spans.raw) with one more code point before it."""
    return polynomial * _B + before.astype(U) + U(0x51ED27)


def power(n: int) -> np.ndarray:
    return _power(n)[0]


def as_strings(col) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col if pa.types.is_large_string(col.type) else col.cast(pa.large_string())


def slices(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text column of a slice has about `limit` bytes (one document at least)."""
    n = batch.num_rows
    if not n:
        return
    col = as_strings(batch.column(batch.schema.get_field_index(name)))
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Give freed memory back: workers outlive their tasks, and what one keeps the others lack."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # a C library without it
        return None


def codepoints(col) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, the n + 1 offsets of the documents); null texts are empty."""
    col = as_strings(col)
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    if not n or off[-1] == off[0]:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if data.max() < 128:
        return data.astype(np.uint32), off
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le", "surrogatepass"), np.uint32), seen[off]


def runs(mask: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where mask holds, none of which crosses a position of `cut`."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = cut[(cut > 0) & (cut < n)]
    first[inner] |= mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] |= mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, … for each of the given lengths, one after another."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)


def words(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased runs of letters and numbers: their hashes, their documents, and the n + 1 offsets of documents."""
    kind = classes(cp)
    s, e = runs((kind == LETTER) | (kind == NUMBER), off)
    h = Spans(lowered(cp)).hash(s, e)
    at = np.searchsorted(s, off)
    return h, np.repeat(np.arange(len(off) - 1), np.diff(at)), at


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Join the batches of a partition sorted by key into tables that hold whole groups."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key))
        same = int(np.searchsorted(k.to_numpy(zero_copy_only=False), k[-1].as_py(), "left"))
        if same or (rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1] != k[0]):
            yield pa.Table.from_batches([*rest, *([b.slice(0, same)] if same else [])])
            rest = []
        rest.append(b.slice(same))
    if rest:
        yield pa.Table.from_batches(rest)


_BLOOM = (0x243F6A88, 0x85A308D3, 0x13198A2E)


def bloom_part(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The Bloom filter, of 2**bits bits, of a task's ids."""
    ids = [b.column(0).to_numpy(zero_copy_only=False).view(U) for b in batches]
    if ids:
        out = np.zeros(1 << bits, bool)
        for salt in _BLOOM:
            out[mix(np.concatenate(ids) ^ U(salt)) >> U(64 - bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])


def maybe(ids: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which ids a packed Bloom filter lets through."""
    bits, ok = int(len(packed) * 8).bit_length() - 1, np.ones(len(ids), bool)
    for salt in _BLOOM:
        at = mix(ids ^ U(salt)) >> U(64 - bits)
        ok &= (packed[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1
    return ok
