"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm._spark import bloom, discard, fresh_name, table, written

N = 3
THRESHOLD = 0.5
#: A pair must share so many n-grams of its prefixes (or as many as its overlap needs, if fewer).
SHARED = 3
#: Entries of the matrix in one block of columns.
BLOCK_ENTRIES = 3_000_000
#: The most frequent n-grams that are known by frequency when n-grams are put in order; all others come first.
FREQUENT = 400_000
_SEEN = 4  # times that a task must meet an n-gram to report it
#: Bytes of n-gram sets, and number of sets, in one side of a tile that is multiplied whole.
TILE_BYTES, TILE_SETS = 8 << 20, 8192
#: Cells of a tile's product that are held at a time.
CELLS = 2 << 20
#: Documents of one set from which they are looked up in a broadcast, so that they need not meet in one task.
HOT = 200_000
#: Bands and rows of the min-hashes by which the likely pairs are put together before the product.
BANDS, ROWS = 8, 4
_C = [tx.U(0x9E3779B97F4A7C15), tx.U(0xC2B2AE3D27D4EB4F), tx.U(0x165667B19E3779F9), tx.U(0x27D4EB2F165667C5), tx.U(0x85EBCA77C2B2AE63)]


def gram_sets(cp: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct n-grams of each document, sorted within it; the offsets of documents).

    Words are lower-cased runs of letters and numbers; a document of fewer than n words has one n-gram of all of them.
    """
    h, doc, at = tx.words(cp, off)
    docs = len(off) - 1
    per = np.diff(at)
    total = len(h) - n + 1
    if total > 0:
        g = np.zeros(total, tx.U)
        for k in range(n):
            g += h[k : k + total] * _C[k % len(_C)] + tx.U(k)
        ok = doc[:total] == doc[n - 1 :]
        g, owner = tx.mix(g[ok]), doc[:total][ok]
    else:
        g, owner = np.zeros(0, tx.U), np.zeros(0, np.int64)
    few = np.flatnonzero((per > 0) & (per < n))
    if len(few):
        short = np.array([np.bitwise_xor.reduce(tx.mix(h[at[i] : at[i + 1]] + np.arange(1, per[i] + 1, dtype=tx.U))) for i in few], tx.U)
        g, owner = np.concatenate([g, short]), np.concatenate([owner, few])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[keep], owner[keep]
    return g, np.searchsorted(owner, np.arange(docs + 1))


_LANES = 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47


def signatures(g: np.ndarray, off: np.ndarray, lane: int = 0) -> np.ndarray:
    """One hash of each set; two lanes together tell sets apart."""
    c = np.zeros(len(g) + 1, tx.U)
    np.cumsum(tx.mix(g ^ tx.U(_LANES[lane])), out=c[1:])
    return tx.mix((c[off[1:]] - c[off[:-1]]) ^ (np.diff(off).astype(tx.U) * _C[1 + lane]))


def bands(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, BANDS): hashes of ROWS min-hashes each; every set must have a member."""
    out = np.zeros((len(off) - 1, BANDS), tx.U)
    for b in range(BANDS):
        for r in range(ROWS):
            least = np.minimum.reduceat(tx.mix(g ^ tx.U((b * ROWS + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), off[:-1])
            out[:, b] = tx.mix(out[:, b] + least + tx.U(b))
    return out


def _needed(size: np.ndarray, threshold: float) -> np.ndarray:
    """The overlap that a set needs with any other, at least."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


_SURVEY = "doc_id bigint, sig bigint, check bigint, n bigint, bands array<bigint>"


def _survey(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, two signatures, size, bands) of documents, of size 0 without words, and (null, n-gram, null, count,
    null) of n-grams met often."""
    seen: list[np.ndarray] = []
    met: np.ndarray = np.zeros(0, tx.U)
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            g, off = gram_sets(*tx.codepoints(b.column(1)), n)
            sig, check, size = signatures(g, off), signatures(g, off, 1), np.diff(off)
            some = np.flatnonzero(size)
            bare = np.flatnonzero(size == 0)
            if len(bare):
                yield _survey_rows(b.column(0).take(pa.array(bare)), sig[bare], check[bare], size[bare])
            if not len(some):
                continue
            keys = bands(g, np.append(off[some], off[-1])).ravel().view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(keys))
            yield _survey_rows(b.column(0).take(pa.array(some)), sig[some], check[some], size[some], lists)
            # copies count once
            _, first = np.unique(sig[some], return_index=True)
            first = first[~np.isin(sig[some][first], met)]
            met = np.concatenate([met, sig[some][first]])
            seen.append(g[tx.ragged(off[some[first]], size[some[first]])])
            if sum(map(len, seen)) > 5_000_000:
                yield _often(seen)
                seen, met = [], met[:0]
    if seen:
        yield _often(seen)


def _often(seen: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(seen), return_counts=True)
    often = n >= _SEEN
    return _survey_rows(pa.nulls(int(often.sum()), pa.int64()), keys[often], None, n[often])


def _survey_rows(ids: pa.Array, keys: np.ndarray, check: np.ndarray | None, count: np.ndarray, band: pa.Array | None = None) -> pa.RecordBatch:
    none = lambda t: pa.nulls(len(keys), t)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(keys.view(np.int64)), none(pa.int64()) if check is None else pa.array(check.view(np.int64)), pa.array(count, pa.int64()), none(pa.list_(pa.int64())) if band is None else band],
        names=["doc_id", "sig", "check", "n", "bands"],
    )


def _prefixes(g: np.ndarray, off: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, document) of the entries in each document's prefix: rare n-grams first, frequent ones by frequency."""
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), size)
    keys, rank = frequent
    order = np.zeros(len(g), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        order = np.where(keys[at] == g, rank[at], 0)
    by = np.argsort(owner * (len(keys) + 1) + order, kind="stable")  # by hash among equals
    need = _needed(size, threshold)
    length = size - need + np.minimum(need, SHARED)
    pick = by[tx.ragged(off[:-1], length)]
    return g[pick], owner[pick]


_BLOCKS = "block int, sigs binary, sizes binary, roots binary, grams binary, docs binary"


class _Blocks:
    """Collects the prefix entries of sets and cuts them in one row for each block of columns."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.clear()

    def clear(self) -> None:
        self.parts: list[list[np.ndarray]] = [[], [], [], [], []]
        self.sets = self.held = 0

    def add(self, g: np.ndarray, owner: np.ndarray, sig: np.ndarray, size: np.ndarray, root: np.ndarray) -> bool:
        """Whether it is time to flush."""
        for part, x in zip(self.parts, (g, owner + self.sets, sig, size, root)):
            part.append(x)
        self.sets += len(sig)
        self.held += len(g)
        return self.held > 4_000_000

    def flush(self) -> pa.RecordBatch:
        g, o, sig, size, root = (np.concatenate(x) for x in self.parts)
        self.clear()
        block = (g >> tx.U(32)) % tx.U(self.blocks)
        by = np.argsort(block, kind="stable")
        g, o, block = g[by], o[by], block[by]
        there_, first = np.unique(block, return_index=True)
        rows = []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(g)]):
            there, local = np.unique(o[i:j], return_inverse=True)
            rows.append((sig[there].tobytes(), size[there].astype(np.uint32).tobytes(), root[there].tobytes(), (g[i:j] & tx.U(0xFFFFFFFF)).astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(there_.astype(np.int32)), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(5)]], names=["block", "sigs", "sizes", "roots", "grams", "docs"])


def _prefix_sets(batches: Iterator[pa.RecordBatch], n: int, threshold: float, frequent: tuple[np.ndarray, np.ndarray], grouped: np.ndarray, inside: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(n-grams, their set, signatures, sizes) of the prefixes of the different sets of each slice of texts: of those
    that the filter of grouped ones lets through, or of those that it does not."""
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            g, off = gram_sets(*tx.codepoints(b.column(1)), n)
            sig, size = signatures(g, off), np.diff(off)
            _, first = np.unique(sig, return_index=True)
            first = np.sort(first[(size[first] > 0) & (tx.maybe(sig[first], grouped) == inside)])
            if len(first):
                at = tx.ragged(off[first], size[first])
                yield *_prefixes(g[at], np.concatenate([[0], np.cumsum(size[first])]), frequent, threshold), sig[first], size[first]


def _entries(batches: Iterator[pa.RecordBatch], n: int, threshold: float, blocks: int, frequent: tuple[np.ndarray, np.ndarray], grouped: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The prefix entries of the sets of a task that are in no group, one row for each block of columns."""
    out = _Blocks(blocks)
    for g, owner, sig, size in _prefix_sets(batches, n, threshold, frequent, grouped, False):
        if out.add(g, owner, sig, size, np.zeros(len(sig), np.int64)):
            yield out.flush()
    if out.held:
        yield out.flush()


def _grouped_prefixes(batches: Iterator[pa.RecordBatch], n: int, threshold: float, frequent: tuple[np.ndarray, np.ndarray], grouped: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(sig, size, grams) of the sets that may be in a group."""
    for g, owner, sig, size in _prefix_sets(batches, n, threshold, frequent, grouped, True):
        cut = np.searchsorted(owner, np.arange(len(sig) + 1))
        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(size, pa.int32()), pa.array([g[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], names=["sig", "size", "grams"])


def _grouped_entries(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """From (sig, size, grams, root; 0 where the set is in no group) to rows for each block of columns."""
    out = _Blocks(blocks)
    for b in batches:
        if not b.num_rows:
            continue
        grams = [np.frombuffer(x, tx.U) for x in b.column(2).to_pylist()]
        owner = np.repeat(np.arange(len(grams)), list(map(len, grams)))
        sig, size, root = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
        if out.add(np.concatenate(grams), owner, sig.view(tx.U), size.astype(np.int64), root):
            yield out.flush()
    if out.held:
        yield out.flush()


def _product(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The block's product with its transpose: (a, b, sizes, shared) of all pairs of different sets of near size, but
    for those of one group."""
    for t in tx.groups(batches, "block"):
        blocks = t.column("block").to_numpy()
        at = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
        for i, j in zip(at, [*at[1:], len(blocks)]):
            yield from _multiply(t.slice(i, j - i), threshold)


def _multiply(t: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    parts: dict[str, list] = {"sigs": [], "sizes": [], "roots": [], "grams": [], "docs": []}
    base = 0
    for sigs, sizes, roots, grams, docs in zip(*[t.column(c).to_pylist() for c in parts]):
        parts["sigs"].append(np.frombuffer(sigs, tx.U))
        parts["sizes"].append(np.frombuffer(sizes, np.uint32))
        parts["roots"].append(np.frombuffer(roots, np.int64))
        parts["grams"].append(np.frombuffer(grams, np.uint32))
        parts["docs"].append(np.frombuffer(docs, np.uint32) + np.uint32(base))
        base += len(sigs) // 8
    sigs, sizes, roots, grams, docs = (np.concatenate(parts[c]) for c in parts)
    # rows by size, copies as one
    by = np.lexsort((sigs, sizes))
    new = np.ones(len(by), bool)
    new[1:] = (sigs[by][1:] != sigs[by][:-1]) | (sizes[by][1:] != sizes[by][:-1])
    place = np.empty(len(by), tx.U)
    place[by] = np.cumsum(new).astype(tx.U) - tx.U(1)
    key, size, root = (x[by][new] for x in (sigs, sizes.astype(np.int64), roots))
    group = np.where(root == 0, np.arange(len(key)), -1 - np.unique(root, return_inverse=True)[1])  # apart from all groups
    entry = np.unique(grams.astype(tx.U) << tx.U(32) | place[docs])
    col, row = entry >> tx.U(32), (entry & tx.U(0xFFFFFFFF)).astype(np.int64)
    low, pending, total = np.arange(len(col)), [], 0
    k, n = 1, tx.U(len(key))

    def counted() -> tuple[np.ndarray, np.ndarray]:
        codes, weights = np.concatenate([c for c, _ in pending]), np.concatenate([w for _, w in pending])
        o = np.argsort(codes)
        codes, weights = codes[o], weights[o]
        new = np.flatnonzero(np.diff(codes, prepend=~codes[:1]))
        return codes[new], np.add.reduceat(weights, new)

    while True:
        low = low[low + k < len(col)]
        # rows of a column are in order of size, so once the partner is too large, all later ones are
        low = low[(col[low] == col[low + k])]
        low = low[size[row[low]] >= threshold * size[row[low + k]] - 1e-9]
        if not len(low):
            break
        other = low[group[row[low]] != group[row[low + k]]]
        for part in np.array_split(other, max(1, len(other) // 2_000_000)):
            pending.append((row[part].astype(tx.U) * n + row[part + k].astype(tx.U), np.ones(len(part), np.int32)))
            total += len(part)
            if total > 6_000_000:
                pending = [counted()]
                total = len(pending[0][0])
                if total > 3_000_000:
                    yield _pairs(*pending[0], key, size)
                    pending, total = [], 0
        k += 1
    if pending:
        yield _pairs(*counted(), key, size)


def _pairs(codes: np.ndarray, shared: np.ndarray, key: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    i, j = np.divmod(codes.astype(np.int64), len(key))
    swap = key[i] > key[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return pa.RecordBatch.from_arrays(
        [pa.array(key[i].view(np.int64)), pa.array(key[j].view(np.int64)), pa.array(size[i], pa.int32()), pa.array(size[j], pa.int32()), pa.array(shared, pa.int32())],
        names=["a", "b", "na", "nb", "shared"],
    )


def _possible(threshold: float) -> Column:
    """Whether the prefixes share enough for the pair to reach the threshold, with all that lies beyond one of them."""
    na, nb, shared = F.col("na"), F.col("nb"), F.col("shared")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - 1e-9)
    large = F.ceil(F.lit(threshold) * F.greatest(na, nb) - 1e-9)
    small = F.ceil(F.lit(threshold) * F.least(na, nb) - 1e-9)
    least = F.least(F.lit(SHARED), small)
    beyond = F.greatest(large - F.least(F.lit(SHARED), large), small - least)
    return (shared >= least) & (shared + beyond >= need)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the connected component of each end of the edges a, b; null ends are left out.

    Labels go to the neighbours and, by pointer jumping, to those that have the label's label, until none changes; each
    round is written, so that lost executors cost a round at most. A node with very many edges is a skewed key of a
    plain join, which adaptive execution splits.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropna().distinct(), "edges")
    table = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")), "labels")
    label = table
    while True:
        spread = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = label.join(spread, "id").select("id", F.least("root", "near").alias("next"), "root")
        jump = step.join(step.select(F.col("id").alias("next"), F.col("next").alias("far")), "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("next"), "root")
        new = written(jump, "labels")
        discard(table)
        table, label = new, new.select("id", F.col("next").alias("root"))
        if new.filter("next <> root").isEmpty():
            discard(both)
            return label


def _sets(batches: Iterator[pa.RecordBatch], n: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, sig, check, grams) of the documents that the filter may want."""
    for b in batches:
        ids = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(tx.U)
        b = b.filter(pa.array(tx.maybe(ids, wanted)))
        for p in tx.slices(b, "text", tx.SLICE):
            g, off = gram_sets(*tx.codepoints(p.column(1)), n)
            sig, check = (pa.array(signatures(g, off, k).view(np.int64)) for k in range(2))
            yield pa.RecordBatch.from_arrays([p.column(0), sig, check, pa.array([g[i:j].tobytes() for i, j in zip(off[:-1], off[1:])], pa.binary())], names=["id", "sig", "check", "grams"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> Iterator[tuple[int, np.ndarray]]:
    """The product of the incidence matrices of two lists of sets, as (first row, some rows of it) of about `cells` cells.

    N-grams that many of both lists have are multiplied as dense columns, some at a time; all others are counted from
    their inverted lists. An n-gram that one side lacks adds nothing.
    """
    ga, gb = np.concatenate(a), np.concatenate(b)
    ra, rb = (np.repeat(np.arange(len(x)), np.fromiter(map(len, x), np.int64, len(x))) for x in (a, b))
    common = np.intersect1d(ga, gb)
    step = max(1, cells // len(b))
    if not len(common):
        for lo in range(0, len(a), step):
            yield lo, np.zeros((min(step, len(a) - lo), len(b)), np.float32)
        return
    ca, cb = (np.minimum(np.searchsorted(common, x), len(common) - 1) for x in (ga, gb))
    ina, inb = common[ca] == ga, common[cb] == gb
    ca, ra, cb, rb = ca[ina], ra[ina], cb[inb], rb[inb]
    da, db = np.bincount(ca, minlength=len(common)), np.bincount(cb, minlength=len(common))
    heavy = 64 * da * db > len(a) * len(b)
    dense = np.cumsum(heavy) - 1
    n_dense, width = int(heavy.sum()), max(64, cells // max(len(b), step))
    by = np.argsort(cb, kind="stable")
    begin, lists = np.cumsum(db) - db, rb[by]
    hb, lb = dense[cb[heavy[cb]]], rb[heavy[cb]]
    row_at = np.searchsorted(ra, np.arange(len(a) + 1))  # entries are in order of rows
    for lo in range(0, len(a), step):
        hi = min(len(a), lo + step)
        c, r = ca[row_at[lo] : row_at[hi]], ra[row_at[lo] : row_at[hi]] - lo
        out = np.zeros((hi - lo, len(b)), np.float32)
        h = heavy[c]
        for first in range(0, n_dense, width):
            w = min(width, n_dense - first)
            x, y = np.zeros((hi - lo, w), np.float32), np.zeros((w, len(b)), np.float32)
            k = dense[c[h]] - first
            ok = (k >= 0) & (k < w)
            x[r[h][ok], k[ok]] = 1
            k = hb - first
            ok = (k >= 0) & (k < w)
            y[k[ok], lb[ok]] = 1
            out += x @ y
        c, r = c[~h], r[~h]
        flat, many = out.ravel(), np.cumsum(db[c])
        cuts = [0, *np.searchsorted(many, np.arange(cells, int(many[-1]) if len(many) else 0, cells)).tolist(), len(c)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j > i:
                np.add.at(flat, np.repeat(r[i:j] * len(b), db[c[i:j]]) + lists[tx.ragged(begin[c[i:j]], db[c[i:j]])], np.float32(1))
        yield lo, out


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least member of its component) after the edges i, j."""
    while True:
        x, y = label[i], label[j]
        go = x != y
        if not go.any():
            return label
        i, j, x, y = i[go], j[go], x[go], y[go]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, jump := label[label]):
            label = jump


def _tile(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a tile's rows: ids in order, sets, documents of each set, chunks; a tile of a chunk with itself has -1 only."""
    ids = t.column("id").to_numpy()
    ids, first = np.unique(ids, return_index=True)  # of rows that repeat a document, one
    sets = [np.frombuffer(t.column("grams")[int(k)].as_py(), tx.U) for k in first]
    chunk = np.where(t.column("diagonal").to_numpy()[first], -1, t.column("chunk").to_numpy()[first])
    return ids, sets, t.column("n").to_numpy()[first], chunk


def _similar(ids: np.ndarray, sets: list, chunk: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) of the similar pairs of a tile, i before j in a tile of one chunk, across them in one of two."""
    size = np.fromiter(map(len, sets), np.float64, len(sets))
    low = chunk.min()
    one = bool(low < 0)
    a = np.flatnonzero(chunk == low)
    b = a if one else np.flatnonzero(chunk != low)
    if not len(b):  # the other chunk has no sets
        return
    for lo, o in overlaps([sets[k] for k in a], [sets[k] for k in b]):
        rows = a[lo : lo + len(o)]
        hit = o >= (threshold / (1 + threshold)) * (size[rows][:, None] + size[b][None, :]) - 1e-9
        if one:
            hit &= np.arange(lo, lo + len(o))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(hit)
        yield rows[i], b[j], o[i, j]


_LINKS = "id bigint, root bigint, links bigint"
_PAIRS = "doc_a bigint, doc_b bigint, n_a bigint, n_b bigint, overlap bigint, jaccard double"


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for t in tx.groups(batches, "tile"):
        tile = t.column("tile").to_numpy()
        at = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1))
        for i, j in zip(at, [*at[1:], len(tile)]):
            yield t.slice(i, j - i)


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, the least id that the tile links it to, similar documents with other sets) of the sets that have a partner."""
    out: list[tuple[np.ndarray, ...]] = []
    for t in _by_tile(batches):
        ids, sets, n, chunk = _tile(t)
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for i, j, _ in _similar(ids, sets, chunk, threshold):
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            label = unite(label, i, j)
        some = np.flatnonzero(links)
        out.append((ids[some], ids[label[some]], links[some]))
        if sum(len(x) for x, _, _ in out) > 100_000:
            yield _columns(out, _LINKS)
            out = []
    if out:
        yield _columns(out, _LINKS)


def _listed(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for t in _by_tile(batches):
        ids, sets, _, chunk = _tile(t)
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        for i, j, o in _similar(ids, sets, chunk, threshold):
            i, j, o = np.minimum(i, j), np.maximum(i, j), o.astype(np.int64)
            if len(i):
                yield _columns([(ids[i], ids[j], size[i], size[j], o, o / (size[i] + size[j] - o))], _PAIRS)


def _columns(parts: list[tuple[np.ndarray, ...]], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(len(names))], names=names)


class Join:
    """The stages of the join over a table of documents, each written to the shared folder."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD, n: int = N):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be in (0, 1]")
        self.spark, self.threshold, self.n = docs.sparkSession, threshold, n
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
        survey = written(self.docs.mapInArrow(lambda it: _survey(it, n), _SURVEY), "survey")
        one = survey.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(F.col("n") == 0, "sig", "check", "n", "bands")).alias("s"))
        #: doc_id, sig, check, size, bands: a row for each document
        self.members = written(one.select("doc_id", "s.sig", "s.check", F.col("s.n").alias("size"), "s.bands"), "members")
        #: id (the least document), sig, check, size, n (documents), bands: a row for each different set
        self.sets = written(
            self.members.filter("size > 0").groupBy("sig", "check").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.count("*").alias("n"), F.first("bands").alias("bands")), "sets"
        )
        self.total = self.sets.agg(F.sum((1 - F.lit(threshold)) * F.col("size") + SHARED)).first()[0] or 0
        often = survey.filter("doc_id is null").groupBy("sig").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sig").limit(FREQUENT).toPandas()
        keys = often["sig"].to_numpy(np.int64).view(tx.U)
        order = np.argsort(keys)
        rank = np.arange(len(keys), 0, -1, dtype=np.int64)  # the most frequent comes last
        self.frequent = keys[order], rank[order]
        discard(survey)

    def likely(self) -> DataFrame:
        """Edges that link all sets that share a band, a star for each band's value. Nodes are signatures here: two sets
        with one signature are only put in the same component."""
        each = self.sets.select("sig", F.explode("bands").alias("band"))
        least = each.groupBy("band").agg(F.min("sig").alias("b"), F.count("*").alias("n")).filter("n > 1").select("band", "b")
        return written(each.join(least, "band").filter("sig <> b").select(F.col("sig").alias("a"), "b").distinct(), "likely")

    def candidates(self, roots: DataFrame) -> DataFrame:
        """Pairs a, b of signatures of different groups that may reach the threshold.

        Sets that a Bloom filter takes for grouped get their group by a join; all others enter without one. So whatever
        the size, no pair within a group is counted, and nothing but the filter and the frequent n-grams is broadcast.
        """
        blocks = max(8, int(self.total // BLOCK_ENTRIES) + 1)
        n, threshold = self.n, self.threshold
        sent = self.spark.sparkContext.broadcast((self.frequent, bloom(roots.select("id"))))
        apart = self.docs.mapInArrow(lambda it: _entries(it, n, threshold, blocks, *sent.value), _BLOCKS)
        maybe = self.docs.mapInArrow(lambda it: _grouped_prefixes(it, n, threshold, *sent.value), "sig bigint, size int, grams binary").groupBy("sig", "size").agg(F.first("grams").alias("grams"))
        rooted = maybe.join(roots.select(F.col("id").alias("sig"), "root"), "sig", "left").select("sig", "size", "grams", F.coalesce("root", F.lit(0)).alias("root"))
        grouped = rooted.mapInArrow(lambda it: _grouped_entries(it, blocks), _BLOCKS)
        parts = apart.unionAll(grouped).repartitionById(blocks, "block").sortWithinPartitions("block").mapInArrow(lambda it: _product(it, threshold), "a bigint, b bigint, na int, nb int, shared int")
        summed = parts.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
        return written(summed.filter(_possible(threshold)).select("a", "b"), "candidates")

    def tiles(self) -> tuple[DataFrame, int]:
        """(rows id, n, grams, chunk, diagonal, tile; number of partitions): every two sets of a component meet in a tile.

        A component is one tile, or, if its sets are too large or too many together, a square of tiles of its chunks.
        """
        likely = self.likely()
        groups = components(likely)
        candidates = self.candidates(groups)
        both = components(likely.unionAll(candidates))
        placed = written(both.join(self.sets.select("id", "sig", "check", "size", "n"), both["id"] == F.col("sig")).select(self.sets["id"], "sig", "check", "size", "n", "root"), "placed")
        discard(likely, candidates)
        sent, n = self.spark.sparkContext.broadcast(bloom(placed.select("id"))), self.n
        sets = self.docs.mapInArrow(lambda it: _sets(it, n, sent.value), "id bigint, sig bigint, check bigint, grams binary")
        chunks = F.greatest(F.ceil(F.sum(F.col("size") * 8) / TILE_BYTES), F.ceil(F.count("*") / TILE_SETS)).cast("int")
        load = placed.groupBy("root").agg(chunks.alias("chunks"), F.sum(F.col("size") * 8).alias("bytes"))
        moved = load.agg(F.sum(F.col("bytes") * F.col("chunks"))).first()[0] or 0
        cut = placed.join(load.select("root", "chunks"), "root").withColumn("chunk", F.pmod(F.hash("id"), F.col("chunks")))
        spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
            "id", "sig", "check", "n", "chunk", (F.col("chunk") == F.col("other")).alias("diagonal"), F.xxhash64("root", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile")
        )
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(moved // TILE_BYTES) + 1)
        return spread.join(sets, ["id", "sig", "check"]).select("id", "n", "grams", "chunk", "diagonal", "tile"), parts

    def _met(self, reduce, schema: str) -> DataFrame:
        rows, parts = self.tiles()
        threshold = self.threshold
        return rows.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(lambda it: reduce(it, threshold), schema)

    def classes(self, hot: int = HOT) -> DataFrame:
        """doc_id, class_id, links of every document.

        Documents of sets with at least `hot` of them, of which there can be only so many, stay where they are: their
        class and links come to them by a broadcast of at most 1 / hot of the rows.
        """
        linked = written(self._met(_linked, _LINKS), "linked")
        roots = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a <> b"))
        links = linked.groupBy("id").agg(F.sum("links").alias("links"))
        every = written(
            self.sets.join(roots, "id", "left").join(links, "id", "left")
            .select("sig", "check", F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "n"), "classes"
        )
        discard(linked)
        docs = self.members.select("doc_id", "sig", "check", "size")
        large = F.broadcast(every.filter(F.col("n") >= hot).select("sig", "check", F.col("class_id").alias("_c"), F.col("links").alias("_l")))
        marked = docs.join(large, ["sig", "check"], "left")
        at_once = marked.filter("_c is not null").select("doc_id", F.col("_c").alias("class_id"), F.col("_l").alias("links"))
        rest = marked.filter("_c is null and size > 0").join(every.filter(F.col("n") < hot), ["sig", "check"]).select("doc_id", "class_id", "links")
        bare = docs.filter("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
        return at_once.unionAll(rest).unionAll(bare)


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """doc_id, class_id, links of every document: its links are the other documents whose sets of word n-grams have at
    least that Jaccard similarity with its own; documents that links join are a class, named by the least doc_id in it.
    Exact, every document against every other; no pair is listed.

    N-grams are put in one global order, rare ones first; a document enters only a prefix of its n-grams in that order,
    long enough that a pair at the threshold shares SHARED entries. The entries are split in blocks of columns, each
    block is multiplied with its transpose in one task, and the counts of a pair are added over blocks; pairs of sizes
    too far apart, or with counts below what their sizes ask for, are discarded. Sets that share a band of min-hashes
    are grouped beforehand and left out of that product. Groups and remaining candidates are linked to components, in
    which the sparse matrix of whole sets is multiplied with its transpose, tile by tile and some rows at a time.
    Documents with equal sets (by two signatures of 64 bits) are one row of the matrix.

    Words are lower-cased runs of letters and numbers; a document of fewer than n words has one n-gram. Documents
    without words (null, empty, blank texts) are classes of their own without links; rows with a null doc_id are left
    out; of rows that repeat a doc_id one counts, one with words if there is any; other columns are ignored; an empty
    table gives an empty table.
    """
    return Join(docs, threshold, n).classes()


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """doc_a < doc_b, n_a, n_b, overlap, jaccard of the similar pairs of different sets, each set for the least of the
    documents that have it; see near_duplicate_classes()."""
    return Join(docs, threshold, n)._met(_listed, _PAIRS)


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """One document of each class stays, that with the least doc_id, with all rows that repeat this doc_id. Documents
    without words and rows with a null doc_id stay; all columns stay as they are, whatever their names; ties cannot
    occur, as a class has one least doc_id; an empty table gives an empty table."""
    name = fresh_name("gone", docs.columns)
    gone = written(near_duplicate_classes(docs, threshold, n).filter("doc_id <> class_id").select(F.col("doc_id").alias(name)), "near-duplicates")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone[name], "left_anti")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op8_ngram_join": op8_ngram_join}
ORACLES = {
    "op8_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS g FROM w WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 p AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE overlap >= {THRESHOLD} * (x.n + y.n - overlap) - 1e-9),
 r AS (SELECT a AS doc_id, a AS met FROM (SELECT DISTINCT a FROM p) UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.met)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN (SELECT doc_id, min(met) AS class_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM p GROUP BY a) l ON l.doc_id = d.doc_id
"""
}
