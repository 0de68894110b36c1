"""Packing of documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm import unigram
from lexiweave.llm._spark import table, written

#: Tokens of a window.
CAPACITY = 4096
#: Tokens of the documents that are packed together; their number grows with the input, the work in one does not.
BLOCK_TOKENS = 1_000_000
#: Blocks that a task packs, one after another, where there are enough for all cores: a block is less than a tenth of a second's work, and every task costs buffers for sorting and a file.
TASK_BLOCKS = 64
#: Partitions of the blocks at most, lest a driver must follow too many tasks; beyond, a task packs more blocks.
MOST_PARTS = 20_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part, of k, of each size: the two partial partitions with the largest imbalance are merged, the largest part
    of one with the smallest of the other, until one is left.

    A partition is kept as its parts that have members, by ascending sum less that of the smallest part of all; parts
    are nodes of a forest over the sizes.
    """
    n = len(sizes)
    parent = np.full(max(1, 2 * n), -1, np.int64)
    free = n
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    held = {i: (np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes.tolist())}
    if k == 1:
        for i, (s, nodes) in held.items():
            held[i] = (s - s[0], nodes)
        heap = [(0, i) for i in range(n)]
    turn = n
    while len(heap) > 1:
        (a, an), (b, bn) = held.pop(heapq.heappop(heap)[1]), held.pop(heapq.heappop(heap)[1])
        both = len(a) + len(b) - k
        if both > 0:
            new = np.arange(free, free + both)
            free += both
            parent[an[:both]] = parent[bn[:both]] = -1
            parent[an[:both]], parent[bn[:both][::-1]] = new, new
            sums = np.concatenate([a[:both] + b[:both][::-1], a[both:], b[both:]])
            nodes = np.concatenate([new, an[both:], bn[both:]])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([an, bn])
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == k:
            sums = sums - sums[0]
        held[turn] = (sums, nodes)
        heapq.heappush(heap, (-int(sums[-1]), turn))
        turn += 1
    part = np.full(len(parent), -1, np.int64)
    last = held[heap[0][1]][1] if heap else np.zeros(0, np.int64)
    part[last] = np.arange(len(last))
    for node in range(free - 1, -1, -1):  # a node's parent was made after it
        if parent[node] >= 0:
            part[node] = part[parent[node]]
    return part[:n]


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none of which is over capacity: as few windows as would hold the sum, then more for
    what exceeds the capacity, until nothing does."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if sizes.max() > capacity:
        raise ValueError("a size is over capacity")
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        over = np.maximum(np.bincount(window, sizes, k).astype(np.int64) - capacity, 0).sum()
        if not over:
            return window
        k = min(len(sizes), k + max(1, -(-int(over) // capacity)))


def _pack(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    for t in tx.groups(batches, "block"):
        block = t.column("block").to_numpy()
        at = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        for i, j in zip(at, [*at[1:], len(block)]):
            n = t.column("n_tokens").slice(i, j - i).to_numpy()
            full, rest = n // capacity, n % capacity
            some = np.flatnonzero(rest)
            window = pack_sizes(rest[some], capacity)
            k = int(window.max()) + 1 if len(window) else 0
            load = np.bincount(window, rest[some], k).astype(np.int64)
            cut = np.repeat(np.arange(len(n)), full)
            nth = np.arange(len(cut)) - np.repeat(np.cumsum(full) - full, full)
            row = np.concatenate([cut, some])
            ids = t.column("doc_id").slice(i, j - i).combine_chunks().take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.concatenate([nth * capacity, full[some] * capacity]), pa.int64()),
                    pa.array(np.concatenate([np.full(len(cut), capacity), rest[some]]), pa.int64()),
                    pa.array((int(block[i]) << 32) + np.concatenate([k + np.arange(len(cut)), window]), pa.int64()),
                    pa.array(np.concatenate([np.full(len(cut), capacity), load[window]]), pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "window_id", "window_tokens"],
            )


_OUT = "doc_id bigint, start bigint, n_tokens bigint, window_id bigint, window_tokens bigint"


def _salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With the number of each row among the rows of its batch that are equal to it."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.where(b.column(0).is_null().to_numpy(zero_copy_only=False), -1, b.column(0).fill_null(-1).to_numpy(zero_copy_only=False))
        n = b.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
        by = np.lexsort((n, ids))
        new = np.ones(len(by), bool)
        new[1:] = (ids[by][1:] != ids[by][:-1]) | (n[by][1:] != n[by][:-1])
        first = np.flatnonzero(new)
        nth = np.empty(len(by), np.int64)
        nth[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nth)], names=["doc_id", "n_tokens", "nth"])


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The pieces of a table doc_id, n_tokens in windows; see pack(). `lengths` is read three times, so it should be a
    written table."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    lengths = lengths.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    total = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    # equal rows (null ids, repeated documents) are told apart, lest they all lie in one block
    some = lengths.filter("n_tokens > 0").mapInArrow(_salted, "doc_id bigint, n_tokens bigint, nth bigint")
    placed = some.withColumn("block", F.pmod(F.xxhash64("doc_id", "n_tokens", "nth"), F.lit(blocks)).cast("int"))
    parts = min(blocks, MOST_PARTS, max(lengths.sparkSession.sparkContext.defaultParallelism, -(-blocks // TASK_BLOCKS)))
    packed = placed.repartitionById(parts, F.col("block") % parts).sortWithinPartitions("block", "doc_id", "n_tokens").mapInArrow(lambda it: _pack(it, capacity), _OUT)
    none = F.lit(None).cast("bigint")
    return packed.unionAll(lengths.filter("n_tokens is null or n_tokens = 0").select("doc_id", none, "n_tokens", none, none))


def pack(docs: DataFrame, capacity: int = CAPACITY, model: str = unigram.MODEL) -> DataFrame:
    """doc_id, start, n_tokens, window_id, window_tokens: which tokens of which document lie in which window.

    Lengths are the token counts of op 5 over whole texts. A document over capacity fills windows of its own; what is
    left of it, and every other document, goes whole into a window together with others of its block. Blocks hold about
    BLOCK_TOKENS tokens, drawn by a hash of the row, so each is packed in one task, and only lengths are shuffled.

    Null texts (n_tokens null) and texts without tokens (0) have one row with a null window; repeated rows and null
    doc_ids are packed as rows of their own, spread over blocks; ties are broken by doc_id; other columns are ignored; an empty table gives
    an empty table.
    """
    return pack_lengths(written(unigram.token_counts(docs, model), "lengths"), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
