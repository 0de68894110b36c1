"""Session helpers: lineage cuts in the shared folder, and the tables of a data directory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lexiweave.functions.session import discard, spread  # noqa: F401
from lexiweave.functions.session import kept as written  # noqa: F401
from lexiweave.llm import _text as tx

#: What is sent to every executor may have this many bytes; beyond, each operator has a way that joins instead.
BROADCAST_BYTES = 64 << 20


def fresh_name(name: str, *schemas: list[str]) -> str:
    """`name`, with underscores before it until no column has it, in any letter case."""
    taken = {c.lower() for s in schemas for c in s}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bloom(ids: DataFrame) -> np.ndarray:
    """A packed Bloom filter of a one-column table of bigints: 16 bits a row, 8 MiB at most. Beyond, it lets more
    through, so what it thins out must be joined exactly afterwards."""
    bits = int(min(26, max(10, np.ceil(np.log2(max(ids.count(), 1) * 16)))))
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for r in ids.coalesce(8).mapInArrow(lambda it: tx.bloom_part(it, bits), "bits binary").toLocalIterator():
        packed |= np.frombuffer(r["bits"], np.uint8)
    return packed
