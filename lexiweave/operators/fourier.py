"""An RBF kernel as an explicit map: random Fourier features (Rahimi and Recht, 2007)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_PAIRS = "array<struct<attr_id:bigint,value:double>>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(keys: np.ndarray) -> np.ndarray:
    return ((_mix(keys) >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def directions(attr_ids: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """(attributes, dims) standard normal numbers, drawn by a hash of attribute, dimension and seed, so that no matrix
    need be sent to anyone."""
    key = _mix(attr_ids.astype(_U)[:, None] * _U(0x9E3779B97F4A7C15) + np.arange(dims, dtype=_U)[None, :] * _U(0xC2B2AE3D27D4EB4F) + _U(seed))
    return np.sqrt(-2 * np.log(_uniform(key))) * np.cos(2 * np.pi * _uniform(key ^ _U(0x165667B19E3779F9)))


def mapped(values: np.ndarray, attr_ids: np.ndarray, begin: np.ndarray, dims: int, gamma: float, seed: int) -> np.ndarray:
    """(documents, dims): features whose inner products are exp(-gamma |x - y|²) but for an error of about dims ** -0.5.

    begin: the first entry of each document, and the number of entries at the end.
    """
    n = len(begin) - 1
    known, at = np.unique(attr_ids, return_inverse=True)
    out = np.zeros((n, dims))
    step = max(1, (1 << 21) // dims)  # entries at a time
    owner = np.repeat(np.arange(n), np.diff(begin))
    for lo in range(0, len(known), step):  # attributes at a time
        w = directions(known[lo : lo + step], dims, seed)
        mine = np.flatnonzero((at >= lo) & (at < lo + step))
        for i in range(0, len(mine), step):
            part = mine[i : i + step]
            first = np.flatnonzero(np.diff(owner[part], prepend=-1))
            out[owner[part][first]] += np.add.reduceat(values[part, None] * w[at[part] - lo], first)
    phase = 2 * np.pi * _uniform(_mix(np.arange(dims, dtype=_U) + _U(seed ^ 0x5EED)))
    return np.sqrt(2 / dims) * np.cos(np.sqrt(2 * gamma) * out + phase)


def _arrays(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, attribute ids, bounds) of a column of arrays of (attr_id, value)."""
    col = b.column(at)
    flat = col.flatten()
    n = np.array([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()], np.int64)
    return flat.field(1).to_numpy(zero_copy_only=False), flat.field(0).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])


def fourier_map(rows: DataFrame, features: str, dims: int, gamma: float, seed: int = 7) -> DataFrame:
    """rows with z array<double> instead of a column array<struct<attr_id, value>>."""
    others = [c for c in rows.columns if c != features]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, F.coalesce(F.col(features).cast(_PAIRS), F.array().cast(_PAIRS))).mapInArrow(lambda it: _map(it, dims, gamma, seed), f"{schema}, z array<double>")


def _map(batches: Iterator[pa.RecordBatch], dims: int, gamma: float, seed: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401  workers that only read batches lack it

    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            b = whole.slice(i, 1000)
            z = mapped(*_arrays(b, b.num_columns - 1), dims, gamma, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * dims, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], "z"])


def fourier_features(vectors: DataFrame, docs: DataFrame, dims: int, gamma: float, seed: int = 7) -> DataFrame:
    """doc_id, z array<double> of every document of docs; one without features has those of the zero vector."""
    rows = vectors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("attr_id").cast("bigint").alias("attr_id"), F.col("value").cast("double").alias("value")))).alias("f"))
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(rows.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id", "left")
    return fourier_map(every.select("doc_id", "f"), "f", dims, gamma, seed)
