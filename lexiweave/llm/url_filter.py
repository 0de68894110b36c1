"""URL filters: a cascade of Bloom filters that answers membership exactly over a known universe of keys."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm._spark import BROADCAST_BYTES, table, written

#: Keys of one shard, so that a shard's universe fits in a worker whatever the corpus.
SHARD_KEYS = 500_000
#: Partitions of the shards at most.
MOST_PARTS = 20_000
FIRST_RATE, NEXT_RATE = 0.1, 0.5
_SALT = 0x5EED


def url_key(url: Column) -> Column:
    """The key of a URL: without scheme, `www.` or `m.`, query, fragment and closing slash; the host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/]*)", 1)), r"^(www\.|m\.)", "")
    return F.regexp_replace(F.concat(host, F.regexp_extract(rest, r"^[^/]*(.*)$", 1)), r"/+$", "")


class Bloom:
    def __init__(self, bits: np.ndarray, m: int, k: int, seed: int):
        self.bits, self.m, self.k, self.seed = bits, m, k, seed

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, rate: float, seed: int) -> Bloom:
        m = max(64, int(np.ceil(-len(a) * np.log(rate) / np.log(2) ** 2)))
        self = cls(np.zeros((m + 7) // 8, np.uint8), m, max(1, round(-np.log2(rate))), seed)
        for at in self._at(a, b):
            np.bitwise_or.at(self.bits, at >> tx.U(3), np.uint8(1) << (at & tx.U(7)).astype(np.uint8))
        return self

    def _at(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        h, step = tx.mix(a + tx.U(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), tx.mix(b ^ tx.U(self.seed)) | tx.U(1)
        for i in range(self.k):
            yield (h + tx.U(i) * step) % tx.U(self.m)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in self._at(a, b):
            out &= (self.bits[at >> tx.U(3)] >> (at & tx.U(7)).astype(np.uint8)) & 1 == 1
        return out


class Cascade:
    """Level 1 holds the listed keys, level 2 the unlisted ones that level 1 lets through, level 3 the listed ones that
    level 2 lets through, and so on until none is left: the first level that lacks a key of the universe decides."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> Cascade:
        levels: list[Bloom] = []
        inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
        while len(inside):
            f = Bloom.of(a[inside], b[inside], NEXT_RATE if levels else FIRST_RATE, len(levels) + 1)
            levels.append(f)
            inside, outside = outside[f.holds(a[outside], b[outside])], inside
        return cls(levels)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), len(self.levels) % 2 == 1)
        open_ = np.arange(len(a))
        for i, f in enumerate(self.levels):
            there = f.holds(a[open_], b[open_])
            out[open_[~there]] = i % 2 == 1
            open_ = open_[there]
        return out

    def dump(self) -> bytes:
        return b"".join(struct.pack("<QII", f.m, f.k, f.seed) + f.bits.tobytes() for f in self.levels)

    @classmethod
    def load(cls, data: bytes) -> Cascade:
        levels, at = [], 0
        while at < len(data):
            m, k, seed = struct.unpack_from("<QII", data, at)
            n = (m + 7) // 8
            levels.append(Bloom(np.frombuffer(data, np.uint8, n, at + 16), m, k, seed))
            at += 16 + n
        return cls(levels)


def _pairs(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.ascontiguousarray(b.column(c).to_numpy() if isinstance(b, pa.Table) else b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)).view(tx.U) for c in ("_a", "_b"))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in tx.groups(batches, "_shard"):
        a, b = _pairs(t)
        shard, listed = t.column("_shard").to_numpy(), t.column("_listed").to_numpy()
        at = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
        for i, j in zip(at, [*at[1:], len(shard)]):
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[i])], pa.int32()), pa.array([Cascade.of(a[i:j], b[i:j], listed[i:j]).dump()], pa.binary())], names=["_shard", "levels"])


def _hashed(df: DataFrame, key: Column, shards: int) -> DataFrame:
    # the shard comes from a hash of its own, lest it shorten those that the filters use
    return df.withColumns({"_a": F.xxhash64(key), "_b": F.xxhash64(key, F.lit(_SALT)), "_shard": F.pmod(F.hash(key), F.lit(shards))})


def build(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(table _shard, levels; number of shards) from two one-column tables `key`.

    Keys are spread over shards by a hash; the listed ones and the rest of a shard's universe meet in one task, which
    builds all levels of that shard. Null keys are left out, repeated keys count once, and listed keys that the universe
    lacks are part of it.
    """
    keys = universe.select("key", F.lit(False).alias("_listed")).unionAll(listed.select("key", F.lit(True).alias("_listed"))).filter("key is not null")
    shards = max(1, -(-universe.count() // shard_keys))
    distinct = _hashed(keys, F.col("key"), shards).groupBy("_shard", "_a", "_b").agg(F.max("_listed").alias("_listed"))
    cascade = distinct.repartitionById(min(shards, MOST_PARTS), F.col("_shard") % min(shards, MOST_PARTS)).sortWithinPartitions("_shard").mapInArrow(_build, "_shard int, levels binary")
    return written(cascade, "url-cascade"), shards


def _apply(batches: Iterator[pa.RecordBatch], filters: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    loaded = {k: Cascade.load(v) for k, v in filters.items()}
    for b in batches:
        a, c = _pairs(b)
        shard = b.column(b.schema.get_field_index("_shard")).to_numpy(zero_copy_only=False)
        out = np.zeros(len(a), bool)
        for k in np.unique(shard):
            at = np.flatnonzero(shard == k)
            if int(k) in loaded:
                out[at] = loaded[int(k)].holds(a[at], c[at])
        keep = [i for i, n in enumerate(b.schema.names) if not n.startswith("_")]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(out)], names=[*[b.schema.names[i] for i in keep], "listed"])


def _apply_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _apply, from partitions where a shard's filter row stands before the shard's keys."""
    have: dict[int, bytes] = {}
    for b in batches:
        t = pa.Table.from_batches([b])
        is_filter = t.column("levels").is_valid()
        f = t.filter(is_filter)
        new = dict(zip(f.column("_shard").to_pylist(), f.column("levels").to_pylist()))
        rows = t.filter(pa.compute.invert(is_filter)).drop_columns(["levels"])
        have |= new
        for r in rows.to_batches():
            yield from _apply(iter([r]), {k: have[k] for k in set(r.column(r.schema.get_field_index("_shard")).to_pylist()) if k in have})
        if new:  # sorted by shard: earlier filters are done with
            have = {max(new): new[max(new)]}


def flag(pages: DataFrame, cascade: DataFrame, shards: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, key, listed: exact for every key of the cascade's universe, without a join.

    Filters of at most `limit` bytes in all are sent to every executor and pages are read in one scan; larger ones are
    brought to the pages of their shard by one shuffle. Null urls have a null key and are not listed; repeated rows and
    null page_ids are rows of their own; other columns are ignored; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("key", url_key(F.col("url")))
    known = _hashed(rows.filter("key is not null"), F.col("key"), shards)
    schema = "page_id bigint, url string, key string, listed boolean"
    size = cascade.agg(F.coalesce(F.sum(F.length("levels")), F.lit(0))).first()[0]
    if size <= limit:
        sent = spark.sparkContext.broadcast({r["_shard"]: bytes(r["levels"]) for r in cascade.collect()})
        out = known.mapInArrow(lambda it: _apply(it, sent.value), schema)
    else:
        both = known.withColumn("levels", F.lit(None).cast("binary")).unionByName(cascade, allowMissingColumns=True)
        out = both.repartitionById(min(shards, MOST_PARTS), F.col("_shard") % min(shards, MOST_PARTS)).sortWithinPartitions("_shard", F.col("levels").isNull()).mapInArrow(_apply_shards, schema)
    return out.unionAll(rows.filter("key is null").withColumn("listed", F.lit(False)))


#: The junk hosts of pages, under whatever ending and with any subdomain.
JUNK_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SPAM_HOSTS = rf"(^|\.)({'|'.join(JUNK_HOSTS)})\."


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is that of all keys on hosts named as spam; the universe is every key of pages."""
    pages = table(spark, sf_dir, "pages")
    keys = pages.select(url_key(F.col("url")).alias("key"))
    cascade, shards = build(keys, keys.filter(F.regexp_extract("key", r"^([^/]*)", 1).rlike(SPAM_HOSTS)))
    return flag(pages, cascade, shards)


QUERIES = {"op10_url_filter": op10_url_filter}
_REST = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '', 's')"
ORACLES = {
    "op10_url_filter": rf"""
WITH k AS (
  SELECT page_id, url, regexp_replace(
      regexp_replace(lower(regexp_extract({_REST}, '^([^/]*)', 1)), '^(www\.|m\.)', '')
      || regexp_extract({_REST}, '^[^/]*(.*)$', 1), '/+$', '') AS key
  FROM pages)
SELECT page_id, url, key, coalesce(regexp_matches(regexp_extract(key, '^([^/]*)', 1), '{SPAM_HOSTS}'), false) AS listed FROM k
"""
}
