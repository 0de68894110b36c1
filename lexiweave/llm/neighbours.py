"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # workers that only read batches lack it
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm._spark import BROADCAST_BYTES, written

#: Neighbours of a node in the graph, neighbours asked for, nodes that a search keeps in view.
DEGREE, TOP, BEAM = 32, 10, 160
#: Building stops when fewer than this share of the edges is new, or after so many rounds.
CHANGED, ROUNDS = 0.01, 8
#: Rows that are compared with each other for the first graph, and how often rows are put in such leaves.
LEAF, TREES = 256, 3
#: Nodes that every search begins from besides its own, and nodes that it expands at a time.
ENTRIES, EXPAND = 256, 4
#: A query that is no node begins from what it finds among one in so many nodes, wherever ENTRIES are a smaller share.
THIN = 16
_GRAPH = "id bigint, nb binary, ds binary, nw binary"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances (…, n, m)."""
    return np.maximum((a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2)), 0)


def best_of(owner: np.ndarray, ids: np.ndarray, ds: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest different ids of each owner, flat and sorted by owner and distance; of equal ids a known one stays."""
    o = np.lexsort((new, ids, owner))
    owner, ids, ds, new = owner[o], ids[o], ds[o], new[o]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, ds, new = owner[keep], ids[keep], ds[keep], new[keep]
    o = np.lexsort((ids, ds, owner))
    owner, ids, ds, new = owner[o], ids[o], ds[o], new[o]
    first = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1))
    nth = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    keep = nth < k
    return owner[keep], ids[keep], ds[keep], new[keep]


def _packed(owner: np.ndarray, ids: np.ndarray, ds: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1))
    ends = np.append(first[1:], len(owner))
    cut = lambda x, t: pa.array([x[i:j].astype(t).tobytes() for i, j in zip(first, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(owner[first], pa.int64()), cut(ids, np.int64), cut(ds, np.float32), cut(new, np.uint8)], names=["id", "nb", "ds", "nw"])


def _flat(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    c = lambda n: t.column(n) if isinstance(t, pa.Table) else t.column(t.schema.get_field_index(n))
    ids = np.frombuffer(b"".join(c("nb").to_pylist()), np.int64)
    n = pa.compute.binary_length(c("nb")).to_numpy(zero_copy_only=False) // 8 if not isinstance(t, pa.Table) else pa.compute.binary_length(c("nb")).to_numpy() // 8
    key = c("id").to_numpy(zero_copy_only=False) if not isinstance(t, pa.Table) else c("id").to_numpy()
    return np.repeat(key, n), ids, np.frombuffer(b"".join(c("ds").to_pylist()), np.float32), np.frombuffer(b"".join(c("nw").to_pylist()), np.uint8)


def _leaves(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each row among LEAF rows that follow each other in the tree's order."""

    def within(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        d = _distances(v, v)
        np.fill_diagonal(d, np.inf)
        m = min(k, len(ids) - 1)
        at = np.argpartition(d, m - 1, 1)[:, :m]
        owner = np.repeat(ids, m)
        return _packed(*best_of(owner, ids[at].ravel(), np.take_along_axis(d, at, 1).ravel(), np.ones(len(owner), np.uint8), k))

    ids, vs = np.zeros(0, np.int64), []
    for b in batches:
        ids = np.concatenate([ids, b.column(0).to_numpy(zero_copy_only=False)])
        vs += b.column(1).to_pylist()
        while len(ids) >= 2 * LEAF:
            yield within(ids[:LEAF], np.frombuffer(b"".join(vs[:LEAF]), np.float32).reshape(LEAF, -1))
            ids, vs = ids[LEAF:], vs[LEAF:]
    if len(ids) > 1:
        yield within(ids, np.frombuffer(b"".join(vs), np.float32).reshape(len(ids), -1))


def _codes(batches: Iterator[pa.RecordBatch], planes: np.ndarray, centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row's place in a tree: on which side of each plane it lies, then where along one more direction."""
    for b in batches:
        v = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, -1)
        side = (v - centre) @ planes
        code = ((side[:, :-1] > 0) @ (1 << np.arange(planes.shape[1] - 1))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.int64()), pa.array(side[:, -1].astype(np.float64))], names=["id", "v", "code", "along"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, member, new, forward) of every edge, in both directions."""
    for b in batches:
        o, i, _, n = _flat(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([o, i])), pa.array(np.concatenate([i, o])), pa.array(np.concatenate([n, n]), pa.int8()), pa.array(np.repeat([1, 0], len(o)), pa.int8())],
            names=["key", "member", "new", "forward"],
        )


def _local_joins(batches: Iterator[pa.RecordBatch], degree: int, salt: int, known) -> Iterator[pa.RecordBatch]:
    """Every node compares its neighbours with each other; pairs with a new one that beat the farther's reach go out.

    `known`: (ids, vectors, reach) of all nodes, or None where the rows carry v and reach themselves.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for t in tx.groups(batches, "key"):
        key, member, new, forward = (t.column(c).to_numpy() for c in ("key", "member", "new", "forward"))
        # neighbours and as many of those that it is a neighbour of
        draw = tx.mix(member.astype(np.int64).view(tx.U) ^ tx.U(salt))
        o = np.lexsort((draw, 1 - forward, key))
        by = np.lexsort((1 - forward, member, key))
        dup = np.zeros(len(o), bool)
        dup[by[1:]] = (key[by[1:]] == key[by[:-1]]) & (member[by[1:]] == member[by[:-1]])
        o = o[~dup[o]]
        first = np.flatnonzero(np.diff(key[o], prepend=key[o][:1] - 1))
        nth = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
        o, nth = o[nth < 2 * degree], nth[nth < 2 * degree]
        row = np.cumsum(nth == 0) - 1
        if known is not None:
            at = np.searchsorted(known[0], member[o])
            vs, reach = known[1][at], known[2][at]
        else:
            vs = np.frombuffer(b"".join(t.column("v").take(pa.array(o)).to_pylist()), np.float32).reshape(len(o), -1)
            reach = t.column("reach").to_numpy()[o]
        m, dims = int(nth.max()) + 1, vs.shape[1]
        for begin in range(0, int(row[-1]) + 1, 256):
            i, j = np.searchsorted(row, [begin, begin + 256])
            r, c, rows = row[i:j] - begin, nth[i:j], int(row[j - 1]) - begin + 1
            x = np.zeros((rows, m, dims), np.float32)
            ids, fresh, far = np.full((rows, m), -1, np.int64), np.zeros((rows, m), bool), np.full((rows, m), -np.inf, np.float32)
            x[r, c], ids[r, c], fresh[r, c], far[r, c] = vs[i:j], member[o[i:j]], new[o[i:j]] > 0, reach[i:j]
            d = _distances(x, x)
            ok = (d < far[:, :, None]) & (fresh[:, :, None] | fresh[:, None, :]) & (ids[:, None, :] >= -(1 << 62)) & (ids[:, :, None] != ids[:, None, :])
            valid = np.zeros((rows, m), bool)
            valid[r, c] = True
            ok &= valid[:, None, :] & valid[:, :, None]
            a, p, q = np.nonzero(ok)
            found.append((ids[a, p], ids[a, q], d[a, p, q]))
            if sum(len(f[0]) for f in found) > 4_000_000:
                found = [_nearest(found, degree)]
                if len(found[0][0]) > 2_000_000:
                    yield _packed(*found[0], np.ones(len(found[0][0]), np.uint8))
                    found = []
    if found and sum(len(f[0]) for f in found):
        best = _nearest(found, degree)
        yield _packed(*best, np.ones(len(best[0]), np.uint8))


def _nearest(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    owner, ids, ds = (np.concatenate([f[i] for f in found]) for i in range(3))
    return best_of(owner, ids, ds, np.ones(len(owner), np.uint8), k)[:3]


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for t in tx.groups(batches, "id"):
        yield _packed(*best_of(*_flat(t), k))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A graph's edges in both directions, a row each batch and node."""
    for b in batches:
        o, i, d, n = _flat(b)
        if len(o):
            yield _packed(*best_of(np.concatenate([o, i]), np.concatenate([i, o]), np.concatenate([d, d]), np.concatenate([n, n]), 1 << 30))


def _merged(parts: DataFrame, k: int) -> DataFrame:
    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(lambda it: _merge(it, k), _GRAPH)


def _points(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column(1)
        x = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dims)
        ok = np.isfinite(x).all(1)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"]).filter(pa.array(ok))


def points(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(table id, v of the usable rows; dimensions): the most frequent length counts; null ids, null, non-finite and
    otherwise long vectors are left out, and of rows that repeat an id the least vector is taken."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("v")).filter("id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = common["n"] if common else 1
    one = rows.filter(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))
    return written(one.mapInArrow(lambda it: _points(it, dims), "id bigint, v binary"), "points"), dims


def build_graph(pts: DataFrame, dims: int, degree: int = DEGREE, rounds: int = ROUNDS, limit: int = BROADCAST_BYTES, seed: int = 1) -> DataFrame:
    """Table id, nb (ids), ds (squared distances), nw by NN-descent.

    The first graph compares rows that lie together in the order of a few random plane trees. In each round every edge
    goes to both its ends, each node compares all its neighbours with each other, and what improves a node's list is
    merged into it. Vectors are looked up in a broadcast of at most `limit` bytes; beyond, they come to the edges by a
    join.
    """
    spark = pts.sparkSession
    n = pts.count()
    if not n:
        return spark.createDataFrame([], _GRAPH)
    r = np.random.default_rng(seed)
    mean = pts.mapInArrow(_sums, "s binary").toPandas()["s"]
    centre = (np.sum([np.frombuffer(s, np.float64) for s in mean], 0) / n).astype(np.float32)
    bits = int(np.clip(np.ceil(np.log2(max(n / LEAF, 2))), 1, 40))
    graph = None
    for _ in range(TREES):
        planes = r.normal(size=(dims, bits + 1)).astype(np.float32)
        coded = pts.mapInArrow(lambda it, p=planes: _codes(it, p, centre), "id bigint, v binary, code bigint, along double")
        leaf = coded.repartitionByRange("code", "along", "id").sortWithinPartitions("code", "along", "id").select("id", "v").mapInArrow(lambda it: _leaves(it, degree), _GRAPH)
        graph = leaf if graph is None else graph.unionAll(leaf)
    graph = written(_merged(graph, degree), "graph")
    every = None
    if n * (4 * dims + 12) <= limit:
        got = pts.toPandas().sort_values("id")
        every = got["id"].to_numpy(np.int64), np.frombuffer(b"".join(got["v"]), np.float32).reshape(n, dims)
    for turn in range(rounds):
        reach = graph.mapInArrow(lambda it: _reach(it, degree), "id bigint, reach float, new int")
        edges = graph.mapInArrow(_edges, "key bigint, member bigint, new tinyint, forward tinyint")
        if every is not None:
            far = reach.toPandas()
            value = np.full(n, np.inf, np.float32)
            value[np.searchsorted(every[0], far["id"].to_numpy(np.int64))] = far["reach"].to_numpy(np.float32)
            known = spark.sparkContext.broadcast((*every, value))
            ready, look = edges, lambda b=known: b.value
        else:
            ready, look = edges.join(pts.join(reach.select("id", "reach"), "id", "left").select(F.col("id").alias("member"), "v", F.coalesce("reach", F.lit(float("inf"))).cast("float").alias("reach")), "member"), lambda: None
        better = ready.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it, f=look, s=turn * 7919 + seed: _local_joins(it, degree, s, f()), _GRAPH)
        old = graph.mapInArrow(_aged, _GRAPH)
        graph = written(_merged(old.unionAll(better), degree), "graph")
        changed = graph.mapInArrow(lambda it: _reach(it, degree), "id bigint, reach float, new int").agg(F.sum("new")).first()[0] or 0
        if changed < CHANGED * n * degree:
            break
    return graph


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, -1).sum(0, dtype=np.float64)
            total = s if total is None else total + s
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])


def _reach(batches: Iterator[pa.RecordBatch], degree: int) -> Iterator[pa.RecordBatch]:
    """The distance that a neighbour must beat, and the number of new ones."""
    for b in batches:
        ds = [np.frombuffer(x, np.float32) for x in b.column(2).to_pylist()]
        far = np.array([d[-1] if len(d) >= degree else np.inf for d in ds], np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(far), pa.array([sum(x) for x in b.column(3).to_pylist()], pa.int32())], names=["id", "reach", "new"])


def _aged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array([bytes(len(x)) for x in b.column(3).to_pylist()], pa.binary())], names=b.schema.names)


def beam_search(q: np.ndarray, x: np.ndarray, nb: np.ndarray, entries: np.ndarray, own: np.ndarray, beam: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, squared distances) that greedy search keeps for each query; nb: neighbours of each row, -1 for none;
    own: different rows of x that each query begins from besides the entries, -1 for none.

    Each turn a query expands the nearest nodes in view that it has not expanded and keeps the nearest of all it has
    seen; it ends when all in view are expanded.
    """
    n, total = len(q), len(x)
    xx = (x * x).sum(1)
    qq = (q * q).sum(1)
    seen = np.zeros((n, total), bool)
    seen[:, entries] = True
    r, c = np.nonzero((own >= 0) & ~seen[np.arange(n)[:, None], own])
    seen[r, own[r, c]] = True
    d = np.full((n, len(entries) + own.shape[1]), np.inf, np.float32)
    d[:, : len(entries)] = _distances(q, x[entries])
    d[r, len(entries) + c] = np.maximum(qq[r] + xx[own[r, c]] - 2 * np.einsum("ij,ij->i", q[r], x[own[r, c]]), 0)
    begin = np.concatenate([np.broadcast_to(entries, (n, len(entries))), own], 1)
    m = min(beam, begin.shape[1])
    at = np.argpartition(d, m - 1, 1)[:, :m]
    ids, ds = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, np.float32)
    ids[:, :m], ds[:, :m] = np.take_along_axis(begin, at, 1), np.take_along_axis(d, at, 1)
    done = ~np.isfinite(ds)
    live = np.arange(n)
    while len(live):
        open_ = np.where(done[live], np.inf, ds[live])
        p = min(expand, beam)
        pick = np.argpartition(open_, p - 1, 1)[:, :p]
        ok = np.isfinite(np.take_along_axis(open_, pick, 1))
        some = ok.any(1)
        live, pick, ok = live[some], pick[some], ok[some]
        if not len(live):
            break
        r, c = np.nonzero(ok)
        done[live[r], pick[r, c]] = True
        far = nb[ids[live[r], pick[r, c]]]
        code = np.unique((live[r][:, None] * total + far)[far >= 0])
        row, node = np.divmod(code, total)
        fresh = ~seen[row, node]
        row, node = row[fresh], node[fresh]
        seen[row, node] = True
        dist = np.maximum(qq[row] + xx[node] - 2 * np.einsum("ij,ij->i", q[row], x[node]), 0).astype(np.float32)
        good = dist < ds.max(1)[row]
        row, node, dist = row[good], node[good], dist[good]
        if not len(row):
            continue
        first = np.flatnonzero(np.diff(row, prepend=-1))
        per = np.diff(np.append(first, len(row)))
        nth, who = np.arange(len(row)) - np.repeat(first, per), row[first]
        k = np.repeat(np.arange(len(who)), per)
        more = int(per.max())
        i2, d2 = np.full((len(who), beam + more), -1, np.int64), np.full((len(who), beam + more), np.inf, np.float32)
        f2 = np.ones((len(who), beam + more), bool)
        i2[:, :beam], d2[:, :beam], f2[:, :beam] = ids[who], ds[who], done[who]
        i2[k, beam + nth], d2[k, beam + nth], f2[k, beam + nth] = node, dist, False
        keep = np.argpartition(d2, beam - 1, 1)[:, :beam]
        ids[who], ds[who], done[who] = (np.take_along_axis(y, keep, 1) for y in (i2, d2, f2))
    return ids, ds


def _answers(me: np.ndarray, ids: np.ndarray, ds: np.ndarray, top: int) -> pa.RecordBatch:
    """Flat rows of the nearest others of each query; ids below their row's are padding where ds is infinite."""
    owner, flat, d = np.repeat(np.arange(len(me)), ids.shape[1]), ids.ravel(), ds.ravel()
    ok = np.isfinite(d) & (flat != np.repeat(me, ids.shape[1]))
    owner, flat, d, _ = best_of(owner[ok], flat[ok], d[ok], np.zeros(int(ok.sum()), np.uint8), top)
    first = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1))
    nth = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    return pa.RecordBatch.from_arrays([pa.array(me[owner], pa.int64()), pa.array(nth + 1, pa.int32()), pa.array(flat, pa.int64()), pa.array(np.sqrt(d.astype(np.float64)))], names=["vec_id", "rank", "neighbour_id", "distance"])


def _own(b: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
    """The rows of ids that the queries of a batch (id, v, begin, far) begin from, -1 for none."""
    own = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
    out = np.full((len(own), max(map(len, own), default=0)), -1, np.int64)
    for i, x in enumerate(own):
        out[i, : len(x)] = np.searchsorted(ids, x)
    return out


def _search_here(batches: Iterator[pa.RecordBatch], known, beam: int, top: int) -> Iterator[pa.RecordBatch]:
    ids, x, nb, entries = known
    for b in batches:
        step = max(16, min(512, (64 << 20) // len(ids)))
        for i in range(0, b.num_rows, step):
            p = b.slice(i, step)
            q = np.frombuffer(b"".join(p.column(1).to_pylist()), np.float32).reshape(p.num_rows, -1)
            at, d = beam_search(q, x, nb, entries, _own(p, ids), beam)
            yield _answers(p.column(0).to_numpy(zero_copy_only=False), np.where(at >= 0, ids[at], -1), d, top)


_ANSWER = "vec_id bigint, rank int, neighbour_id bigint, distance double"
_STATE = "id bigint, v binary, nb binary, ds binary, nw binary"


_BEGUN = "id bigint, v binary, begin binary, far binary"


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries that are nodes begin from themselves, and so from their lists."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([bytes(4)] * len(ids), pa.binary())], names=["id", "v", "begin", "far"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        begin, far = ([np.asarray(x or [], t).tobytes() for x in b.column(k).to_pylist()] for k, t in ((2, np.int64), (3, np.float32)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(begin, pa.binary()), pa.array(far, pa.binary())], names=["id", "v", "begin", "far"])


def _begun(queries: DataFrame, pts: DataFrame, n: int, dims: int, beam: int, limit: int, nodes: bool) -> DataFrame:
    """The queries with the nodes that each begins from, and their squared distances.

    A query that is a node begins from itself. Any other begins from what the same search finds among one in THIN nodes;
    that goes on until ENTRIES are as large a share, so that every region of one in THIN rows can be reached.
    """
    if nodes:
        return queries.select("id", "v").mapInArrow(_at_home, _BEGUN)
    here = queries.select("id", "v").join(pts.select("id", "v"), ["id", "v"], "left_semi").mapInArrow(_at_home, _BEGUN)
    foreign = queries.select("id", "v").join(pts.select("id", "v"), ["id", "v"], "left_anti")
    found = pts.sparkSession.createDataFrame([], _ANSWER)
    if n > THIN * ENTRIES and not foreign.isEmpty():
        some = written(pts.filter(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(THIN)) == 0), "points")
        found = search(foreign, some, build_graph(some, dims, limit=limit), dims, DEGREE, beam, limit)
    near = found.groupBy(F.col("vec_id").alias("id")).agg(F.collect_list(F.struct("neighbour_id", "distance")).alias("near"))
    listed = foreign.join(near, "id", "left").select("id", "v", F.col("near.neighbour_id").alias("begin"), F.expr("transform(near.distance, x -> x * x)").alias("far"))
    return here.unionAll(listed.mapInArrow(_gathered, _BEGUN))


def _start(batches: Iterator[pa.RecordBatch], entries, beam: int) -> Iterator[pa.RecordBatch]:
    ids, x = entries
    for b in batches:
        q = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, -1)
        d = _distances(q, x)
        m = min(beam, len(ids))
        at = np.argsort(d, 1)[:, :m]
        ds = np.take_along_axis(d, at, 1)
        begin, far = (b.column(k).to_pylist() for k in (2, 3))
        cut = lambda y, own, t: pa.array([z.astype(t).tobytes() + o for z, o in zip(y, own)], pa.binary())
        new = [b"\1" * (len(o) // 8) for o in begin]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cut(ids[at], begin, np.int64), cut(ds, far, np.float32), cut(np.ones(at.shape), new, np.uint8)], names=["id", "v", "nb", "ds", "nw"])


def _open(batches: Iterator[pa.RecordBatch], expand: int) -> Iterator[pa.RecordBatch]:
    """(node, id, v) of the nodes that each query expands next."""
    for b in batches:
        node, row = [], []
        for i, (nb, ds, nw) in enumerate(zip(*[b.column(k).to_pylist() for k in (2, 3, 4)])):
            at = np.flatnonzero(np.frombuffer(nw, np.uint8))
            at = at[np.argsort(np.frombuffer(ds, np.float32)[at], kind="stable")[:expand]]
            node.append(np.frombuffer(nb, np.int64)[at])
            row.append(np.full(len(at), i))
        row = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node) if node else np.zeros(0, np.int64)), b.column(0).take(row), b.column(1).take(row)], names=["node", "id", "v"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, v, node, nbs, xs): the neighbours with their distances, and the node itself as expanded."""
    for b in batches:
        out = []
        for q, node, nbs, xs in zip(*[b.column(k).to_pylist() for k in (1, 2, 3, 4)]):
            v, x = np.frombuffer(q, np.float32), np.frombuffer(xs, np.float32)
            d = _distances(v[None], x.reshape(-1, len(v)))[0]
            ids = np.frombuffer(nbs, np.int64)
            out.append((np.append(ids, node), np.append(d, 0), np.append(np.ones(len(ids)), 0)))
        cut = lambda k, t: pa.array([y[k].astype(t).tobytes() for y in out], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(len(out), pa.binary()), cut(0, np.int64), cut(1, np.float32), cut(2, np.uint8)], names=["id", "v", "nb", "ds", "nw"])


def _keep(batches: Iterator[pa.RecordBatch], beam: int) -> Iterator[pa.RecordBatch]:
    """Put what each query has met together: the nearest stay, and expanded ones stay expanded."""
    for t in tx.groups(batches, "id"):
        key = t.column("id").to_numpy()
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        v, rows = t.column("v").to_pylist(), []
        nb, ds, nw = (t.column(c).to_pylist() for c in ("nb", "ds", "nw"))
        for i, j in zip(first, [*first[1:], len(key)]):
            ids, new = np.frombuffer(b"".join(nb[i:j]), np.int64), np.frombuffer(b"".join(nw[i:j]), np.uint8)
            d = np.frombuffer(b"".join(ds[i:j]), np.float32)
            # a node's own mark has no distance; the copy in view has it
            o = np.lexsort((-d, new, ids))
            ids, d, new = ids[o], d[o], new[o]
            start = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            ids, d, new = ids[start], np.maximum.reduceat(d, start), np.minimum.reduceat(new, start)
            k = np.argsort(d, kind="stable")[:beam]
            rows.append((int(key[i]), next(y for y in v[i:j] if y is not None), ids[k].tobytes(), d[k].tobytes(), new[k].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], names=["id", "v", "nb", "ds", "nw"])


def _adjacency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in tx.groups(batches, "key"):
        key = t.column("key").to_numpy()
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        member, v = t.column("member").to_numpy(), t.column("v").to_pylist()
        ends = [*first[1:], len(key)]
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array([member[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()), pa.array([b"".join(v[i:j]) for i, j in zip(first, ends)], pa.binary())], names=["node", "nbs", "xs"])


def _final(batches: Iterator[pa.RecordBatch], beam: int, top: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, ds = np.full((b.num_rows, beam), -1, np.int64), np.full((b.num_rows, beam), np.inf, np.float32)
        for i, (nb, d) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            ids[i, : len(nb) // 8], ds[i, : len(d) // 4] = np.frombuffer(nb, np.int64), np.frombuffer(d, np.float32)
        if b.num_rows:
            yield _answers(b.column(0).to_numpy(zero_copy_only=False), ids, ds, top)


def search(queries: DataFrame, pts: DataFrame, graph: DataFrame, dims: int, top: int = TOP, beam: int = BEAM, limit: int = BROADCAST_BYTES, nodes: bool = False) -> DataFrame:
    """vec_id, rank, neighbour_id, distance of the `top` nearest others of each query (id, v) by greedy graph search;
    `nodes`: all queries are rows of `pts`.

    Every query begins from ENTRIES nodes and from its own (see _begun). Edges are walked both ways. Where graph and
    vectors together have at most `limit` bytes every executor searches batches of queries by itself; beyond, all
    queries take their steps together: the nodes that they expand are joined with the adjacency lists, and each turn is
    written.
    """
    spark, degree = pts.sparkSession, DEGREE
    n = pts.count()
    if not n:
        return spark.createDataFrame([], _ANSWER)
    begun = _begun(queries, pts, n, dims, beam, limit, nodes)
    both = written(_merged(graph.mapInArrow(_backward, _GRAPH), 2 * degree), "graph")
    entries = pts.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).toPandas()
    first = entries["id"].to_numpy(np.int64), np.frombuffer(b"".join(entries["v"]), np.float32).reshape(-1, dims)
    if n * (4 * dims + 8 * degree + 8) <= limit:
        got = pts.toPandas().sort_values("id")
        ids = got["id"].to_numpy(np.int64)
        x = np.frombuffer(b"".join(got["v"]), np.float32).reshape(n, dims)
        nb = np.full((n, 2 * degree), -1, np.int32)
        for r in both.select("id", "nb").toLocalIterator():
            near = np.searchsorted(ids, np.frombuffer(r["nb"], np.int64))
            nb[np.searchsorted(ids, r["id"]), : len(near)] = near
        sent = spark.sparkContext.broadcast((ids, x, nb, np.searchsorted(ids, first[0])))
        return begun.repartition("id").mapInArrow(lambda it: _search_here(it, sent.value, beam, top), _ANSWER)
    one_way = both.mapInArrow(_edges, "key bigint, member bigint, new tinyint, forward tinyint").filter("forward = 1")
    lists = one_way.join(pts.select(F.col("id").alias("member"), "v"), "member").repartition("key").sortWithinPartitions("key")
    adjacent = written(lists.select("key", "member", "v").mapInArrow(_adjacency, "node bigint, nbs binary, xs binary"), "adjacency")
    sent = spark.sparkContext.broadcast(first)
    state = written(begun.mapInArrow(lambda it: _start(it, sent.value, beam), _STATE), "search")
    while True:
        step = state.mapInArrow(lambda it: _open(it, EXPAND), "node bigint, id bigint, v binary")
        if step.isEmpty():
            break
        met = step.join(adjacent, "node", "left").select("id", "v", "node", F.coalesce("nbs", F.lit(b"")).alias("nbs"), F.coalesce("xs", F.lit(b"")).alias("xs")).mapInArrow(_expand, _STATE)
        state = written(state.unionAll(met).repartition("id").sortWithinPartitions("id").mapInArrow(lambda it: _keep(it, beam), _STATE), "search")
    return state.mapInArrow(lambda it: _final(it, beam, top), _ANSWER)


def nearest_neighbours(vectors: DataFrame, top: int = TOP, degree: int = DEGREE, beam: int = BEAM, limit: int = BROADCAST_BYTES, every: int = 1) -> DataFrame:
    """vec_id, rank (from 1), neighbour_id, distance (Euclidean): about the `top` nearest others of every row, or of
    those whose id is divisible by `every`, among all rows.

    Every usable row is a node, and a query if its id is divisible by `every`: null ids, and vectors that are null, empty, not finite or of another length
    than most, are left out and have no rows; rows that repeat a vec_id are one node, with the least of their vectors;
    ties go to the smaller id; other columns are ignored; an empty table gives an empty table, as does a single row.
    """
    pts, dims = points(vectors)
    asked = pts if every == 1 else pts.filter(F.col("id") % every == 0)
    return search(asked, pts, build_graph(pts, dims, degree, limit=limit), dims, top, beam, limit, nodes=True)
