"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import _text as tx
from lexiweave.llm._spark import table

#: Words of a passage; a document's last passage may be shorter.
PASSAGE_WORDS = 64
#: At most so many labelled documents are fitted on (those with the least hash of their id); scoring has no bound.
MAX_LABELLED = 6000
#: Of the held-out documents of good quality at most this share may be rejected.
GOOD_LOST = 0.002
_SKETCH = 32
_STATS = 15
WIDTH = _STATS + _SKETCH
_SALTS = (0, 0xA5A5A5A5)


def encode_passages(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, document of each passage, passages of each document).

    A passage is a run of PASSAGE_WORDS words between white space. Its features: shares of letters, capitals, digits and
    other signs, word lengths, closing signs, repetition within the passage, and a signed sketch of its words.
    """
    n = len(off) - 1
    kind = tx.classes(cp)
    s, e = tx.runs(kind != tx.SPACE, off)
    at = np.searchsorted(s, off)
    per = np.diff(at)
    n_pass = -(-per // PASSAGE_WORDS)
    doc = np.repeat(np.arange(n), n_pass)
    if not len(doc):
        return np.zeros((0, WIDTH), np.float32), doc, n_pass
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)
    first = at[doc] + nth * PASSAGE_WORDS
    length = np.minimum(PASSAGE_WORDS, at[doc + 1] - first)
    low = tx.lowered(cp)
    h = tx.Spans(low).hash(s, e)
    width = (e - s).astype(np.float64)

    def within(x: np.ndarray) -> np.ndarray:
        """Sums over each word of a value per character."""
        c = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(x, out=c[1:])
        return (c[e] - c[s]).astype(np.float64)

    total = lambda w: np.add.reduceat(w, first)
    letters, upper, digits = within(kind == tx.LETTER), within((low != cp)), within(kind == tx.NUMBER)
    signs = width - letters - digits
    last = cp[e - 1]
    chars = total(width)
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    passage = np.repeat(np.arange(len(first)), length)
    order = np.lexsort((h, passage))
    fresh = np.ones(len(h))
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    different = np.bincount(passage[order], fresh, len(first))
    size = length.astype(np.float64)
    mean = chars / size
    f = np.empty((len(first), WIDTH), np.float32)
    f[:, 0] = total(letters) / chars
    f[:, 1] = total(upper) / chars
    f[:, 2] = total(digits) / chars
    f[:, 3] = total(signs) / chars
    f[:, 4] = mean / 8
    f[:, 5] = np.sqrt(np.maximum(total(width * width) / size - mean * mean, 0)) / 8
    f[:, 6] = total((last == 46).astype(float)) / size
    f[:, 7] = total((last == 44).astype(float)) / size
    f[:, 8] = total((signs == width).astype(float)) / size
    f[:, 9] = total((signs >= 2).astype(float)) / size
    f[:, 10] = total((width <= 3).astype(float)) / size
    f[:, 11] = different / size
    f[:, 12] = total(again) / size
    f[:, 13] = total(((upper > 0) & (upper >= letters)).astype(float)) / size
    f[:, 14] = np.log(size) / np.log(PASSAGE_WORDS)
    for k, salt in enumerate(_SALTS):
        g = tx.mix(h ^ tx.U(salt))
        bucket, sign = (g % tx.U(_SKETCH)).astype(np.int64), 1.0 - 2.0 * ((g >> tx.U(40)) & tx.U(1)).astype(np.float64)
        sketch = np.bincount(passage * _SKETCH + bucket, sign, len(first) * _SKETCH).reshape(-1, _SKETCH)
        f[:, _STATS:] = sketch if not k else f[:, _STATS:] + sketch
    f[:, _STATS:] /= np.sqrt(len(_SALTS) * size)[:, None]
    return f, doc, n_pass


@dataclass
class AttentionModel:
    """p = sigmoid(c·Σ a_i h_i + d), h_i = tanh(W x_i + w), a = softmax(u·(tanh(V h_i) * sigmoid(G h_i)))."""

    params: dict[str, np.ndarray] = field(default_factory=dict)
    centre: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    threshold: float = 0.5

    @classmethod
    def fresh(cls, hidden: int = 24, gate: int = 12, seed: int = 7) -> AttentionModel:
        r = np.random.default_rng(seed)
        g = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        return cls({"W": g(WIDTH, hidden), "w": np.zeros(hidden), "V": g(hidden, gate), "G": g(hidden, gate), "u": g(gate), "c": g(hidden), "d": np.zeros(1)})

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        """`begin`: the first passage of each document; all have one at least."""
        p = self.params
        n = np.diff(np.append(begin, len(x)))
        x = (x - self.centre) / self.scale
        h = np.tanh(x @ p["W"] + p["w"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        e = (t * s) @ p["u"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), n))
        a = e / np.repeat(np.add.reduceat(e, begin), n)
        z = np.add.reduceat(a[:, None] * h, begin)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -60, 60)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "n": n}

    def gradients(self, f: dict[str, np.ndarray], begin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss."""
        p, n, h, a, t, s = self.params, f["n"], f["h"], f["a"], f["t"], f["s"]
        d = (f["y"] - label) * weight / weight.sum()
        back = np.repeat(d, n)
        rise = h @ p["c"] * back
        de = a * (rise - np.repeat(np.add.reduceat(a * rise, begin), n))
        dt, ds = np.outer(de, p["u"]) * s * (1 - t * t), np.outer(de, p["u"]) * t * s * (1 - s)
        dh = (a * back)[:, None] * p["c"] + dt @ p["V"].T + ds @ p["G"].T
        do = dh * (1 - h * h)
        return {"W": f["x"].T @ do, "w": do.sum(0), "V": h.T @ dt, "G": h.T @ ds, "u": (t * s).T @ de, "c": f["z"].T @ d, "d": np.array([d.sum()])}

    def fit(self, x: np.ndarray, n: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, seed: int = 7) -> AttentionModel:
        """Adam with class weights; `n` passages per document, in order."""
        r = np.random.default_rng(seed)
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-3
        begin = np.cumsum(n) - n
        share = np.array([max((label == k).sum(), 1) for k in (0, 1)])
        weight = len(label) / (2 * share[label.astype(int)])
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.params.items()}
        step = 0
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(n)), max(1, len(n) // batch)):
                at = np.cumsum(n[part]) - n[part]
                xs = x[tx.ragged(begin[part], n[part])]
                g = self.gradients(self.forward(xs, at), at, label[part], weight[part])
                step += 1
                for k, v in self.params.items():
                    m1, m2 = m[k]
                    m1 += 0.1 * (g[k] + 1e-4 * v - m1)
                    m2 += 0.001 * ((g[k] + 1e-4 * v) ** 2 - m2)
                    v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        return self


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            f, _, n = encode_passages(*tx.codepoints(b.column(1)))
            at = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int32()), pa.array([f[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())],
                names=["doc_id", "good", "n", "features"],
            )


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> AttentionModel | None:
    """Fit on at most `max_labelled` labelled documents, a quarter of them held out for the threshold; None if either
    class is missing.

    Of contradictory labels of a document the lower holds; null labels, null ids and documents without words are left
    out. The threshold is 0.5, or lower where more than GOOD_LOST of the held-out good documents would fall below it.
    """
    some = (
        labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", F.col("good").cast("int"))
    got = rows.mapInArrow(_features, "doc_id bigint, good int, n int, features binary").filter("n > 0").toPandas()
    got = got.sort_values(["doc_id", "features"]).drop_duplicates("doc_id").reset_index(drop=True)
    label = (got["good"].to_numpy() > 0).astype(float)
    if len(np.unique(label)) < 2:
        return None
    n = got["n"].to_numpy(np.int64)
    x = np.frombuffer(b"".join(got["features"]), np.float32).reshape(-1, WIDTH)
    # by content, so that copies of a document are not on both sides
    held = np.fromiter((hashlib.blake2b(f, digest_size=8).digest()[0] % 4 == 3 for f in got["features"]), bool, len(n))
    begin = np.cumsum(n) - n
    pick = lambda w: (x[tx.ragged(begin[w], n[w])], n[w])
    model = AttentionModel.fresh().fit(*pick(~held), label[~held])
    hx, hn = pick(held)
    y = model.forward(hx, np.cumsum(hn) - hn)["y"][label[held] > 0] if held.any() else np.zeros(0)
    if len(y):
        model.threshold = float(min(0.5, np.quantile(y, GOOD_LOST, method="lower")))
    return model


def _score(batches: Iterator[pa.RecordBatch], model: AttentionModel | None) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in tx.slices(whole, "text", tx.SLICE):
            x, doc, n = encode_passages(*tx.codepoints(b.column(1)))
            score, weight, top = np.zeros(b.num_rows), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            some = np.flatnonzero(n)
            keep = n > 0
            if len(some) and model is not None:
                begin = (np.cumsum(n) - n)[some]
                f = model.forward(x, begin)
                score[some] = f["y"]
                weight[some] = np.maximum.reduceat(f["a"], begin)
                best = np.flatnonzero(f["a"] == weight[doc])[::-1]
                top[doc[best]] = best - np.cumsum(n)[doc[best]] + n[doc[best]]
                keep[some] = score[some] >= model.threshold
            null = n == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), pa.array(score if model else np.ones(len(score)), mask=null), pa.array(top, mask=null), pa.array(weight, mask=null), pa.array(keep)],
                names=["doc_id", "n_passages", "score", "top_passage", "top_weight", "keep"],
            )


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, n_passages, score, top_passage (the number of the passage with the largest attention, from 0),
    top_weight, keep.

    Every passage of every document is encoded and scored in one scan, without a shuffle; only fitting uses a bounded
    sample of the labelled documents. Documents without words (null, empty, blank) have a null score and are not kept.
    If the labels lack either class there is no model: scores are 1 and documents with words are kept. Repeated rows and
    null doc_ids are rows of their own; columns besides doc_id and text are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _score(it, shared.value), "doc_id bigint, n_passages int, score double, top_passage int, top_weight double, keep boolean"
    )


def _kept(batches: Iterator[pa.RecordBatch], model: AttentionModel | None) -> Iterator[pa.RecordBatch]:
    at = None
    for b in batches:
        at = at or (b.schema.get_field_index("doc_id"), b.schema.get_field_index("text"))
        two = pa.RecordBatch.from_arrays([b.column(at[0]), b.column(at[1])], names=["doc_id", "text"])
        keep = [x.column(5) for x in _score(iter([two]), model)]
        if keep:
            yield b.filter(pa.chunked_array(keep).combine_chunks())


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that classify() keeps, with all their columns, in one scan. Documents without words (null, empty,
    blank) go; rows with a null doc_id are judged like others; repeated rows are judged alike and each stays or goes;
    column names do not matter; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))
    return docs.mapInArrow(lambda it: _kept(it, shared.value), docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
