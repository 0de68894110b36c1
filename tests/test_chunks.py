import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiweave.functions.text import tokenize
from lexiweave.operators import chunks, evaluate, models, scorers
from lexiweave.operators import lexicon as lx
from lexiweave.operators import weighting as wt
from lexiweave.sources import corpus as src

TEXTS = [(0, "x", "a b a c d"), (1, "y", "b b a c e"), (2, "x", "a b c f"), (3, None, "It's a Café_1"), (4, "x", None), (5, "y", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, label string, text string").select("doc_id", "label", tokenize(F.col("text")).alias("tokens"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_in_arrays_equal_the_expression(spark):
    odd = ["It's a Café_1", None, "", "ab", "cd", " x", "KKLM ÀB\tc\nd", "9_Z--q", "é"]
    want = [r["t"] for r in spark.createDataFrame([(x,) for x in odd], "text string").select(tokenize(F.col("text")).alias("t")).collect()]
    assert chunks.tokenized(pa.array(odd)).to_pylist() == want
    assert chunks.tokenized(pa.array(odd).slice(3, 3)).to_pylist() == want[3:6]
    terms, owner, word, occ, n = chunks.count(pa.array([["b", "a", "b", ""], None, ["a b", "a\t b", None]]))
    assert sorted((o, terms[w].as_py(), k) for o, w, k in zip(owner.tolist(), word.tolist(), occ.tolist())) == [(0, "a", 1), (0, "b", 2), (2, "a_b", 2)]
    assert n.tolist() == [3, 0, 2]


def test_slices_and_packing(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_TOKENS", 4)
    b = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([["a"] * k for k in (3, 3, 9, 0, 1)])], names=["doc_id", "tokens"])
    parts = list(chunks.slices(b, 1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [0, 1, 2, 3, 4] and len(parts) >= 3
    a = chunks.unpack(chunks.pack(x=np.array([-5, 7, 1 << 20], np.int32), y=np.zeros(0, np.int64)))
    assert a["x"].tolist() == [-5, 7, 1 << 20] and len(a["y"]) == 0
    assert chunks._numerals(np.array([1, 9999999, 10000000, 12345678]), False).to_pylist() == ["1.0", "9999999.0", "1.0E7", "1.2345678E7"]


def test_pairs_are_not_shuffled(spark, docs):
    """Lines, cells, scores and decisions: each from the chunks, without an exchange by document or label."""
    lexicon = lx.Lexicon.fit(docs, "tfidf")
    weights = lexicon.terms.select("attr_id", F.array(F.lit(1.0), F.col("attr_id").cast("double")).alias("w"))
    c = models.Classifier(lexicon, ["x", "y"], 99, weights, [0.5, 0.0], "logreg", -1.0)
    cells = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0), (2, "x", 0.5)], "attr_id int, label string, score double")
    for df in (src.simple_lines(docs, lexicon), src.document_lines(docs, lexicon), scorers.summed(docs, lexicon), evaluate.judged(docs, lexicon, cells), c.decisions(docs), wt.vectors(docs, lexicon)):
        assert "hashpartitioning(doc_id" not in plan(df) and "hashpartitioning(label" not in plan(df)
    got = {r["doc_id"]: r["scores"] for r in c.decisions(docs).collect()}
    long = wt.vectors(docs, lexicon).collect()
    for i, *_ in TEXTS:
        own = [(r["attr_id"], r["value"]) for r in long if r["doc_id"] == i]
        assert got[i] == pytest.approx([0.5 + sum(v for _, v in own), sum(a * v for a, v in own)])
    counts = {(r["doc_id"], r["token"]): (r["occ"], r["n_tokens"]) for r in lx.counts_and_totals(docs).collect()}
    ids = {r["token"]: (r["attr_id"], r["df"]) for r in lexicon.terms.collect()}
    assert {(r["doc_id"], r["attr_id"]): r["value"] for r in long} == pytest.approx({(d, ids[t][0]): o / n * math.log(6 / ids[t][1]) for (d, t), (o, n) in counts.items()})
    o = {(r["attr_id"], r["label"]): r["o"] for r in scorers.summed(docs, lexicon).collect()}
    assert o == pytest.approx({(r["attr_id"], r["label"]): r["o"] for r in scorers._summed(wt.vectors(docs, lexicon), docs.select("doc_id", "label")).collect()})
    s = {(r["doc_id"], r["label"]): r["score"] for r in evaluate.judged(docs, lexicon, cells).collect()}
    assert s == {(r["doc_id"], r["label"]): r["score"] for r in evaluate.document_scores(wt.vectors(docs, lexicon), cells).collect()}


def test_lines_of_equal_documents_and_parsing(spark, docs):
    lexicon = lx.Lexicon.fit(docs)
    lines = {r["doc_id"]: r["line"] for r in src.simple_lines(docs, lexicon).collect()}
    assert lines[0] == "SimpleDocument\t0\t5.0\t1:2\t2:1\t3:1\t4:1" and lines[4] == "SimpleDocument\t0\t0.0" and len(lines) == 6
    given = [
        ("SimpleDocument\t1\t5.0\t1:2\t7:1", ([5.0], [(1, 2, None), (7, 1, None)])), ("SimpleDocument\t1\t5.0\t 1 :2", ([5.0], [(1, 2, None)])),
        ("SimpleDocument\t1\t5\t1:12345678901", ([5.0], [(1, 12345678901, None)])), ("SimpleDocument\t1\t5.0\t1:2:3", ([5.0], [(1, 2, 3)])),
        ("MultiFieldDocument\t0\t1\t4.0\t2:3:0", ([4.0], [(2, 3, 0)])), ("SimpleDocument\t1\t5.0\t99999999999:1", None), ("SimpleDocument\t1\t5.0", None), (None, None), ("SimpleDocument\t1\t5.0\t1", None),
    ]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(given)], "doc_id long, line string")
    parsed = src.parse_lines(rows)
    got = {r["doc_id"]: (r["totals"], [tuple(f) for f in r["features"]]) for r in parsed.collect()}
    assert got == {i: y for i, (_, y) in enumerate(given) if y}
    assert "MapInArrow" in plan(parsed)


def test_revectorized_in_chunks(spark):
    rows = spark.createDataFrame([("SimpleDocument\t0\t4.0\t1:2\t2:1\t3:1",), ("SimpleDocument\t1\t2.0\t2:2",), ("MultiFieldDocument\t0\t2\t4.0\t2.0\t2:3:0\t3:1:1\t9:1:1",)], "line string").coalesce(1)
    parsed = src.parse_lines(rows.withColumn("doc_id", F.monotonically_increasing_id()))
    terms = spark.createDataFrame([("a", 1, 1), ("c", 2, 3), ("b", 3, 2)], "token string, attr_id int, df long")
    fields = spark.createDataFrame([("t", 0), ("u", 1)], "field string, field_id int")
    lexicon = lx.Lexicon(terms, None, fields, 3).with_field_scheme("u", "boolean")
    lines, new = src.revectorized(parsed, lexicon, src.Options("frequency", compact=True))
    assert "hashpartitioning(doc_id" not in plan(lines)
    assert sorted(r["line"] for r in lines.collect()) == ["0  1:0.5 2:0.25 3:0.25", "0  2:1.0 3:0.75", "1  3:1.0"]
    assert sorted((r["token"], r["attr_id"]) for r in new.terms.collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_folds_of_texts_are_those_of_tokens(spark, docs):
    texts = spark.createDataFrame(TEXTS, "doc_id long, label string, text string")
    of_texts = models.folds(chunks.of_texts(texts), 5)
    assert {(r["doc_id"], tuple(r["tokens"]), r["label"], r["fold"]) for r in of_texts.collect()} == {(r["doc_id"], tuple(r["tokens"]), r["label"], r["fold"]) for r in models.folds(docs, 5).collect()}
    assert "MapInArrow" in plan(of_texts)
    learner = models.Learner("logreg", top_n=3, iterations=3)
    got = models.cross_validate(chunks.of_texts(texts.filter("doc_id < 3").unionAll(texts.withColumn("doc_id", F.col("doc_id") + 10)).coalesce(1)), learner, 2)
    assert got.count() == 8 and got.filter("predicted is null").count() == 0
