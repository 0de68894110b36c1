import math
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiweave.functions.stemmer import stem
from lexiweave.functions.text import Scheme, tokenize
from lexiweave.operators import corpus, evaluate, models, scorers
from lexiweave.operators import lexicon as lx
from lexiweave.operators import weighting as wt
from lexiweave.sources import corpus as src

FLAT = [(0, "a b a c d"), (1, "b b a c e"), (2, "a b c f")]
MULTI = [
    (1, "large", [("title", "This is a title"), ("abstract", "abstract"), ("content", "This is the content this will have a large value")]),
    (2, "small", [("title", "This is not a title"), ("content", "This is the content this will have a small value")]),
    (3, "small", [("title", "This is not a title"), ("content", "This is the content this will have a small value"), ("title", "some different content")]),
]


def flat(spark, rows=FLAT):
    return spark.createDataFrame([(i, t.split()) for i, t in rows], "doc_id long, tokens array<string>")


def multi(spark, rows=MULTI):
    return spark.createDataFrame([(i, y, [(n, t.split()) for n, t in f]) for i, y, f in rows], "doc_id long, label string, fields array<struct<name:string,tokens:array<string>>>")


def values(df, terms):
    return {(r["doc_id"], r["token"]): r["value"] for r in df.join(terms.select("attr_id", "token"), "attr_id").collect()}


@pytest.mark.parametrize(
    "scheme,expected",
    [
        ("boolean", {(0, "a"): 1, (1, "b"): 1, (2, "f"): 1}),
        ("occurrences", {(0, "a"): 2, (1, "b"): 2, (2, "a"): 1}),
        ("frequency", {(0, "a"): 0.4, (1, "e"): 0.2, (2, "c"): 0.25}),
        ("tfidf", {(0, "a"): 0, (0, "d"): 0.2 * math.log(3), (2, "f"): 0.25 * math.log(3)}),
    ],
)
def test_schemes(spark, scheme, expected):
    lexicon = lx.Lexicon.fit(flat(spark), scheme)
    got = values(wt.vectors(flat(spark), lexicon), lexicon.terms)
    assert len(got) == 12
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_lexicon_order_and_scripts(spark):
    terms = {r["token"]: (r["attr_id"], r["df"]) for r in lx.Lexicon.fit(flat(spark)).terms.collect()}
    assert terms == {"a": (1, 3), "b": (2, 3), "c": (3, 3), "d": (4, 1), "e": (5, 1), "f": (6, 1)}
    other = {r["token"]: r["attr_id"] for r in lx.Lexicon.fit(flat(spark, [(0, "Мастер и Маргарита")])).terms.collect()}
    assert len(other) == 3 and other["Мастер"] == 2


def test_tokens(spark):
    d = spark.createDataFrame([("It's a Café_1",), (None,), ("",)], "text string").select(tokenize(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in d] == [["it", "s", "a", "caf", "_1"], [], []]


def test_fields(spark):
    lexicon = lx.Lexicon.fit(multi(spark), "tfidf").with_field_scheme("title", Scheme.BOOLEAN)
    assert [r["field"] for r in lexicon.fields.orderBy("field_id").collect()] == ["title", "abstract", "content"]
    totals = {(r["doc_id"], r["field"]): r["n_tokens"] for r in lx.field_totals(multi(spark)).collect()}
    assert totals[(3, "title")] == 8
    got = values(wt.vectors(multi(spark), lexicon), lexicon.terms)
    assert got[(3, "title_some")] == 1 and all(v for v in got.values())
    with pytest.raises(ValueError):
        lexicon.with_field_scheme("title", "tfidf")


def test_prune_compact_empty(spark):
    lexicon = lx.Lexicon.fit(flat(spark)).pruned(1, 2).compacted()
    assert sorted((r["token"], r["attr_id"]) for r in lexicon.terms.collect()) == [("d", 1), ("e", 2), ("f", 3)]
    none = lx.Lexicon.fit(flat(spark, []))
    assert none.terms.count() == 0 and wt.vectors(flat(spark), none).count() == 0


def test_scores(spark):
    v = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (0, 3, 1.0), (2, 3, 1.0)], "doc_id long, attr_id int, value double")
    y = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "y")], "doc_id long, label string")
    llr = {r["attr_id"]: r["score"] for r in scorers.log_likelihood(v, y).collect()}
    assert llr[1] == pytest.approx(4 * math.log(2)) and llr[3] == pytest.approx(0, abs=1e-9)
    terms = spark.createDataFrame([("p", 1, 2), ("q", 2, 2), ("r", 3, 2)], "token string, attr_id int, df long")
    assert scorers.select_best(terms, scorers.log_likelihood(v, y), 1, 6).count() == 2  # a tie is kept


def test_lines_round_trip(spark, tmp_path):
    lexicon = lx.Lexicon.fit(flat(spark))
    lines = src.simple_lines(flat(spark), lexicon)
    assert lines.filter("doc_id = 0").first()["line"] == "SimpleDocument\t0\t5.0\t1:2\t2:1\t3:1\t4:1"
    src.write_lines(lines, str(tmp_path / "raw"))
    src.write_lines(src.multifield_lines(multi(spark), lx.Lexicon.fit(multi(spark))), str(tmp_path / "raw"))
    back = src.read_raw(spark, str(tmp_path / "raw"))
    assert back.count() == 6 and back.filter("kind = 'MultiFieldDocument' and size(totals) = 3").count() == 3
    bad = spark.createDataFrame([("SimpleDocument\t0\t3.0",), ("SimpleDocument\tx\t3.0\t1:1",), ("Other\t1\t1.0\t1:1",), ("MultiFieldDocument\t0\t9\t1.0",)], "line string")
    assert src.parse_lines(bad).count() == 0
    src.save_lexicon(lexicon, str(tmp_path / "lexicon"))
    assert src.load_lexicon(spark, str(tmp_path / "lexicon")).terms.count() == 6


def test_decisions(spark):
    labels = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "label string, label_id int")
    scores = spark.createDataFrame([(1, "x", 1.0), (1, "y", 3.0), (1, "z", 3.0), (2, "x", -1.0), (2, "y", -2.0), (2, "z", -3.0)], "doc_id long, label string, score double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {r["doc_id"]: r["predicted"] for r in evaluate.best_label(docs, scores, labels).collect()} == {1: "z", 2: "x", 3: "x"}
    assert sorted((r["doc_id"], r["label"]) for r in evaluate.best_labels(scores, labels, 0.5).collect()) == [(1, "z"), (2, "x"), (2, "y")]


def test_sample(spark):
    d = spark.range(50).withColumnRenamed("id", "doc_id")
    s = corpus.sample(d, 7)
    assert s.count() == 7 and corpus.complement(d, s).count() == 43


def test_model(spark):
    docs = multi(spark).filter("doc_id < 3")
    c = models.Learner("logreg", "frequency").fit(docs)
    assert {r["doc_id"]: r["predicted"] for r in c.scores(multi(spark)).collect()} == {1: "large", 2: "small", 3: "small"}
    with pytest.raises(ValueError):
        models.Learner("logreg").fit(docs.filter("doc_id = 1"))


def test_stems():
    got = [stem(w) for w in "caresses ponies agreed plastered hopping relational formality adoption by".split()]
    assert got == ["caress", "poni", "agre", "plaster", "hop", "relat", "formal", "adopt", "by"]


def test_unpack_refuses_paths_outside(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../x", "")
    with pytest.raises(ValueError):
        src.unpack(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "x")
