import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave.__main__ import main
from lexiweave.operators import fourier, models
from lexiweave.operators import lexicon as lx
from lexiweave.operators import weighting as wt
from lexiweave.operators.ml import TextLearner, TextModel
from lexiweave.operators.parameters import Parameters
from lexiweave.sources import corpus as src
from lexiweave.sources import rawsource
from lexiweave.streaming.scoring import stream_vectors

WORDS = {"sea": "boat wave salt fish harbour sail tide".split(), "hill": "stone peak snow goat path ridge pine".split(), "town": "street shop tram square clock market bridge".split()}


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    rows = [(i, y, [r.choice(WORDS[y]) for _ in range(6)] + [r.choice(["the", "a", "of"]) for _ in range(3)]) for i, y in enumerate(sorted(WORDS) * 12)]
    return spark.createDataFrame(rows, "doc_id long, label string, tokens array<string>")


def right(classifier, docs):
    got = classifier.scores(docs).join(docs.select("doc_id", "label"), "doc_id").collect()
    return sum(r["predicted"] == r["label"] for r in got) / len(got)


@pytest.mark.parametrize("settings", [("linear", "-s 0 -c 8"), ("linear", "-s 3 -B 1 -w1 2"), ("kernel", "-t 0 -b 1"), ("kernel", "-g 2 -c 4")])
def test_save_and_load(spark, texts, tmp_path, settings):
    library, options = settings
    c = models.Learner.of(options, library, scheme="frequency", dims=128, iterations=10).fit(texts, str(tmp_path / "vector"))
    assert right(c, texts) > 0.9
    c.save(str(tmp_path / "m"))
    back = models.Classifier.load(spark, str(tmp_path / "m"))
    one, two = ({r["doc_id"]: r["scores"] for r in x.decisions(texts).collect()} for x in (c, back))
    assert all(np.allclose(one[k], two[k]) for k in one) and back.labels == c.labels
    long = back.classify(texts).groupBy("doc_id").agg(F.sum("score").alias("s"), F.min("score").alias("least")).collect()
    if back.sigmoids:
        assert all(math.isclose(r["s"], 1, abs_tol=1e-9) and r["least"] >= 0 for r in long)
    assert not back.needs_refreshing()
    c.save(str(tmp_path / "m"))
    assert back.needs_refreshing()


def test_load_of_what_is_no_model(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        models.Classifier.load(spark, str(tmp_path))


def test_zipped_model_and_commands(spark, texts, tmp_path, capsys):
    import shutil

    c = models.Learner("svc", "boolean", iterations=10).fit(texts)
    c.save(str(tmp_path / "m" / "model-1"))
    shutil.make_archive(str(tmp_path / "packed"), "zip", tmp_path / "m")
    back = models.Classifier.load(spark, str(tmp_path / "packed.zip"))
    assert right(back, texts) > 0.9
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Boat and wave, salt!\nfish")
    (tmp_path / "in" / "b.txt").write_text("snow on the ridge")
    (tmp_path / "in" / "c.dat").write_text("not read")
    main(["classifyTextFile", str(tmp_path / "m" / "model-1"), str(tmp_path / "in")], spark)
    out = [x for x in capsys.readouterr().out.splitlines() if "classified as" in x]
    assert [(x.split(" classified")[0][-5:], x.split(" : ")[1]) for x in out] == [("a.txt", "sea"), ("b.txt", "hill")]
    main(["getAttributeScores", str(tmp_path / "m" / "model-1"), "2"], spark)
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines() if "\t" in x]
    assert len(lines) == 6 and all(x[0] in WORDS[x[1]] for x in lines)
    hot = {(r["label"], r["score"]) for r in back.one_hot(texts.limit(5)).collect()}
    assert {x for _, x in hot} == {0.0, 1.0}


def test_weights_of_two_labels(spark, texts):
    two = texts.filter("label <> 'town'")
    w = models.Learner("logreg", "boolean").fit(two).attribute_weights()
    by = {(r["token"], r["label"]): r["score"] for r in w.collect()}
    assert by["boat", "sea"] > 0 > by["boat", "hill"] and all(x == 0 or abs(x) >= 0.001 for x in by.values())


def test_parameters():
    assert Parameters.parse("") == Parameters("rbf")
    assert Parameters.parse("-t 0 -c 0.5 -e 0.001 -w1 2.5 -v 3 -m 100 -h 0") == Parameters("svc", 0.5, folds=3, eps=0.001, weights={1: 2.5})
    assert Parameters.parse("-s 7 -B 1 -q", "linear") == Parameters("logreg", bias=1.0, probability=True)
    for bad, library in (("-s 1", "kernel"), ("-t 1", "kernel"), ("-s 4", "linear"), ("-c", "linear"), ("-z 1", "linear"), ("-c x", "kernel"), ("-v 1", "kernel"), ("-c 0", "kernel")):
        with pytest.raises(ValueError):
            Parameters.parse(bad, library)


def test_random_features_are_near_the_kernel():
    r = np.random.default_rng(0)
    x = r.normal(size=(20, 8)) * 0.5
    ids, begin = np.tile(np.arange(1, 9), 20), np.arange(21) * 8
    z = fourier.mapped(x.ravel(), ids, begin, 4096, 0.7, 7)
    want = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.08
    assert np.allclose(fourier.mapped(np.zeros(0), np.zeros(0, int), np.array([0, 0]), 16, 1.0, 7), fourier.mapped(np.zeros(2), np.array([1, 2]), np.array([0, 2]), 16, 1.0, 7))


def test_misclassified_terms(spark, texts):
    lexicon = lx.Lexicon.fit(texts, "occurrences")
    wrong = models.misclassified(texts.select("doc_id", F.col("label").alias("expected"), F.lit("sea").alias("predicted")), texts, lexicon).collect()
    assert len(wrong) == 24 and all(r["terms"] and r["terms"][0]["value"] == max(t["value"] for t in r["terms"]) for r in wrong)


def test_estimator_and_model(spark, texts, tmp_path):
    from pyspark.ml import Pipeline

    d = texts.withColumnsRenamed({"doc_id": "k", "tokens": "words", "label": "y"})
    m = Pipeline(stages=[TextLearner(idCol="k", tokensCol="words", labelCol="y", kind="logreg", scheme="boolean")]).fit(d)
    assert m.transform(d).filter("predicted = y").count() >= 33
    m.stages[0].save(str(tmp_path / "m"))
    again = TextModel.load(spark, str(tmp_path / "m"))
    assert again.transform(texts).filter("predicted = label").count() >= 33


def test_folds_leave_no_copy_behind(spark, texts):
    p = models.cross_validate(texts.unionByName(texts.withColumn("doc_id", F.col("doc_id") + 1000)), models.Learner("logreg", "boolean"), 2).collect()
    assert len(p) == 72
    fold = {r["doc_id"]: r["fold"] for r in p}
    assert all(fold[k] == fold[k + 1000] for k in range(36))


def test_lexicon_file(spark, tmp_path):
    rows = [(1, "Big Sea", [("title", ["a", "b"]), ("body", ["c"])]), (2, "hill", [("body", ["c", "d"])])]
    docs = spark.createDataFrame(rows, "doc_id long, label string, fields array<struct<name:string,tokens:array<string>>>")
    lexicon = lx.Lexicon.fit(docs, "tfidf", classifier="svc").with_field_scheme("title", "boolean")
    src.write_lexicon_text(lexicon, str(tmp_path / "folder"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "folder").glob("part-*")))
    assert whole == "2\ntfidf\nfalse\nsvc\nbig_sea hill \ntitle:BOOLEAN body \nbody_c\t1\t2\nbody_d\t4\t1\ntitle_a\t2\t1\ntitle_b\t3\t1\n"
    (tmp_path / "file").write_text(whole)
    for at in ("folder", "file"):
        back = src.read_lexicon_text(spark, str(tmp_path / at))
        assert (back.doc_num, back.scheme, back.classifier, back.field_schemes) == (2, lexicon.scheme, "svc", lexicon.field_schemes)
        for t in ("terms", "labels", "fields"):
            assert sorted(getattr(back, t).collect()) == sorted(getattr(lexicon, t).collect())


def test_raw_corpus_again_as_vectors(spark, texts, tmp_path):
    lexicon = lx.Lexicon.fit(texts)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    assert src.append_raw(src.simple_lines(texts, lexicon), raw) == 36
    assert src.append_raw(src.simple_lines(texts, lexicon), raw) == 72
    src.write_lexicon_text(lexicon, str(tmp_path / "lexicon"))
    (tmp_path / "p").write_text(f"# how\nclassification_weight_scheme = boolean\nkeepNBestAttributes: 5\ncompact.attribute.nums=true\nvector_location={out}\nnew_lexicon_file={out}-lexicon\n")
    main(["generateVector", raw, str(tmp_path / "lexicon"), str(tmp_path / "p")], spark)
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert len(lines) == 72 and max(int(x.split(":")[0]) for line in lines for x in line.split()[1:]) == src.read_lexicon_text(spark, f"{out}-lexicon").terms.count() >= 5
    back = src.read_svmlight(spark, out, 10)
    assert back.count() == 72
    main(["bestAttributes", raw, str(tmp_path / "lexicon"), str(tmp_path / "best")], spark)
    best = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "best")).collect()]
    assert len(best) == lexicon.terms.count()
    main(["randomSelection", raw, "10"], spark)
    assert spark.read.text(f"{raw}_10").count() == 10 and spark.read.text(f"{raw}_10.test").count() == 62
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("these\nare no documents\n")
    with pytest.raises(ValueError):
        src.append_raw(src.simple_lines(texts, lexicon), str(tmp_path / "other"))


def test_fields_of_raw_files(spark, tmp_path):
    (tmp_path / "raw").write_text("MultiFieldDocument\t1\t3\t2.0\t1.0\t4.0\t1:2:0\t2:1:1\t3:4:2\nSimpleDocument\t0\t3.0\t1:3\nbroken\n")
    main(["filterFields", str(tmp_path / "raw"), str(tmp_path / "some"), "1"], spark)
    main(["filterFields", str(tmp_path / "raw"), str(tmp_path / "literal"), "1", "--literal"], spark)
    read = lambda x: sorted(r["value"] for r in spark.read.text(str(tmp_path / x)).collect())
    assert read("some") == ["MultiFieldDocument\t1\t3\t0.0\t1.0\t0.0\t2:1:1", "SimpleDocument\t0\t3.0\t1:3"]
    assert read("literal")[0] == "MultiFieldDocument\t1\t3\t0.0\t1.0\t4.0\t2:1:1\t3:4:2"
    spark.dataSource.register(rawsource.RawCorpus)
    for size in (7, 1 << 20):
        got = spark.read.format("rawcorpus").option("rangeBytes", size).load(str(tmp_path / "raw"))
        assert sorted(map(tuple, got.select("kind", "label_id", "totals").collect())) == sorted(map(tuple, src.read_raw(spark, str(tmp_path / "raw")).select("kind", "label_id", "totals").collect()))
    (tmp_path / "lexicon").write_text("2\nfrequency\nfalse\n\nx y \nf g h \na\t1\t2\nb\t3\t1\n")
    main(["compactAttributes", str(tmp_path / "raw"), str(tmp_path / "new"), str(tmp_path / "lexicon"), str(tmp_path / "new-lexicon")], spark)
    assert read("new")[0] == "MultiFieldDocument\t1\t3\t2.0\t1.0\t4.0\t1:2:0\t2:4:2"


def test_texts_in_files(spark, tmp_path):
    (tmp_path / "a").write_text("one line\nanother\n")
    (tmp_path / "b").write_text("third\n")
    got = src.read_line_corpus(spark, {"x": str(tmp_path / "a"), "y": str(tmp_path / "b")})
    assert sorted(map(tuple, got.collect())) == [("x", "another"), ("x", "one line"), ("y", "third")]
    main(["stem", str(tmp_path / "a"), str(tmp_path / "stems")], spark)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "stems")).collect()) == ["anoth", "on line"]


def test_tokens_of_letters_whose_lower_case_is_ascii(spark):
    from lexiweave.functions.text import tokenize

    d = spark.createDataFrame([("Kelvin İx ABC",)], "text string").select(tokenize(F.col("text")).alias("t")).first()
    assert d["t"] == ["elvin", "x", "abc"]


def test_scans_of_the_corpus(spark, monkeypatch):
    """No plan that is left to run reads the documents more than three times."""
    from lexiweave.plans import catalogue

    for name in ("weight_tfidf", "vectors_svmlight", "llr_scores", "select_top_n_llr", "best_labels_ratio", "vectors_uci_dense"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert sum("documents.parquet" in x or "lang#" in x for x in plan.splitlines() if "Relation" in x) <= 3, name


def test_stream(spark, texts, tmp_path):
    lexicon = lx.Lexicon.fit(texts, "tfidf")
    flat = texts.select("doc_id", F.array_join("tokens", " ").alias("text"))
    flat.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = stream_vectors(stream, lexicon).writeStream.format("memory").queryName("streamed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["doc_id"], r["attr_id"]): r["value"] for r in spark.table("streamed").collect()}
    want = {(r["doc_id"], r["attr_id"]): r["value"] for r in wt.vectors(texts, lexicon).collect()}
    assert got == want


def test_stream_of_texts_is_classified(spark, texts, tmp_path):
    from lexiweave.streaming.scoring import start_classifying

    models.Learner("svc", "boolean", iterations=10).fit(texts).save(str(tmp_path / "m"))
    texts.select("doc_id", F.array_join("tokens", " ").alias("text")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    start_classifying(stream, str(tmp_path / "m"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out")).join(texts, "doc_id")
    assert got.count() == 36 and got.filter("predicted = label").count() >= 33


def test_workspace(spark, texts, tmp_path):
    with pytest.raises(FileNotFoundError):
        models.Workspace.open(spark, str(tmp_path / "w"))
    w = models.Workspace.open(spark, str(tmp_path / "w"), overwrite=True)
    w.learn(texts, models.Learner("svc", "boolean", iterations=10))
    again = models.Workspace.open(spark, str(tmp_path / "w"))
    assert right(again.classifier(), texts) > 0.9 and again.raw().count() == 36
    assert src.read_svmlight(spark, str(tmp_path / "w" / "vector")).count() == 36
    empty = models.Workspace.open(spark, str(tmp_path / "w"), overwrite=True)
    with pytest.raises(FileNotFoundError):
        empty.classifier()


def test_stem_buffer():
    from lexiweave.functions.stemmer import StemBuffer

    b = StemBuffer()
    for x in ("c", "ares", "ses"):
        b.add(x)
    b.stem()
    assert str(b) == "caress" and len(b) == 6
