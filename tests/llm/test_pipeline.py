"""The stages of the corpus pipeline against brute force, and as a whole."""

import corpus_pipeline
import pytest

from lexiweave.llm import line_dedup, ngram_join, packing, quality, unigram

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Some documents of the tables, with odd rows."""
    to = tmp_path_factory.mktemp("pipeline")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 250")
    odd = [(None, "a row without an id that has some words to say", "en", "s", 46), (10_001, None, "en", "s", None), (10_002, "", "en", "s", 0), (10_003, " \n ", "en", "s", 3), (10_004, "twice the same id", "en", "s", 17), (10_004, "twice the same id", "en", "s", 17)]
    d.unionByName(spark.createDataFrame(odd, SCHEMA)).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{to}/labels.parquet")
    return str(to)


def _lines(text):
    return [(x.strip().lower(), x) for x in text.split("\n")]


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b or min(len(a), len(b)) < line_dedup.MIN_CHARS:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    # 1: a row stays if the model, which test_llm holds against brute force, scores it at its threshold or above
    good = stage["quality"](spark, docs, folder)
    assert good.columns == docs.columns
    verdict = quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    kept = sorted((r["doc_id"] for r in good.collect()), key=str)
    assert kept == sorted((r["doc_id"] for r in verdict if r["keep"]), key=str)
    assert not {10_001, 10_002, 10_003} & set(kept)

    # 2: every line that an earlier one repeats or is one edit from goes
    rows = sorted(((r["doc_id"], r["text"]) for r in good.filter("doc_id is not null").collect()))
    first, seen, want = {}, {}, {}
    order = [(k, n, t) for k, text in dict(rows).items() for n, (t, _) in enumerate(_lines(text)) if t]
    by_length = {}
    for k, n, t in order:
        if t not in first:
            first[t] = (k, n)
            by_length.setdefault(len(t), []).append(t)
    near = {t: any(first[x] < first[t] and _one_edit(x, t) for m in (len(t) - 1, len(t), len(t) + 1) for x in by_length.get(m, ())) for t in first}
    for k, text in rows:
        left = [raw for n, (t, raw) in enumerate(_lines(text)) if not t or (first[t] == (k, n) and not near[t])]
        if len(left) == len(_lines(text)) or any(map(str.strip, left)):
            want.setdefault(k, []).append("\n".join(left))
    lines = stage["line_dedup"](spark, good, folder)
    got = {}
    for r in lines.collect():
        if r["doc_id"] is not None:
            got.setdefault(r["doc_id"], []).append(r["text"])
            assert r["n_chars"] == len(r["text"])
    assert got == want

    # 3: of documents that similar pairs join the one with the least id stays
    sets = {}
    for r in lines.filter("doc_id is not null").collect():
        w = __import__("regex").findall(r"[\p{L}\p{N}]+", r["text"].lower())
        n = ngram_join.N
        sets[r["doc_id"]] = {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    root = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= ngram_join.THRESHOLD * len(sets[a] | sets[b]) - 1e-9]
    for _ in range(20):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    one = stage["near_duplicates"](spark, lines, folder)
    assert {r["doc_id"] for r in one.collect()} == {k for k, x in root.items() if k == x} | ({None} if None in kept else set())

    # 4: all tokens of every document are in windows, none over capacity
    windows = stage["packing"](spark, one, folder).toPandas()
    counts = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(one.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    some = windows[windows.window_id.notna()]
    sums = some.groupby("doc_id").n_tokens.sum()
    rows_of = one.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert all(sums[k] == n * rows_of[k] for k, n in counts.items() if n)
    assert some.groupby("window_id").n_tokens.sum().max() <= packing.CAPACITY


def test_whole_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 100
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
