import base64
import hashlib
import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave.llm import bpe, cells, fingerprints, licenses, line_dedup, neighbours, ngram_join, packing, quality, unigram, url_filter

LONG = "a long line of text that is repeated in places, number "
ROWS = [
    (1, f"{LONG}one\nshort\n{LONG}two", "en"), (2, f"{LONG}one\nother words that stand in only one of these documents", "en"),
    (3, f"{LONG}onn", "en"), (3, f"{LONG}onn", "en"), (4, None, None), (5, "", "fr"), (6, "   \n ", None), (None, f"{LONG}one", "en"),
    (7, "é漢字 mixed 123 'll don't  \t x" * 400, "xx"), (8, "Released under the MIT Licence. All rigths reserved", "en"),
]
SCHEMA = "doc_id long, text string, lang string, key string, h int, block int"  # names that operators use themselves


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA).drop("lang")


OPERATORS = {
    "bpe": bpe.encode, "licenses": licenses.scan_licenses, "fingerprints": fingerprints.fingerprints, "unigram": unigram.token_counts, "packing": lambda d: packing.pack(d).filter("coalesce(start, 0) = 0"),
    "lines": line_dedup.duplicate_lines, "lines_dropped": line_dedup.drop_duplicate_lines, "jaccard": ngram_join.jaccard_pairs, "classes": ngram_join.near_duplicate_classes, "near": ngram_join.drop_near_duplicates,
}
#: doc_ids of the rows that each operator returns for ROWS.
RETURNED = {
    **{k: [1, 2, 3, 3, 4, 5, 6, 7, 8, None] for k in ("bpe", "fingerprints", "unigram", "packing")}, "licenses": [8], "lines": [2, 3], "lines_dropped": [1, 2, 4, 5, 6, 7, 8, None],
    "jaccard": [1], "classes": [1, 2, 3, 4, 5, 6, 7, 8], "near": [1, 2, 4, 5, 6, 7, 8, None],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    column = "doc_a" if name == "jaccard" else "doc_id"
    short = docs(spark).withColumn("doc_id", F.col("doc_id").cast("int"))  # ids of another type
    assert sorted((r[column] for r in OPERATORS[name](short).collect()), key=str) == sorted(RETURNED[name], key=str)
    assert OPERATORS[name](docs(spark, [])).count() == 0


def test_odd_values(spark):
    d = docs(spark)
    ids = {r["doc_id"]: (r["token_ids"], r["n_tokens"]) for r in bpe.encode(d).collect()}
    assert ids[4] == (None, None) and ids[5] == ([], 0)
    tokens = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(d).collect()}
    assert tokens[4] is None and tokens[5] == 0 and tokens[3] > 0
    prints = {r["doc_id"]: r for r in fingerprints.fingerprints(d).collect()}
    assert prints[4]["digest"] is None and prints[5]["n_paragraphs"] == 0 == prints[6]["n_paragraphs"]
    assert prints[5]["fingerprint"] == bytes(2 * fingerprints.LANES) and prints[None]["n_paragraphs"] == 1
    windows = {r["doc_id"]: r["window_id"] for r in packing.pack(d).collect()}
    assert windows[4] is None and windows[5] is None and windows[None] is not None


def test_clashing_names(spark):
    names = ["line_doc", "line_drop", "_line_drop", "gone", "Gone_", "h", "sig", "id", "n"]
    d = docs(spark).select("doc_id", "text", *[F.lit("x").alias(c) for c in names])
    for drop in (line_dedup.drop_duplicate_lines, ngram_join.drop_near_duplicates):
        out = drop(d)
        assert out.columns == d.columns and {r["gone"] for r in out.collect()} == {"x"}


def test_very_long_texts(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    lines = "\n".join(" ".join(r.choice(words) for _ in range(4)) for _ in range(150_000))  # 4 MB
    rows = [(1, lines, "en"), (2, lines, "en"), (3, "abcd" * 100_000 + " all rights reserved", "en"), (4, "all rights reserved\n" * 20_000, "en")]
    d = docs(spark, rows)
    counts = {x["doc_id"]: x["n_tokens"] for x in unigram.token_counts(d).collect()}
    assert counts[1] == counts[2] > 500_000 and counts[3] > 50_000
    prints = {x["doc_id"]: x["digest"] for x in fingerprints.fingerprints(d).collect()}
    assert prints[1] == prints[2] != prints[3]
    found = licenses.scan_licenses(d).groupBy("doc_id").count().collect()
    assert {x["doc_id"]: x["count"] for x in found} == {3: 1, 4: 20_000}
    assert sum(x["n_tokens"] for x in packing.pack(d).filter("doc_id = 1").collect()) == counts[1]
    assert {x["doc_id"]: x["class_id"] for x in ngram_join.near_duplicate_classes(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {x["doc_id"] for x in line_dedup.drop_duplicate_lines(d).select("doc_id").collect()} == {1, 3, 4}
    ids = bpe.encode(d).select("doc_id", "round_trip").collect()
    assert all(x["round_trip"] for x in ids)


def test_bpe_matches_the_public_library(spark):
    import tiktoken

    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(docs(spark).select("doc_id", "text").filter("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10**9))
    # pre-tokens over the widest matrix, with many equal pairs
    text = text.unionByName(spark.createDataFrame([(2 * 10**9, "ab" * 3000 + "a" * 5000 + " " + "=" * 2500)], "doc_id long, text string"))
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    known = text.dropDuplicates(["doc_id"])
    want = {r["doc_id"]: r["text"] and public.encode_ordinary(r["text"]) for r in known.collect()}
    got = bpe.encode(known)
    for r in got.collect():
        assert (r["token_ids"] or []) == (want[r["doc_id"]] or [])
        assert r["round_trip"] in (True, None)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(got).collect()}
    assert back == {r["doc_id"]: r["text"] for r in known.collect()}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6, None, -1]), (4, ids_of("é", ranks)[:1])], "doc_id long, token_ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd).collect()} == {1: None, 2: "", 3: "\ufffd" * 3, 4: "\ufffd"}


def ids_of(text, ranks):
    return [ranks[bytes([b])] for b in text.encode()]


def test_fingerprints_follow_edits():
    a, b = fingerprints.fingerprint(["x", "y", "y"]), fingerprints.fingerprint(["y", "x", "y"])
    assert a == b != fingerprints.fingerprint(["x", "y"])
    assert fingerprints.delete(fingerprints.insert(a, "z"), "z") == a
    assert fingerprints.combine(fingerprints.fingerprint(["x"]), fingerprints.fingerprint(["y", "y"])) == a


def test_fingerprints_against_brute_force(spark):
    def brute(text):
        total = [0] * fingerprints.LANES
        for p in filter(None, map(str.strip, text.split("\n"))):
            digest = hashlib.shake_128(p.encode()).digest(2 * fingerprints.LANES)
            total = [(t + int.from_bytes(digest[2 * i : 2 * i + 2], "little")) % 65536 for i, t in enumerate(total)]
        return b"".join(t.to_bytes(2, "little") for t in total)

    rows = [*[(k, t, y) for k, t, y in ROWS if k != 7], (9, "\n".join(f"p{i % 300}" for i in range(700)), "en")]
    got = fingerprints.fingerprints(docs(spark, rows)).collect()
    want = {k: None if t is None else brute(t) for k, t, _ in rows}
    assert len(got) == len(rows) and all((r["fingerprint"] and bytes(r["fingerprint"])) == want[r["doc_id"]] for r in got)
    edits = [(1, "new", 2), (1, "short", -1), (8, None, 1), (None, "x", 1), (77, "only\nthese", 1), (77, "only", 1), (77, "gone", 0)]
    after = fingerprints.apply_edits(fingerprints.fingerprints(docs(spark, rows[:2])), spark.createDataFrame(edits, "doc_id long, paragraph string, copies int")).collect()
    texts = {1: rows[0][1].replace("\nshort\n", "\n") + "\nnew\nnew", 2: rows[1][1], 77: "these\nonly\nonly"}
    assert {r["doc_id"]: bytes(r["fingerprint"]) for r in after} == {k: brute(t) for k, t in texts.items()}
    assert {r["doc_id"]: r["n_paragraphs"] for r in after} == {1: 4, 2: 2, 77: 3}


def _best_edits(notice, text):
    """The least edits of any substring, by Sellers' recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_licenses_against_brute_force(spark):
    r, rows = random.Random(8), []
    for k in range(80):
        name = r.choice(list(licenses.NOTICES))
        x = licenses.NOTICES[name]
        for _ in range(r.randrange(6)):
            i = r.randrange(len(x))
            x = r.choice([x[:i] + x[i + 1 :], x[:i] + "q" + x[i:], x[:i] + "z" + x[i + 1 :]])
        rows.append((k, f"some words before {x.title() if k % 3 == 0 else x} and after", "en"))
    got = {(x["doc_id"], x["license"]): x["edits"] for x in licenses.scan_licenses(docs(spark, rows)).collect()}
    want = {}
    for k, t, _ in rows:
        for name, v in licenses.NOTICES.items():
            if (e := _best_edits(v, t.lower())) <= licenses.allowed(v):
                want[k, name] = e
    # of notices that overlap one stays: those of fewer edits
    one = {k: min(e for (d, _), e in want.items() if d == k) for k in {d for d, _ in want}}
    assert set(got) <= set(want) and {k for k, _ in got} == set(one) and len(one) > 30
    assert all(want[x] == e for x, e in got.items()) and all(min(e for (d, _), e in got.items() if d == k) == e for k, e in one.items())


def test_licenses(spark):
    got = {(r["doc_id"], r["license"], r["edits"]) for r in licenses.scan_licenses(docs(spark)).collect()}
    assert (8, "mit", 1) in got


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    pool = ["".join(r.choice("abc ") for _ in range(r.randint(18, 60))).strip() for _ in range(25)]

    def edited(x):
        i, how = r.randrange(len(x)), r.randrange(4)
        return [x, x[:i] + x[i + 1 :], x[:i] + "b" + x[i:], x[:i] + "c" + x[i + 1 :]][how]

    rows = [(k, "\n".join(edited(r.choice(pool)) for _ in range(4)), "en") for k in range(60)]
    order = [(k, i, x.strip()) for k, t, _ in rows for i, x in enumerate(t.split("\n")) if len(x.strip()) >= line_dedup.MIN_CHARS]
    want = set()
    for n, (k, i, x) in enumerate(order):
        if first := next((p for p in order[:n] if p[2] == x or _near(p[2], x)), None):
            want.add((k, i, first[0], first[1], int(first[2] != x)))
    got = {tuple(x) for x in line_dedup.duplicate_lines(docs(spark, rows)).collect()}
    assert got == want and len(want) > 50
    # lines of which all that is known at first is one byte
    assert {tuple(x) for x in line_dedup.duplicate_lines(docs(spark, rows), id_bits=0xFF).collect()} == want


def test_short_lines_are_matched_if_equal(spark, tmp_path, monkeypatch):
    rows = [(1, "Les.\n\nAnd ornd.\nLez.", "en"), (2, " les. \n\nonly here\nAnd ornd.", "en"), (3, "Les.", "en")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(x) for x in line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(2, 0, 1, 0, 0), (2, 3, 1, 2, 0), (3, 0, 1, 0, 0)}
    monkeypatch.setattr(line_dedup, "HOT", 3)
    assert {tuple(x) for x in line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()} == got
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_duplicate_lines(docs(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: "\nonly here"}


def test_lines_are_cut_only_from_rows_that_have_them(spark):
    rows = [(1, f"{LONG}one", "en"), (2, f"{LONG}one\nwords of one row", "en"), (2, "this stands nowhere else\nwords of another", "en"), (2, None, "en")]
    kept = [r["text"] for r in line_dedup.drop_duplicate_lines(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([rows[0][1], "words of one row", rows[2][1], None], key=str)


def _classes(sets, threshold):
    """class and links of each document, by comparing all."""
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) and sets[a]}
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    return near, {k: (root[k], sum(k in p for p in near)) for k in sets}


def test_jaccard_against_brute_force(spark, monkeypatch):
    r = random.Random(6)
    base = [[r.choice("kilo mega giga tera peta exa zeta".split()) + str(r.randrange(50)) for _ in range(60)] for _ in range(12)]
    rows = []
    for k in range(70):
        w = list(r.choice(base))
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = "new" + str(r.randrange(99))
        rows.append((k, " ".join(w), "en"))
    rows += [(100 + k, rows[5][1] if k % 2 else rows[7][1], "en") for k in range(20)]
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t, _ in rows for w in [t.split()]}
    near, classes = _classes(sets, ngram_join.THRESHOLD)
    assert len(near) > 50
    # as one tile, then as tiles of chunks of few sets, some rows at a time, with sets spread as hot
    for sets_in_tile, cells, hot in ((8192, 2 << 20, 1 << 30), (4, 7, 5)):
        monkeypatch.setattr(ngram_join, "TILE_SETS", sets_in_tile)
        monkeypatch.setattr(ngram_join, "CELLS", cells)
        got = ngram_join.Join(docs(spark, rows)).classes(hot)
        assert {x["doc_id"]: (x["class_id"], x["links"]) for x in got.collect()} == classes
        first = {}
        for k in sorted(sets):
            first.setdefault(frozenset(sets[k]), k)
        want = {(a, b) for a, b in near if {a, b} <= set(first.values())}
        pairs = [(x["doc_a"], x["doc_b"]) for x in ngram_join.jaccard_pairs(docs(spark, rows)).collect()]
        assert set(pairs) == want and len(pairs) == len(want)


def test_overlaps_of_any_shape():
    r = np.random.default_rng(5)
    a, b = ([np.unique(r.integers(0, top, n)).astype(np.uint64) for n, top in zip(r.integers(1, 60, 40), r.choice([30, 3000], 40))] for _ in range(2))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    for cells in (1, 100, 1 << 20):
        rows = np.zeros((len(a), len(b)))
        for lo, o in ngram_join.overlaps(a, b, cells):
            rows[lo : lo + len(o)] = o
        assert (rows == want).all()


def test_templated_lines_take_little_memory(spark):
    one = ngram_join.gram_sets(*ngram_join.tx.codepoints(ngram_join.pa.array([f"your order number {k} was shipped to the address that you gave us on the day {k % 7} of this week and will arrive soon" for k in range(8000)])))
    g, off = one
    t = ngram_join.pa.RecordBatch.from_pydict({"id": range(8000), "n": [1] * 8000, "grams": [g[i:j].tobytes() for i, j in zip(off[:-1], off[1:])], "chunk": [0] * 8000, "diagonal": [True] * 8000, "tile": [0] * 8000})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = [x for x in ngram_join._linked(iter([t]), 0.6)]
    assert sum(x.num_rows for x in out) == 8000 and {x for b in out for x in b.column(1).to_pylist()} == set(range(7))  # those of one day
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 600


def test_packing_fills_windows(spark):
    sizes = [(k, int(n)) for k, n in enumerate(np.random.default_rng(3).integers(0, 300, 400))] + [(1000, 950), (1001, None)]
    out = packing.pack_lengths(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), 100).toPandas()
    some = out[out.window_id.notna()]
    assert some.groupby("doc_id").n_tokens.sum().to_dict() == {k: n for k, n in sizes if n}
    load = some.groupby("window_id").n_tokens.sum()
    assert load.max() <= 100 and (load == some.groupby("window_id").window_tokens.first()).all()
    assert len(load) <= 1.25 * load.sum() / 100


def test_packing_against_brute_force(spark):
    """Differencing as the textbook has it: whole partitions as lists of parts."""

    def textbook(sizes, k):
        heap = [[(0, [])] * (k - 1) + [(int(s), [i])] for i, s in enumerate(sizes)]
        while len(heap) > 1:
            heap.sort(key=lambda p: p[0][0] - p[-1][0])
            a, b = heap.pop(0), heap.pop(0)
            heap.append(sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))), key=lambda p: p[0]))
        return sorted(s for s, _ in heap[0])

    r = np.random.default_rng(11)
    for k, n in ((2, 6), (3, 9), (4, 30)):
        sizes = r.integers(1, 10_000, n)
        part = packing.differencing(sizes, k)
        assert sorted(np.bincount(part, sizes, k).astype(int).tolist()) == textbook(sizes, k)
    # equal rows do not all lie in one block
    same = spark.createDataFrame([(None, 10)] * 3000 + [(5, 10)] * 3000, "doc_id long, n_tokens long")
    out = packing.pack_lengths(same, 100, 1000).toPandas()
    assert len(out) == 6000 and out.groupby("window_id").n_tokens.sum().max() <= 100 and (out.window_id // 2**32).nunique() > 40


def test_packing_has_several_blocks_a_task(spark):
    sizes = {k: int(n) for k, n in enumerate(np.random.default_rng(5).integers(1, 100, 6400))}
    lengths = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    packed = packing.pack_lengths(lengths, 100, 1000)
    blocks = -(-sum(sizes.values()) // 1000)
    assert blocks > 300
    assert packed.rdd.getNumPartitions() <= -(-blocks // packing.TASK_BLOCKS) + lengths.rdd.getNumPartitions()
    out = packed.toPandas()
    assert dict(zip(out.doc_id, out.n_tokens)) == sizes and len(out) == len(sizes)
    # each block is packed as it would be alone
    for block, x in out.groupby(out.window_id // 2**32):
        x = x.sort_values("doc_id")
        assert (x.window_id % 2**32 == packing.pack_sizes(x.n_tokens.to_numpy(), 100)).all(), block
    assert (out.window_id // 2**32).nunique() == blocks


def test_token_counts_against_brute_force(spark):
    pieces = unigram.Pieces.load(unigram.MODEL)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=unigram.MODEL)
    ranked = unigram.by_rank({m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))})
    worst = min(ranked.values()) - unigram.UNKNOWN_PENALTY

    def brute(word):
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            ways = [(best[i][0] + ranked[word[i:j]], -best[i][1] - 1) for i in range(max(0, j - 20), j) if word[i:j] in ranked]
            if word[j - 1] not in ranked:
                ways.append((best[j - 1][0] + worst, -best[j - 1][1] - len(word[j - 1].encode())))
            s, t = max(ways)
            best.append((s, -t))
        return best[-1]

    assert pieces.longest <= 20
    r = random.Random(9)
    words = ["".join(r.choice("theingaosér漢x.") for _ in range(n)) for n in [*range(1, 40), 63, 64, 65, 66, 200, 700] for _ in range(3)]
    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    n = np.fromiter(map(len, words), np.int64)
    tokens, score = unigram.best_counts(cp, np.cumsum(n) - n, n, pieces)
    want = [brute(w) for w in words]
    assert np.allclose(score, [s for s, _ in want]) and np.mean(tokens == [t for _, t in want]) > 0.98  # but for ties within rounding
    text = "the thing is an old one\nand \n it's  so"
    blanks = "\u2581" + text.replace(" ", "\u2581")
    parts = [p for line in blanks.replace("\n", "\0\n\0").split("\0") for p in __import__("re").findall("\u2581*[^\u2581]+|\u2581+$", line)]
    got = unigram.token_counts(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()["n_tokens"]
    assert got == sum(brute(p)[1] for p in parts)


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    p = table.select("vec_id", "embedding").toPandas()
    x = np.stack(p["embedding"]).astype(np.float32)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    best = {int(v): set(p["vec_id"].to_numpy()[np.argsort(row)[:10]].tolist()) for v, row in zip(p["vec_id"], d)}
    got = neighbours.nearest_neighbours(table).toPandas().groupby("vec_id").neighbour_id.apply(set)
    assert np.mean([len(best[v] & got[v]) / 10 for v in best]) >= 0.9
    odd = spark.createDataFrame([(1, None), (None, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [float("nan"), 1.0]), (4, []), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["neighbour_id"]) for r in neighbours.nearest_neighbours(odd).collect()} == {(2, 5), (5, 2)}
    assert neighbours.nearest_neighbours(odd.filter("false")).count() == 0
    # asked for one row in ten, with everything joined instead of broadcast
    some = neighbours.nearest_neighbours(table.filter("vec_id < 150"), beam=40, every=10, limit=0).toPandas()
    few = p[p.vec_id < 150]
    y = np.stack(few["embedding"]).astype(np.float32)
    ids = few["vec_id"].to_numpy()
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = {int(v): set(ids[np.argsort(row)[:10]].tolist()) for v, row in zip(ids, d) if v % 10 == 0}
    asked = some.groupby("vec_id").neighbour_id.apply(set)
    assert set(asked.index) == set(near) and np.mean([len(near[v] & asked[v]) / 10 for v in near]) >= 0.9


def test_neighbours_recall_on_many_tight_clusters(spark):
    r = np.random.default_rng(4)
    x = (np.repeat(r.normal(size=(200, 16)), 40, 0) + 0.05 * r.normal(size=(8000, 16))).astype(np.float32)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")

    def recall(answers, asked):
        got = answers.toPandas().groupby("vec_id").neighbour_id.apply(set)
        out = []
        for k, v in asked.items():
            d = ((x - v) ** 2).sum(1)
            if k < len(x):
                d[k] = np.inf
            out.append(len(set(np.argpartition(d, 10)[:10].tolist()) & got.get(k, set())) / 10)
        return np.mean(out)

    nodes = {k: x[k] for k in range(0, 8000, 20)}
    assert recall(neighbours.nearest_neighbours(vectors), nodes) >= 0.9
    pts, dims = neighbours.points(vectors)
    graph = neighbours.build_graph(pts, dims)
    foreign = {10_000 + k: x[k] + np.float32(0.01) for k in range(0, 8000, 40)}
    asked = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in {**nodes, **foreign}.items()], "id long, v binary")
    for limit in (64 << 20, 0):
        got = neighbours.search(asked, pts, graph, dims, limit=limit).cache()
        assert recall(got, nodes) >= 0.9 and recall(got, foreign) >= 0.9


def embedded(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")


def test_cells_against_brute_force(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 24)).astype(np.float32) + 100
    x[500:800] = x[500]  # copies: the least ids are nearest
    x[800:1100] = x[800] + 1e-3 * r.normal(size=(300, 24))  # a tight cluster far from the origin
    # three blocks of queries, of which 60 search all cells
    got = cells.cell_neighbours(embedded(spark, x), every=3, measured=60, first=2, limit=48_000).toPandas().sort_values(["vec_id", "rank"])
    near, far = (got.groupby("vec_id")[c].apply(list) for c in ("neighbour_id", "distance"))
    assert set(near.index) == set(range(0, 3000, 3)) and (got.groupby("vec_id").size() == 10).all()
    shares = {k: [] for k in ("copies", "cluster", "others")}
    for k in near.index:
        d = ((x.astype(np.float64) - x[k]) ** 2).sum(1)
        assert np.allclose(far[k], np.sqrt(d[near[k]]), rtol=1e-12, atol=0) and (np.diff(far[k]) >= 0).all()
        d[k] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10].tolist()
        shares["copies" if 500 <= k < 800 else "cluster" if 800 <= k < 1100 else "others"].append(len(set(best) & set(near[k])) / 10)
    assert np.mean(shares["copies"]) == 1 and np.mean(shares["cluster"]) >= 0.99 and np.mean(shares["others"]) >= 0.9
    odd = spark.createDataFrame([(1, None), (None, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [float("nan"), 1.0]), (4, []), (5, [1.0, 2.0]), (6, [1e30, -3e38])], "vec_id long, embedding array<float>")
    assert {(x["vec_id"], x["rank"], x["neighbour_id"]) for x in cells.cell_neighbours(odd).collect()} == {(2, 1, 5), (2, 2, 6), (5, 1, 2), (5, 2, 6), (6, 1, 2), (6, 2, 5)}
    assert cells.cell_neighbours(odd.filter("vec_id = 5")).count() == 0 == cells.cell_neighbours(odd.filter("false")).count()


def test_neighbours_query_shuffles_little(spark, tmp_path):
    import __spark_entry__

    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    x = np.random.default_rng(7).normal(size=(5000, 64)).astype(np.float32)
    embedded(spark, x).write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled()
    assert __spark_entry__.queries()["op3_neighbours"](spark, str(tmp_path)).count() == 500
    assert shuffled() - before <= 4 * x.nbytes


def test_quality_keeps_good_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(d, y).join(y, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() >= 0.98
    assert got[got.quality == 1].score.mean() > got[got.quality == 0].score.mean() + 0.3
    one = quality.classify(docs(spark), y.filter("quality = 1")).toPandas()
    assert len(one) == len(ROWS) and one[one.n_passages == 0].score.isna().all()
    assert quality.classify(docs(spark, []), y).count() == 0


def test_attention_against_brute_force():
    r = np.random.default_rng(3)
    m = quality.AttentionModel.fresh()
    x, n = r.normal(size=(9, quality.WIDTH)), np.array([2, 1, 6])
    begin = np.cumsum(n) - n
    f, p = m.forward(x, begin), m.params
    for k, (i, c) in enumerate(zip(begin, n)):
        hs = [np.tanh(p["W"].T @ v + p["w"]) for v in x[i : i + c] / (1.0 if m.scale is None else m.scale)]
        e = [sum(p["u"] * np.tanh(p["V"].T @ h) / (1 + np.exp(-(p["G"].T @ h)))) for h in hs]
        a = np.exp(e) / np.sum(np.exp(e))
        z = sum(w * h for w, h in zip(a, hs))
        assert np.isclose(f["y"][k], 1 / (1 + np.exp(-(p["c"] @ z + p["d"][0]))))
    label, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    g = m.gradients(f, begin, label, weight)

    def loss():
        y = m.forward(x, begin)["y"]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum() / weight.sum()

    for name, v in p.items():
        for at in [tuple(r.integers(0, s) for s in v.shape) for _ in range(3)]:
            old = v[at]
            v[at] = old + 1e-5
            up = loss()
            v[at] = old - 1e-5
            assert np.isclose((up - loss()) / 2e-5, g[name][at], atol=1e-6)
            v[at] = old


def test_quality_on_labels_that_were_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    y = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality.classify(d, y.filter(fitted)).join(y.filter(~fitted), "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() >= 0.99 and bad.keep.mean() <= 0.03
    assert np.mean(good.score.to_numpy()[:, None] > bad.score.fillna(0).to_numpy()[None, :]) >= 0.97


def test_url_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host/"), F.col("id")).alias("key"))
    listed = keys.filter("key like '%7'")
    cascade, shards = url_filter.build(keys, listed, 500)
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://host/"), F.col("id")).alias("url"), F.lit("x").alias("key"))
    for limit in (1 << 20, 0):
        got = url_filter.flag(pages, cascade, shards, limit)
        assert got.filter("listed <> (key like '%7')").count() == 0 and got.count() == 3000
    none = spark.createDataFrame([(None, None), (1, "")], "page_id long, url string")
    assert url_filter.flag(none, cascade, shards).filter("listed").count() == 0


def test_urls_of_all_junk_hosts_are_listed(spark, tmp_path):
    junk = ["www.cheap-pills.example.com", "m.casino-win.example.org", "free-bets.example.com", "m.ads-track.example.com", "www.spam-farm.example.org", "blog.adult-x.example.net"]
    good = ["blog.therly.example.net", "my-ads-track.example.com", "spam-farms.example.com"]
    rows = [(i, f"https://{host}/a") for i, host in enumerate(junk + good)] + [(99, "http://blog.therly.example.net/free-bets.html")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"] for r in url_filter.op10_url_filter(spark, str(tmp_path)).collect() if r["listed"]}
    assert got == set(range(len(junk)))
