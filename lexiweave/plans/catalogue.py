"""Every registered query of the library's own operators, with its SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions.session import kept, spread
from lexiweave.functions.stemmer import stem_terms
from lexiweave.functions.text import Scheme, sigmoid, tokenize
from lexiweave.operators import chunks, corpus, evaluate, models, scorers
from lexiweave.operators import lexicon as lx
from lexiweave.operators import weighting as wt
from lexiweave.sources import corpus as src

#: Terms kept by score, and document frequencies kept by pruning.
TOP, MIN_DF, MAX_DF, DENSE, SAMPLE = 200, 3, 200, 50, 100
#: Terms that classifiers are trained on.
BEST = 2000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.of_texts(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").select("doc_id", F.col("lang").alias("label"), F.col("text").cast("string").alias("text")))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a conversation, a field a role."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("conv_id", "doc_id")
    each = F.struct("turn", F.struct(F.col("role").alias("name"), tokenize(F.col("text")).alias("tokens")).alias("f"))
    return turns.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["f"]).alias("fields"))


def _weights(spark, sf_dir, scheme, l2=False):
    docs = _documents(spark, sf_dir)
    v = wt.vectors(docs, lx.Lexicon.fit(docs, scheme), l2=l2)
    return v.select("doc_id", "attr_id", F.round("value", 6).alias("value"))


def _fields(spark, sf_dir, own=()):
    docs = _conversations(spark, sf_dir)
    lexicon = lx.Lexicon.fit(docs, "tfidf")
    for name, scheme in own:
        lexicon = lexicon.with_field_scheme(name, scheme)
    return wt.vectors(docs, lexicon).select("doc_id", "attr_id", F.round("value", 6).alias("value")).filter("value <> 0")


def _scored(spark, sf_dir, scheme=Scheme.FREQUENCY):
    docs = _documents(spark, sf_dir)
    lexicon = lx.Lexicon.fit(docs, scheme)
    return docs, lexicon, scorers.summed(docs, lexicon)


def _scores(spark, sf_dir, scorer, scheme=Scheme.FREQUENCY):
    return scorer(_scored(spark, sf_dir, scheme)[2]).select("attr_id", F.round("score", 6).alias("score"))


def _selected(spark, sf_dir, n):
    docs, lexicon, cells = _scored(spark, sf_dir)
    return docs, lexicon, scorers.select_best(lexicon.terms, scorers.log_likelihood(cells), n, digits=6)


def _lines(spark, sf_dir, format, n=None, scheme="occurrences"):
    if n:
        docs, lexicon, best = _selected(spark, sf_dir, n)
        lexicon = lexicon.restricted(best).compacted()
        lexicon = replace(lexicon, terms=kept(lexicon.terms, "terms"))
    else:
        docs = _documents(spark, sf_dir)
        lexicon = lx.Lexicon.fit(docs)
    return src.document_lines(docs, lexicon, scheme, format)


def _judged(spark, sf_dir):
    docs, lexicon, cells = _scored(spark, sf_dir)
    return docs, lexicon, kept(evaluate.judged(docs, lexicon, scorers.cell_scores(cells)), "judged")


def _predicted(spark, sf_dir):
    docs, lexicon, scores = _judged(spark, sf_dir)
    return kept(evaluate.best_label(docs, scores, lexicon.labels), "predicted").join(docs.select("doc_id", F.col("label").alias("expected")), "doc_id")


def _roundtrip(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    p = src.parse_lines(src.simple_lines(docs, lx.Lexicon.fit(docs)))
    return p.select("doc_id", "label_id", F.col("totals")[0].alias("n_tokens"), F.explode("features").alias("f")).select("doc_id", "label_id", "n_tokens", "f.attr_id", "f.occ")


def _multi_lines(spark, sf_dir, keep=None):
    docs = _conversations(spark, sf_dir)
    return src.multifield_lines(docs, lx.Lexicon.fit(docs), keep)


def _pruned(spark, sf_dir, literal):
    docs = _documents(spark, sf_dir)
    lexicon = lx.Lexicon.fit(docs)
    kept = lx.prune_by_docfreq(lexicon.terms, MIN_DF, MAX_DF)
    v = wt.vectors(docs, lexicon)
    out = wt.first_positions(v, kept) if literal else wt.remapped(v, lx.compact(kept))
    return out.select("doc_id", "attr_id", F.round("value", 6).alias("value"))


def _closed(spark, sf_dir):
    """A lexicon of documents, applied to pages."""
    fitted = lx.Lexicon.fit(_documents(spark, sf_dir), "tfidf")
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").select(F.col("page_id").alias("doc_id"), F.col("html").cast("string").alias("text"))
    return wt.vectors(chunks.of_texts(pages), fitted).select("doc_id", "attr_id", F.round("value", 6).alias("value"))


def _top(spark, sf_dir):
    _, lexicon, o = _scored(spark, sf_dir)
    cells = scorers.cell_scores(o).select("attr_id", "label", F.round("score", 6).alias("score"))
    return scorers.top_per_label(cells, 20).join(lexicon.terms.select("attr_id", "token"), "attr_id").select("label", "rank", "token", "score")


def _sizes(spark, sf_dir):
    return lx.Lexicon.fit(_documents(spark, sf_dir)).sizes()


def _ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")


def _regression(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return evaluate.regression(d.select(F.size(tokenize(F.col("text"))).alias("predicted"), (F.col("n_chars") / 6).alias("expected")))


def _validated(spark, sf_dir, kind):
    return models.cross_validate(_documents(spark, sf_dir), models.Learner(kind, top_n=BEST), 3)


def _training(spark, sf_dir, kind="svc"):
    """Fitted on four fifths of the documents; every document is scored, with whether it was held out."""
    docs = kept(models.folds(_documents(spark, sf_dir), 5), "folds")
    got = models.Learner(kind, top_n=BEST).fit(docs.filter("fold <> 0").drop("fold")).scores(docs.drop("fold"))
    return got.join(docs.select("doc_id", (F.col("fold") == 0).alias("held_out")), "doc_id").select("doc_id", "predicted", "held_out")


def _fixed(spark, sf_dir, sigmoids):
    """Documents under a linear model with given weights, a bias feature among them."""
    docs = _documents(spark, sf_dir)
    lexicon = lx.Lexicon.fit(docs, "tfidf")
    labels = [r["label"] for r in lexicon.labels.orderBy("label_id").collect()]
    size = lexicon.terms.agg(F.max("attr_id")).first()[0]
    w = F.array(*[((F.col("id") * 37 + i * 11) % 101 - 50) / 50 for i in range(len(labels))])
    weights = spark.range(1, size + 2).select(F.col("id").cast("int").alias("attr_id"), w.alias("w"))
    c = models.Classifier(lexicon, labels, size, weights, [0.0] * len(labels), "logreg", 1.0, sigmoids=[(1.0, 0.0)] * len(labels) if sigmoids else None)
    return c.classify(docs).select("doc_id", "label", F.round("score", 6).alias("score"))


def _known_fields(spark, sf_dir):
    """A lexicon of the turns of some roles, applied to all: terms of other fields are unknown."""
    docs = _conversations(spark, sf_dir)
    fitted = lx.Lexicon.fit(corpus.filter_fields(docs, ["user", "assistant"]))
    return wt.vectors(docs, fitted)


def _weighted_lines(spark, sf_dir):
    lexicon = lx.Lexicon.fit(_documents(spark, sf_dir))
    weights = lexicon.terms.select("attr_id", (F.col("df") - 1).cast("double").alias("weight"))
    scores = lexicon.terms.filter("attr_id % 2 = 0").select("attr_id", F.col("df").cast("double").alias("score"))
    return src.lexicon_lines(lexicon, scores, weights).select("line")


def _arff_header(spark, sf_dir):
    _, lexicon, best = _selected(spark, sf_dir, TOP)
    return src.arff_header(lexicon.restricted(best).compacted())


def _parsed_fields(spark, sf_dir):
    docs = _conversations(spark, sf_dir)
    return src.parse_lines(src.multifield_lines(docs, lx.Lexicon.fit(docs)))


def _flat_features(parsed):
    each = parsed.select("doc_id", "totals", F.explode("features").alias("f")).select("doc_id", "totals", "f.*")
    return each.select("doc_id", "attr_id", "occ", "field_id", F.get("totals", F.col("field_id")).alias("n_tokens"))


def _revectorized(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    lexicon = lx.Lexicon.fit(docs)
    parsed = kept(src.parse_lines(src.simple_lines(docs, lexicon)), "parsed")
    return src.revectorized(parsed, lexicon, src.Options("occurrences", min_df=MIN_DF, max_df=MAX_DF, compact=True))[0]


def _dump(spark, sf_dir):
    _, lexicon, cells = _scored(spark, sf_dir)
    return scorers.log_likelihood(cells).join(lexicon.terms, "attr_id").select("token", F.round("score", 6).alias("score"))


def _wrong(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    lexicon = lx.Lexicon.fit(docs)
    return models.misclassified(_predicted(spark, sf_dir), docs, lexicon).select("doc_id", "expected", "predicted", F.coalesce(F.size("terms"), F.lit(-1)).alias("n_terms"))


def _without(spark, sf_dir):
    lexicon = lx.Lexicon.fit(_documents(spark, sf_dir))
    return lexicon.without(lexicon.terms.filter("df > 1")).terms


_Q = {
    "tokenize_documents": lambda s, d: lx.term_counts(_documents(s, d)),
    "doc_token_totals": lambda s, d: lx.token_totals(_documents(s, d)),
    "lexicon_build": lambda s, d: lx.term_table(_documents(s, d)),
    "lexicon_sizes": _sizes,
    "lexicon_lines": lambda s, d: src.lexicon_lines(lx.Lexicon.fit(_documents(s, d))).select("line"),
    "label_index": lambda s, d: lx.label_table(_documents(s, d)),
    "field_index": lambda s, d: lx.field_table(_conversations(s, d)),
    **{f"weight_{x.value}": partial(_weights, scheme=x) for x in Scheme},
    "weight_l2_normalized": partial(_weights, scheme="tfidf", l2=True),
    "multifield_term_counts": lambda s, d: lx.field_counts(_conversations(s, d)),
    "multifield_field_totals": lambda s, d: lx.field_totals(_conversations(s, d)),
    "multifield_tfidf": _fields,
    "multifield_custom_scheme": partial(_fields, own=(("system", "boolean"), ("user", "occurrences"))),
    "prune_docfreq": lambda s, d: lx.prune_by_docfreq(lx.term_table(_documents(s, d)), MIN_DF, MAX_DF),
    "lexicon_compact": lambda s, d: lx.compact(lx.prune_by_docfreq(lx.term_table(_documents(s, d)), MIN_DF, MAX_DF)),
    "pruned_vectors": partial(_pruned, literal=False),
    "pruned_vectors_compat": partial(_pruned, literal=True),
    "classify_time_vectors": _closed,
    "contingency_matrix": lambda s, d: scorers.contingency(_scored(s, d)[2]).select("attr_id", "label", F.round("total", 6).alias("total")),
    "llr_scores": partial(_scores, scorer=scorers.log_likelihood),
    "llr_scores_tfidf": partial(_scores, scorer=scorers.log_likelihood, scheme="tfidf"),
    "chi_square_scores": partial(_scores, scorer=scorers.chi_square, scheme="occurrences"),
    "select_top_n_llr": lambda s, d: _selected(s, d, TOP)[2].select("token", "attr_id", "df", "score"),
    "vectors_svmlight": partial(_lines, format="svmlight"),
    "vectors_arff_rows": partial(_lines, format="ARFF", n=TOP),
    "vectors_uci_dense": partial(_lines, format="UCI", n=DENSE, scheme="boolean"),
    "raw_serialize_simple": lambda s, d: (lambda docs: src.simple_lines(docs, lx.Lexicon.fit(docs)))(_documents(s, d)),
    "raw_serialize_multifield": _multi_lines,
    "raw_roundtrip": _roundtrip,
    "filter_fields": lambda s, d: lx.field_counts(corpus.filter_fields(_conversations(s, d), ["user"])),
    "corpus_union": lambda s, d: corpus.union(_documents(s, d).select("doc_id"), _conversations(s, d).select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")),
    "corpus_sample": lambda s, d: corpus.sample(_ids(s, d), SAMPLE),
    "corpus_split_complement": lambda s, d: corpus.complement(_ids(s, d), corpus.sample(_ids(s, d), SAMPLE)),
    "best_label": lambda s, d: _predicted(s, d).select("doc_id", "predicted"),
    "best_labels_ratio": lambda s, d: (lambda _, lexicon, scores: evaluate.best_labels(scores, lexicon.labels, 0.5))(*_judged(s, d)),
    "platt_sigmoid": lambda s, d: _judged(s, d)[2].select("doc_id", "label", F.round(sigmoid(F.col("score")), 6).alias("probability")),
    "confusion_matrix": lambda s, d: evaluate.confusion(_predicted(s, d)),
    "precision_recall": lambda s, d: evaluate.precision_recall(_predicted(s, d)),
    "regression_metrics": _regression,
    "top_attributes_per_label": _top,
    "stem_vocabulary": lambda s, d: stem_terms(lx.term_counts(_documents(s, d))),
    "linear_scores": partial(_fixed, sigmoids=False),
    "linear_probabilities": partial(_fixed, sigmoids=True),
    "known_fields_only": _known_fields,
    "lexicon_header": lambda s, d: src.lexicon_header(lx.Lexicon.fit(_documents(s, d))),
    "lexicon_header_fields": lambda s, d: src.lexicon_header(lx.Lexicon.fit(_conversations(s, d), "tfidf").with_field_scheme("user", "boolean")),
    "lexicon_lines_weighted": _weighted_lines,
    "lexicon_without": _without,
    "vectors_arff_header": _arff_header,
    "raw_roundtrip_multifield": lambda s, d: _flat_features(_parsed_fields(s, d)),
    "raw_filter_fields": lambda s, d: _flat_features(src.kept_fields(_parsed_fields(s, d), [0, 2])),
    "raw_filter_fields_literal": lambda s, d: _flat_features(src.kept_fields(_parsed_fields(s, d), [1], literal=True)),
    "revectorized_raw": _revectorized,
    "best_attributes": _dump,
    "misclassified_documents": _wrong,
    "train_predict_linear_svc": _training,
    "train_predict_rbf": partial(_training, kind="rbf"),
    "cross_validation_svc": partial(_validated, kind="svc"),
    "cross_validation_logreg": lambda s, d: models.report(_validated(s, d, "logreg")),
}

_BASE = r"""WITH d AS (SELECT doc_id, lang AS label, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\W'), lambda x: length(x) > 0), lambda x: lower(x)) AS tokens FROM documents),
tot AS (SELECT doc_id, label, CAST(len(tokens) AS INTEGER) AS n_tokens FROM d),
tc AS (SELECT doc_id, token, count(*) AS occ FROM (SELECT doc_id, unnest(tokens) AS token FROM d) GROUP BY ALL),
lex AS (SELECT token, CAST(row_number() OVER (ORDER BY first_doc, token) AS INTEGER) AS attr_id, df FROM (SELECT token, min(doc_id) AS first_doc, count(*) AS df FROM tc GROUP BY token)),
lab AS (SELECT label, CAST(row_number() OVER (ORDER BY first_doc, label) - 1 AS INTEGER) AS label_id FROM (SELECT lower(replace(label, ' ', '_')) AS label, min(doc_id) AS first_doc FROM d WHERE label IS NOT NULL GROUP BY 1)),
nn AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, label, token, attr_id, df, occ, n_tokens, 1.0::DOUBLE AS boolean, occ::DOUBLE AS occurrences, occ / n_tokens AS frequency, occ / n_tokens * ln(n / df) AS tfidf FROM tc JOIN tot USING (doc_id) JOIN lex USING (token), nn)
"""
_CELLS = """, o AS (SELECT attr_id, label, sum({0}) AS o FROM w WHERE {0} <> 0 GROUP BY ALL),
cell AS (SELECT attr_id, label, o, sum(o) OVER (PARTITION BY attr_id) AS ta, sum(o) OVER (PARTITION BY label) AS tc, sum(o) OVER () AS t FROM o),
cs AS (SELECT attr_id, label, 2 * o * ln(o / (ta * tc / t)) AS score FROM cell),
llr AS (SELECT attr_id, sum(score) AS score FROM cs GROUP BY attr_id)
"""
_JUDGED = _BASE + _CELLS.format("frequency") + """, sc AS (SELECT w.doc_id, cs.label, round(sum(w.frequency * cs.score), 6) AS score FROM w JOIN cs USING (attr_id) GROUP BY ALL),
best AS (SELECT d.doc_id, d.label AS expected, coalesce(x.top, (SELECT label FROM lab WHERE label_id = 0)) AS predicted FROM d LEFT JOIN
 (SELECT doc_id, arg_max(sc.label, (score, label_id)) AS top FROM sc JOIN lab USING (label) WHERE score >= 0 GROUP BY doc_id) x USING (doc_id))
"""
_TOP = ", ranked AS (SELECT token, attr_id, df, round(coalesce(score, -1), 6) AS score FROM lex LEFT JOIN llr USING (attr_id)), sel AS (SELECT * FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM ranked) WHERE r <= {0})"
_NEW = ", ids AS (SELECT attr_id, CAST(row_number() OVER (ORDER BY token) AS INTEGER) AS id FROM sel)"
_FIELDS = r"""WITH c AS (SELECT conv_id AS doc_id, turn, role AS field, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\W'), lambda x: length(x) > 0), lambda x: lower(x)) AS tokens FROM conversations),
ft AS (SELECT doc_id, field, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM c GROUP BY ALL),
fc AS (SELECT doc_id, field, field || '_' || token AS token, count(*) AS occ FROM (SELECT doc_id, field, unnest(tokens) AS token FROM c) GROUP BY ALL),
lex AS (SELECT token, CAST(row_number() OVER (ORDER BY first_doc, token) AS INTEGER) AS attr_id, df FROM (SELECT token, min(doc_id) AS first_doc, count(*) AS df FROM fc GROUP BY token)),
fid AS (SELECT field, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS field_id FROM (SELECT field, min((doc_id, turn)) AS f FROM c GROUP BY field)),
w AS (SELECT doc_id, field, token, attr_id, occ, n_tokens, CASE WHEN df = n THEN occ / n_tokens ELSE occ / n_tokens * ln(n / df) END AS tfidf FROM fc JOIN ft USING (doc_id, field) JOIN lex USING (token), (SELECT count(DISTINCT doc_id) AS n FROM c))
"""
_MULTI = _FIELDS + """, feats AS (SELECT doc_id, string_agg(attr_id || ':' || occ || ':' || field_id, chr(9) ORDER BY attr_id) AS f FROM w JOIN fid USING (field) WHERE {0} GROUP BY doc_id),
sizes AS (SELECT doc_id, string_agg(CAST(CAST(coalesce(n_tokens, 0) AS DOUBLE) AS VARCHAR), chr(9) ORDER BY field_id) AS t FROM (SELECT DISTINCT doc_id FROM c) CROSS JOIN fid LEFT JOIN (SELECT * FROM ft WHERE {0}) USING (doc_id, field) GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(9), 'MultiFieldDocument', '0', (SELECT count(*) FROM fid), t, f) AS line FROM sizes LEFT JOIN feats USING (doc_id)"""
_PRUNED = f", kept AS (SELECT token, attr_id, df FROM lex WHERE df BETWEEN {MIN_DF} AND {MAX_DF}), comp AS (SELECT token, attr_id AS old_id, CAST(row_number() OVER (ORDER BY token) AS INTEGER) AS new_id FROM kept)"
_LINEAR = """, wt AS (SELECT attr_id, label, ((attr_id * 37 + label_id * 11) % 101 - 50) / 50 AS wgt FROM (SELECT attr_id FROM lex UNION ALL SELECT max(attr_id) + 1 FROM lex) CROSS JOIN lab),
lin AS (SELECT d.doc_id, b.label, coalesce(s, 0) + b.wgt AS x FROM d CROSS JOIN (SELECT label, wgt FROM wt WHERE attr_id = (SELECT max(attr_id) + 1 FROM lex)) b
 LEFT JOIN (SELECT doc_id, wt.label, sum(tfidf * wgt) AS s FROM w JOIN wt USING (attr_id) GROUP BY ALL) x ON x.doc_id = d.doc_id AND x.label = b.label)
"""
_DRAWN = f"SELECT doc_id FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT {SAMPLE}"

_SQL = {
    "tokenize_documents": _BASE + "SELECT * FROM tc",
    "doc_token_totals": _BASE + "SELECT doc_id, n_tokens FROM tot",
    "lexicon_build": _BASE + "SELECT * FROM lex",
    "lexicon_sizes": _BASE + "SELECT count(*) AS n_terms, max(attr_id) AS max_id, (SELECT count(*) FROM lab) AS n_labels, (SELECT n FROM nn) AS doc_num FROM lex",
    "lexicon_lines": _BASE + "SELECT concat_ws(chr(9), token, attr_id, df) AS line FROM lex",
    "label_index": _BASE + "SELECT * FROM lab",
    "field_index": _FIELDS + "SELECT * FROM fid",
    **{f"weight_{x.value}": _BASE + f"SELECT doc_id, attr_id, round({x.value}, 6) AS value FROM w" for x in Scheme},
    "weight_l2_normalized": _BASE + "SELECT doc_id, attr_id, round(CASE WHEN l = 0 THEN 0 ELSE tfidf / l END, 6) AS value FROM (SELECT *, sqrt(sum(tfidf * tfidf) OVER (PARTITION BY doc_id)) AS l FROM w)",
    "multifield_term_counts": _FIELDS + "SELECT doc_id, field, token, occ, n_tokens FROM w",
    "multifield_field_totals": _FIELDS + "SELECT * FROM ft",
    "multifield_tfidf": _FIELDS + "SELECT * FROM (SELECT doc_id, attr_id, round(tfidf, 6) AS value FROM w) WHERE value <> 0",
    "multifield_custom_scheme": _FIELDS + "SELECT * FROM (SELECT doc_id, attr_id, round(CASE field WHEN 'system' THEN 1 WHEN 'user' THEN occ ELSE tfidf END, 6) AS value FROM w) WHERE value <> 0",
    "prune_docfreq": _BASE + _PRUNED + "SELECT * FROM kept",
    "lexicon_compact": _BASE + _PRUNED + "SELECT * FROM comp",
    "pruned_vectors": _BASE + _PRUNED + "SELECT doc_id, new_id AS attr_id, round(frequency, 6) AS value FROM w JOIN comp ON old_id = attr_id",
    "pruned_vectors_compat": _BASE + _PRUNED + """SELECT doc_id, attr_id, round(CASE WHEN inside THEN frequency ELSE 0 END, 6) AS value FROM (SELECT w.*, kept.attr_id IS NOT NULL AS inside,
 row_number() OVER (PARTITION BY doc_id ORDER BY w.attr_id) AS pos, count(kept.attr_id) OVER (PARTITION BY doc_id) AS k FROM w LEFT JOIN kept ON kept.attr_id = w.attr_id) WHERE pos <= k""",
    "classify_time_vectors": _BASE + r""", p AS (SELECT page_id AS doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(html, ''), '\W'), lambda x: length(x) > 0), lambda x: lower(x)) AS tokens FROM pages),
 pc AS (SELECT doc_id, n_tokens, token, count(*) AS occ FROM (SELECT doc_id, len(tokens) AS n_tokens, unnest(tokens) AS token FROM p) GROUP BY ALL)
 SELECT doc_id, attr_id, round(occ / n_tokens * ln(n / df), 6) AS value FROM pc JOIN lex USING (token), nn""",
    "contingency_matrix": _BASE + "SELECT attr_id, label, round(sum(frequency), 6) AS total FROM w GROUP BY CUBE (attr_id, label)",
    "llr_scores": _BASE + _CELLS.format("frequency") + "SELECT attr_id, round(score, 6) AS score FROM llr",
    "llr_scores_tfidf": _BASE + _CELLS.format("tfidf") + "SELECT attr_id, round(score, 6) AS score FROM llr",
    "chi_square_scores": _BASE + _CELLS.format("occurrences") + """, grid AS (SELECT r.attr_id, r.ta, r.t, l.label, l.tc, coalesce(o.o, 0) AS a FROM (SELECT DISTINCT attr_id, ta, t FROM cell) r CROSS JOIN (SELECT DISTINCT label, tc FROM cell) l
 LEFT JOIN o ON o.attr_id = r.attr_id AND o.label = l.label)
 SELECT attr_id, round(sum(t * (a * (t - tc - ta + a) - (tc - a) * (ta - a)) ** 2 / (tc * (t - tc) * ta * (t - ta))), 6) AS score FROM grid GROUP BY attr_id""",
    "select_top_n_llr": _BASE + _CELLS.format("frequency") + _TOP.format(TOP) + "SELECT token, attr_id, df, score FROM sel",
    "vectors_svmlight": _BASE + "SELECT d.doc_id, label_id || '  ' || coalesce(f, '') AS line FROM d JOIN lab USING (label) LEFT JOIN (SELECT doc_id, string_agg(attr_id || ':' || occurrences, ' ' ORDER BY attr_id) AS f FROM w GROUP BY doc_id) USING (doc_id)",
    "vectors_arff_rows": _BASE + _CELLS.format("frequency") + _TOP.format(TOP) + _NEW + "SELECT d.doc_id, '{' || concat_ws(', ', '0 ' || label, f) || '}' AS line FROM d LEFT JOIN (SELECT doc_id, string_agg(id || ' ' || occurrences, ', ' ORDER BY id) AS f FROM w JOIN ids USING (attr_id) GROUP BY doc_id) USING (doc_id)",
    "vectors_uci_dense": _BASE + _CELLS.format("frequency") + _TOP.format(DENSE) + _NEW + "SELECT d.doc_id, concat_ws(',', d.label, string_agg(CASE WHEN w.doc_id IS NULL THEN '0.0' ELSE '1.0' END, ',' ORDER BY id)) AS line FROM d CROSS JOIN ids LEFT JOIN w ON w.doc_id = d.doc_id AND w.attr_id = ids.attr_id GROUP BY d.doc_id, d.label",
    "raw_serialize_simple": _BASE + "SELECT tot.doc_id, concat_ws(chr(9), 'SimpleDocument', label_id, CAST(n_tokens AS DOUBLE), f) AS line FROM tot JOIN lab USING (label) LEFT JOIN (SELECT doc_id, string_agg(attr_id || ':' || occ, chr(9) ORDER BY attr_id) AS f FROM w GROUP BY doc_id) USING (doc_id)",
    "raw_serialize_multifield": _MULTI.format("true"),
    "raw_roundtrip": _BASE + "SELECT doc_id, label_id, CAST(n_tokens AS DOUBLE) AS n_tokens, attr_id, occ FROM w JOIN lab USING (label)",
    "filter_fields": _FIELDS + "SELECT doc_id, field, token, occ, n_tokens FROM w WHERE field = 'user'",
    "corpus_union": "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT DISTINCT conv_id FROM conversations) GROUP BY doc_id",
    "corpus_sample": _DRAWN,
    "corpus_split_complement": f"SELECT doc_id FROM documents WHERE doc_id NOT IN ({_DRAWN})",
    "best_label": _JUDGED + "SELECT doc_id, predicted FROM best",
    "best_labels_ratio": _JUDGED + """SELECT doc_id, arg_max(label, label_id) AS label, scaled FROM (SELECT doc_id, label, label_id, round((score - lo) / nullif(hi - lo, 0), 6) AS scaled FROM
 (SELECT *, min(score) OVER (PARTITION BY doc_id) AS lo, max(score) OVER (PARTITION BY doc_id) AS hi FROM sc) JOIN lab USING (label)) WHERE scaled >= 0.5 GROUP BY doc_id, scaled""",
    "platt_sigmoid": _JUDGED + "SELECT doc_id, label, round(1 / (1 + exp(-2 * score)), 6) AS probability FROM sc",
    "confusion_matrix": _JUDGED + "SELECT predicted, expected, count(*) AS n FROM best GROUP BY ALL",
    "precision_recall": _JUDGED + """SELECT label, support, round(hit / nullif(claimed, 0), 6) AS precision, round(hit / nullif(support, 0), 6) AS recall, (SELECT round(avg(CASE WHEN predicted = expected THEN 1.0 ELSE 0.0 END), 6) FROM best) AS accuracy
 FROM (SELECT label, CAST(sum(s) AS BIGINT) AS support, sum(c) AS claimed, sum(h) AS hit FROM (SELECT expected AS label, 1 AS s, 0 AS c, CASE WHEN predicted = expected THEN 1 ELSE 0 END AS h FROM best UNION ALL SELECT predicted, 0, 1, 0 FROM best) GROUP BY label)""",
    "regression_metrics": _BASE + "SELECT round(avg((n_tokens - y) ** 2), 6) AS mse, round(corr(n_tokens, y) ** 2, 6) AS squared_correlation FROM (SELECT n_tokens, n_chars / 6 AS y FROM tot JOIN documents USING (doc_id))",
    "top_attributes_per_label": _BASE + _CELLS.format("frequency") + "SELECT label, CAST(rank AS INTEGER) AS rank, token, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, attr_id DESC) AS rank FROM (SELECT attr_id, label, round(score, 6) AS score FROM cs)) JOIN lex USING (attr_id) WHERE rank <= 20",
    "linear_scores": _BASE + _LINEAR + "SELECT doc_id, label, round(x, 6) AS score FROM lin",
    "linear_probabilities": _BASE + _LINEAR + "SELECT doc_id, label, round(s / sum(s) OVER (PARTITION BY doc_id), 6) AS score FROM (SELECT *, 1 / (1 + exp(-x)) AS s FROM lin)",
    "known_fields_only": _FIELDS.replace("FROM conversations)", "FROM conversations WHERE role IN ('user', 'assistant'))") + "SELECT doc_id, attr_id, occ / n_tokens AS value FROM w",
    "lexicon_header": _BASE + """SELECT 0::BIGINT AS ord, CAST(n AS VARCHAR) AS line FROM nn UNION ALL VALUES (1, 'frequency'), (2, 'false'), (3, ''), (5, '')
 UNION ALL SELECT 4, (SELECT string_agg(label || ' ', '' ORDER BY label_id) FROM lab)""",
    "lexicon_header_fields": _FIELDS + """SELECT 0::BIGINT AS ord, CAST((SELECT count(DISTINCT doc_id) FROM c) AS VARCHAR) AS line UNION ALL VALUES (1, 'tfidf'), (2, 'false'), (3, ''), (4, '')
 UNION ALL SELECT 5, (SELECT string_agg(field || CASE WHEN field = 'user' THEN ':BOOLEAN' ELSE '' END || ' ', '' ORDER BY field_id) FROM fid)""",
    "lexicon_lines_weighted": _BASE + "SELECT concat_ws(chr(9), token, attr_id, df, CAST(df - 1 AS DOUBLE), CASE WHEN attr_id % 2 = 0 THEN CAST(df AS DOUBLE) ELSE -1.0::DOUBLE END) AS line FROM lex WHERE df > 1",
    "lexicon_without": _BASE + "SELECT token, attr_id, df FROM lex WHERE df = 1",
    "vectors_arff_header": _BASE + _CELLS.format("frequency") + _TOP.format(TOP) + _NEW + """, named AS (SELECT id, token FROM sel JOIN ids USING (attr_id)), k AS (SELECT max(id) AS k FROM ids)
 SELECT 0::BIGINT AS ord, '@relation dataset' AS line UNION ALL VALUES (1, '') UNION ALL SELECT 2, '@attribute label {' || (SELECT string_agg(label, ',' ORDER BY label_id) FROM lab) || '}'
 UNION ALL SELECT id + 3, '@attribute "i_' || id || '_' || token || '"  NUMERIC' FROM named UNION ALL SELECT k + 4, '' FROM k UNION ALL SELECT k + 5, '@data' FROM k""",
    "raw_roundtrip_multifield": _FIELDS + "SELECT doc_id, attr_id, occ, field_id, CAST(n_tokens AS DOUBLE) AS n_tokens FROM w JOIN fid USING (field)",
    "raw_filter_fields": _FIELDS + "SELECT doc_id, attr_id, occ, field_id, CAST(n_tokens AS DOUBLE) AS n_tokens FROM w JOIN fid USING (field) WHERE field_id IN (0, 2)",
    "raw_filter_fields_literal": _FIELDS + "SELECT doc_id, attr_id, occ, field_id, CAST(n_tokens AS DOUBLE) AS n_tokens FROM w JOIN fid USING (field) WHERE field_id >= 1",
    "revectorized_raw": _BASE + _PRUNED + "SELECT d.doc_id, label_id || '  ' || coalesce(f, '') AS line FROM d JOIN lab USING (label) LEFT JOIN (SELECT doc_id, string_agg(new_id || ':' || occurrences, ' ' ORDER BY new_id) AS f FROM w JOIN comp ON old_id = attr_id GROUP BY doc_id) USING (doc_id) WHERE len(d.tokens) > 0",
    "best_attributes": _BASE + _CELLS.format("frequency") + "SELECT token, round(score, 6) AS score FROM llr JOIN lex USING (attr_id)",
    "misclassified_documents": _JUDGED + "SELECT doc_id, expected, predicted, coalesce(n, -1)::INTEGER AS n_terms FROM best LEFT JOIN (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id) USING (doc_id) WHERE predicted <> expected",
}


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
