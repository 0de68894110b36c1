"""Documents in long form and the lexicon fitted on them.

docs: doc_id, tokens array<string> [, label]; multi-field docs: doc_id, fields array<struct<name, tokens>> [, label].
doc_id is a number that orders documents: ids are given in the order in which documents first show a term.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions.session import kept
from lexiweave.functions.text import Scheme, drop_empty, normalize_label, normalize_token, term_key
from lexiweave.operators import chunks

_NO_TOKENS = "array<string>"


def runs(rows: DataFrame, items: str, key=lambda x: x) -> DataFrame:
    """`rows` with a column `runs`, array<struct<item, occ>>, of the runs of equal keys in the sorted array `items`.

    A document is counted within its own row, so nothing is shuffled; each step is a projection of its own, lest an
    array be sorted anew for each of its elements.
    """
    bounds = rows.withColumn("_n", F.size(items)).withColumn(
        "_at", F.when(F.col("_n") > 0, F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: (i == 0) | (key(F.get(items, i)) != key(F.get(items, i - 1))))).otherwise(F.array().cast("array<int>"))
    )
    each = F.transform("_at", lambda x, j: F.struct(F.get(items, x).alias("item"), (F.coalesce(F.get("_at", j + 1), F.col("_n")) - x).cast("bigint").alias("occ")))
    return bounds.withColumn("runs", each).drop("_n", "_at", items)


def exploded(rows: DataFrame, array: str | Column, name: str, *others: str) -> DataFrame:
    """`others` and each element of an array as `name`. Of a plain explode the optimiser infers that the array is not
    empty, and computes it twice (or, where it is used within itself, once for each element) to check that."""
    return rows.select(*others, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def term_counts(docs: DataFrame) -> DataFrame:
    """doc_id, token, occ; a row of docs is a document."""
    return counts_and_totals(docs).drop("n_tokens")


def token_totals(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens of every document, empty ones too; tokens that no lexicon knows are counted."""
    return docs.select("doc_id", F.size(drop_empty(F.coalesce("tokens", F.array().cast(_NO_TOKENS)))).alias("n_tokens"))


def counts_and_totals(docs: DataFrame) -> DataFrame:
    """doc_id, token, occ, n_tokens, counted within each document's row."""
    return chunks.term_counts(docs)


def field_totals(docs: DataFrame) -> DataFrame:
    """doc_id, field, n_tokens; a field that a document repeats is one field."""
    return docs.select("doc_id", F.explode(_field_totals()).alias("field", "n_tokens"))


def _field_totals() -> Column:
    """A map from the names of a document's fields to their tokens."""
    names = F.array_distinct(F.transform("fields", lambda f: f["name"]))
    size = lambda f: F.size(drop_empty(F.coalesce(f["tokens"], F.array().cast(_NO_TOKENS)))).cast("bigint")
    total = lambda n: F.aggregate(F.filter("fields", lambda f: f["name"] == n), F.lit(0).cast("bigint"), lambda t, f: t + size(f))
    return F.map_from_entries(F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.struct(n, total(n))))


def _field_terms() -> Column:
    """The keys of a document's tokens with the place and name of their field."""
    of = lambda f, i: F.transform(drop_empty(F.coalesce(f["tokens"], F.array().cast(_NO_TOKENS))), lambda t: F.struct(term_key(f["name"], normalize_token(t)).alias("key"), i.alias("pos"), f["name"].alias("field")))
    return F.flatten(F.transform(F.coalesce("fields", F.array().cast("array<struct<name:string,tokens:array<string>>>")), of))


def field_counts(docs: DataFrame) -> DataFrame:
    """doc_id, field, token (the field-qualified key), occ, n_tokens (of the field).

    Pairs whose keys are equal are one term, of the field that comes first in the document.
    """
    rows = docs.select("doc_id", _field_totals().alias("_totals"), F.array_sort(_field_terms()).alias("_terms"))
    each = exploded(runs(rows, "_terms", lambda x: x["key"]), "runs", "r", "doc_id", "_totals")
    return each.select("doc_id", F.col("r.item.field").alias("field"), F.col("r.item.key").alias("token"), "r.occ", F.element_at("_totals", F.col("r.item.field")).alias("n_tokens"))


def number(df: DataFrame, order: list[str], name: str, start: int) -> DataFrame:
    """Dense ids in the order of `order`, which must tell rows apart.

    Rows are sorted by ranges and written with their place within the range; what goes through one task is the table of
    range sizes, as long as there are partitions. Ids are 32-bit: more than 2**31 rows are an error.
    """
    placed = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(shift), part == F.col("_part")).withColumn(name, (nth + F.col("_before") + start).cast("int")).select(*df.columns, name)


def term_table(docs: DataFrame) -> DataFrame:
    """token, attr_id (from 1), df of flat or multi-field documents: ids by first document, then by term."""
    if "fields" in docs.columns:
        distinct = F.array_distinct(F.transform(_field_terms(), lambda x: x["key"]))
        terms = exploded(docs, distinct, "token", "doc_id").groupBy("token").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("df"))
    else:
        each = chunks.encoded(docs).select(F.inline(F.arrays_zip(F.col("term").alias("token"), "first_doc", "df")))
        terms = each.groupBy("token").agg(F.min("first_doc").alias("first_doc"), F.sum("df").alias("df"))
    return number(terms, ["first_doc", "token"], "attr_id", 1).select("token", "attr_id", "df")


def label_table(docs: DataFrame) -> DataFrame:
    """label (normalised), label_id from 0 in the order of first sight."""
    seen = docs.filter("label is not null").groupBy(normalize_label(F.col("label")).alias("label")).agg(F.min("doc_id").alias("first_doc"))
    return number(seen, ["first_doc", "label"], "label_id", 0).select("label", "label_id")


def field_table(docs: DataFrame) -> DataFrame:
    """field, field_id from 0 in the order of first sight."""
    f = docs.select("doc_id", F.posexplode("fields").alias("pos", "f")).select("doc_id", "pos", F.col("f.name").alias("field"))
    seen = f.groupBy("field").agg(F.min(F.struct("doc_id", "pos")).alias("first")).select("field", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("pos"))
    return number(seen, ["first_doc", "pos"], "field_id", 0).select("field", "field_id")


def prune_by_docfreq(terms: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """The terms that least to most documents have."""
    kept = terms.filter(F.col("df") >= least)
    return kept if most is None else kept.filter(F.col("df") <= most)


def compact(terms: DataFrame) -> DataFrame:
    """token, old_id, new_id: ids 1..k in the order of terms."""
    t = terms.select("token", F.col("attr_id").alias("old_id"))
    return number(t, ["token"], "new_id", 1)


def compacted(terms: DataFrame) -> DataFrame:
    """The term table under its new ids."""
    return terms.join(compact(terms).select(F.col("old_id").alias("attr_id"), "new_id"), "attr_id").withColumn("attr_id", F.col("new_id")).drop("new_id").select(terms.columns)


@dataclass(frozen=True)
class Lexicon:
    """What is learned from the fitted documents: term, label and field tables, and settings."""

    terms: DataFrame
    labels: DataFrame | None = None
    fields: DataFrame | None = None
    doc_num: int = 0
    scheme: Scheme = Scheme.FREQUENCY
    field_schemes: tuple[tuple[str, Scheme], ...] = ()
    normalize: bool = False  # whether vectors() divides by the length of the vector
    classifier: str = ""

    @classmethod
    def fit(cls, docs: DataFrame, scheme: str | Scheme = Scheme.FREQUENCY, **settings) -> Lexicon:
        """Every document counts in doc_num, empty ones too. The tables are written, each from one scan of what it needs."""
        multi = "fields" in docs.columns
        return cls(
            term_table(docs), label_table(docs) if "label" in docs.columns else None, field_table(docs) if multi else None,
            docs.count() if multi else chunks.encoded(docs).agg(F.sum(F.size("doc_id"))).first()[0] or 0, Scheme.parse(scheme), **settings,
        )

    def with_field_scheme(self, field: str, scheme: str | Scheme) -> Lexicon:
        """Weight one field by a scheme of its own; setting another one later is an error."""
        scheme, known = Scheme.parse(scheme), dict(self.field_schemes)
        if known.get(field, scheme) != scheme:
            raise ValueError(f"field {field!r} already has the scheme {known[field].value}")
        return replace(self, field_schemes=tuple((known | {field: scheme}).items()))

    def pruned(self, least: int = 1, most: int | None = None) -> Lexicon:
        return replace(self, terms=prune_by_docfreq(self.terms, least, most))

    def restricted(self, attr_ids: DataFrame) -> Lexicon:
        """Only the terms of a table of attr_id."""
        return replace(self, terms=self.terms.join(attr_ids.select("attr_id").distinct(), "attr_id", "left_semi").select(self.terms.columns))

    def without(self, attr_ids: DataFrame) -> Lexicon:
        return replace(self, terms=self.terms.join(attr_ids.select("attr_id"), "attr_id", "left_anti").select(self.terms.columns))

    def compacted(self) -> Lexicon:
        return replace(self, terms=compacted(self.terms))

    def sizes(self) -> DataFrame:
        """n_terms, max_id, n_labels, doc_num."""
        labels = self.labels.agg(F.count("*").alias("n_labels")) if self.labels is not None else self.terms.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_labels"))
        return self.terms.agg(F.count("*").alias("n_terms"), F.max("attr_id").alias("max_id")).crossJoin(labels).withColumn("doc_num", F.lit(self.doc_num).cast("bigint"))
