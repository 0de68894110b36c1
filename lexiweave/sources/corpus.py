"""Text formats of documents, vectors and lexicons: rendered and parsed as columns, read and written as text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexiweave.functions.session import kept
from lexiweave.functions.text import Scheme, normalize_label
from lexiweave.operators import chunks, scorers
from lexiweave.operators.lexicon import Lexicon, compact, field_counts, field_totals
from lexiweave.operators.weighting import weight

_FEATURES = "array<struct<attr_id:int,occ:bigint,field_id:int>>"


def labelled(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, label, label_id; documents without a label have a null id."""
    if lexicon.labels is None or "label" not in docs.columns:
        return docs.select("doc_id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("label_id"))
    named = docs.select("doc_id", normalize_label(F.col("label")).alias("label"))
    return _identified(named, lexicon).select("doc_id", "label", "label_id")


def _identified(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows with a normalised label, with its id. Labels are few beside documents, and some have most of them: they are
    sent to every executor, where a shuffle would bring all documents of a label to one task."""
    return rows.join(F.broadcast(lexicon.labels), "label", "left")


def packed(docs: DataFrame, lexicon: Lexicon, scheme: str | None = None) -> DataFrame:
    """label, label_id and what chunks.features() has of each document."""
    return _named(chunks.features(docs, lexicon.terms, Scheme.parse(scheme or lexicon.scheme).value, lexicon.doc_num, lexicon.normalize), docs, lexicon)


def _named(rows: DataFrame, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    if lexicon.labels is None or "label" not in docs.columns:
        return rows.withColumns({"label": F.lit(None).cast("string"), "label_id": F.lit(None).cast("int")})
    return _identified(rows.withColumn("label", normalize_label(F.col("label"))), lexicon)


def simple_lines(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, line: kind, label id (0 if there is none), token total, then id:occurrences by id, set apart by tabs. A row
    of docs is a document."""
    rows = _named(chunks.rendered(docs, lexicon.terms, ":", "\t"), docs, lexicon)
    total = F.col("n_tokens").cast("double").cast("string")
    return rows.select("doc_id", F.concat_ws("\t", F.lit("SimpleDocument"), F.coalesce("label_id", F.lit(0)).cast("string"), total, "parts").alias("line"))


def multifield_lines(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """doc_id, line: kind, label id, number of fields, tokens of each field by id, then id:occurrences:field.

    keep: names of the fields whose tokens and features are written; others have 0 tokens.
    """
    fields = lexicon.fields
    wanted = F.lit(True) if keep is None else F.col("field").isin(keep)
    count = lexicon.fields.agg(F.max("field_id")).first()[0]
    n_fields = 0 if count is None else count + 1
    known = field_counts(docs).filter(wanted).join(lexicon.terms, "token").join(fields, "field")
    features = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("attr_id", "occ", "field_id"))).alias("f"))
    totals = field_totals(docs).filter(wanted).join(fields, "field").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "n_tokens"))).alias("t"))
    rows = labelled(docs, lexicon).join(totals, "doc_id", "left").join(features, "doc_id", "left")
    each = F.transform(F.sequence(F.lit(0), F.lit(n_fields - 1)), lambda i: F.coalesce(F.try_element_at("t", i), F.lit(0)).cast("double").cast("string")) if n_fields else F.array().cast("array<string>")
    parts = F.transform(F.coalesce("f", F.array().cast(_FEATURES)), lambda x: F.concat_ws(":", x["attr_id"], x["occ"], x["field_id"]))
    return rows.select("doc_id", F.concat_ws("\t", F.lit("MultiFieldDocument"), F.coalesce("label_id", F.lit(0)).cast("string"), F.lit(str(n_fields)), each, parts).alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """The columns of `lines` but line, with kind, label_id, totals array<double>, features array<struct<attr_id, occ,
    field_id>>. Lines of another kind, of fewer than four parts, or with a part that is no number are left out.

    Plain lines of flat documents are parsed in arrays; all others, as expressions, by _parsed().
    """
    others = [c for c in lines.columns if c != "line"]
    given = lines.select(*others, "line")
    schema = StructType([*[StructField(f.name, f.dataType) for f in given.schema], *StructType.fromDDL(f"_label int, _total double, _features {_FEATURES}").fields])
    rows = given.mapInArrow(_plain, schema)
    return _parsed(rows, others)


#: A flat document as it is written; what has more digits may be no number of its type.
_PLAIN = r"^SimpleDocument\t[0-9]{1,9}\t[0-9]{1,9}\.[0-9](\t[0-9]{1,9}:[0-9]{1,9})+$"


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the label, total and features of plain lines, which go; other lines stay, with nulls."""
    kind = pa.list_(pa.struct([("attr_id", pa.int32()), ("occ", pa.int64()), ("field_id", pa.int32())]))
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            b = whole.slice(i, 1000)
            line = b.column(b.num_columns - 1)
            plain = pc.fill_null(pc.match_substring_regex(line, _PLAIN), False)
            found = line.filter(plain)
            n = pc.count_substring(found, ":").to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = pc.list_flatten(pc.split_pattern_regex(found, "[\t:]"))
            begin = 3 + 2 * n
            ends = np.cumsum(begin)
            at = np.ones(len(numbers), bool)
            head = ends - begin
            at[head] = at[head + 1] = at[head + 2] = False
            pairs = numbers.filter(pa.array(at)).cast(pa.int64())
            pairs = pairs.to_numpy(zero_copy_only=False).reshape(-1, 2)
            flat = pa.StructArray.from_arrays([pa.array(pairs[:, 0], pa.int32()), pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(pairs), pa.int32())], names=["attr_id", "occ", "field_id"])
            features = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), flat)
            is_plain = plain.to_numpy(zero_copy_only=False)
            place = pa.array(np.where(is_plain, np.cumsum(is_plain) - 1, 0), mask=~is_plain)
            new = [numbers.take(pa.array(head + 1)).cast(pa.int32()), numbers.take(pa.array(head + 2)).cast(pa.float64()), features.cast(kind)]
            rest = line.take(pa.array(np.arange(b.num_rows), mask=is_plain))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], rest, *[x.take(place) for x in new]], names=[*b.schema.names, "_label", "_total", "_features"])


def _parsed(rows: DataFrame, others: list[str]) -> DataFrame:
    p = F.split("line", "\t")
    plain = F.col("_features").isNotNull()
    simple = p[0] == "SimpleDocument"
    fields = F.when(simple, 1).otherwise(F.expr("try_cast(split(line, '\t')[2] as int)"))
    first = F.when(simple, 2).otherwise(3)
    rows = rows.withColumns({"_p": p, "_n": fields, "_first": first})
    rows = rows.filter(plain | (F.col("_p")[0].isin("SimpleDocument", "MultiFieldDocument") & (F.size("_p") >= 4) & (F.col("_n") >= 0)))
    rows = rows.filter(plain | (F.size("_p") >= F.col("_first") + F.col("_n")))
    odd = lambda plainly, otherwise: F.when(plain, plainly).otherwise(F.expr(otherwise))
    parsed = rows.select(
        *others, odd(F.lit("SimpleDocument"), "_p[0]").alias("kind"), odd(F.col("_label"), "try_cast(_p[1] as int)").alias("label_id"),
        odd(F.array("_total"), "transform(slice(_p, _first + 1, _n), x -> try_cast(x as double))").alias("totals"),
        odd(F.col("_features"), f"""cast(transform(slice(_p, _first + _n + 1, size(_p)), x -> struct(try_cast(get(split(x, ':'), 0) as int) as attr_id,
            try_cast(get(split(x, ':'), 1) as bigint) as occ, try_cast(get(split(x, ':'), 2) as int) as field_id)) as {_FEATURES})""").alias("features"), plain.alias("_plain"),
    )
    whole = "label_id is not null and not exists(totals, x -> x is null) and not exists(features, x -> x.attr_id is null or x.occ is null)"
    return parsed.filter(f"_plain or ({whole})").filter("_plain or kind = 'SimpleDocument' or not exists(features, x -> x.field_id is null)").drop("_plain")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a raw corpus file or folder."""
    return parse_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Only the rendered lines, as text files."""
    lines.select(F.col("line").alias("value")).write.mode(mode).text(path)


def append_raw(lines: DataFrame, path: str) -> int:
    """Append rendered documents to a raw corpus, whose lines are all read first; the number of documents in it after.
    A corpus of which no line is a document is not one, and is left alone."""
    spark, before = lines.sparkSession, 0
    if exists(spark, path):
        text = kept(spark.read.text(path), "raw")
        before = parse_lines(text.withColumnRenamed("value", "line")).count()
        if not before and not text.isEmpty():
            raise ValueError(f"not a raw corpus: {path}")
    lines = kept(lines.select("line"), "lines")
    write_lines(lines, path)
    return before + lines.count()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def kept_fields(parsed: DataFrame, keep: list[int], literal: bool = False) -> DataFrame:
    """Parsed multi-field documents with only some fields, by id: of the others the totals are 0 and features go. Flat
    documents stay. literal: as a search by place in the sorted list has it, where every field from the least id kept on
    passes."""
    wanted = lambda i: i >= min(keep) if literal else i.isin(keep)
    multi = F.col("kind") == "MultiFieldDocument"
    return parsed.withColumns({
        "totals": F.when(multi, F.transform("totals", lambda t, i: F.when(wanted(i), t).otherwise(0.0))).otherwise(F.col("totals")),
        "features": F.when(multi, F.filter("features", lambda x: wanted(x["field_id"]))).otherwise(F.col("features")),
    })


def render_lines(parsed: DataFrame) -> DataFrame:
    """The line of each parsed document."""
    multi = F.col("kind") == "MultiFieldDocument"
    totals = F.transform("totals", lambda t: t.cast("string"))
    size = F.when(multi, F.array(F.size("totals").cast("string"))).otherwise(F.array().cast("array<string>"))
    parts = F.transform("features", lambda x: F.when(multi, F.concat_ws(":", x["attr_id"], x["occ"], x["field_id"])).otherwise(F.concat_ws(":", x["attr_id"], x["occ"])))
    others = [c for c in parsed.columns if c not in ("kind", "label_id", "totals", "features")]
    return parsed.select(*others, F.concat_ws("\t", "kind", F.col("label_id").cast("string"), size, totals, parts).alias("line"))


def raw_vectors(parsed: DataFrame, lexicon: Lexicon, scheme: str | Scheme | None = None) -> DataFrame:
    """doc_id, attr_id, value of parsed documents (with a doc_id) under a lexicon; attributes that it lacks are left out.

    Flat documents take `scheme` or the lexicon's; multi-field ones the lexicon's, field by field, without zeros.
    """
    multi = F.col("kind") == "MultiFieldDocument"
    each = parsed.select("doc_id", "kind", "totals", F.explode("features").alias("f")).select("doc_id", "kind", "totals", "f.*")
    each = each.select("doc_id", "kind", "attr_id", "occ", "field_id", F.get("totals", F.when(multi, F.col("field_id")).otherwise(0)).alias("n_tokens"))
    each = each.join(lexicon.terms.select("attr_id", "df"), "attr_id")
    own = F.lit(lexicon.scheme.value)
    if lexicon.fields is not None and lexicon.field_schemes:
        each = each.join(lexicon.fields, "field_id", "left")
        for name, s in lexicon.field_schemes:
            own = F.when(F.col("field") == name, s.value).otherwise(own)
    n = F.lit(lexicon.doc_num)
    flat = weight(F.lit(Scheme.parse(scheme or lexicon.scheme).value), n, False)
    value = F.when(multi, weight(own, n, True)).otherwise(flat)
    return each.select("doc_id", "attr_id", value.alias("value"), multi.alias("_multi")).filter("not _multi or value <> 0").drop("_multi")


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("attr_id", "value"))).alias("f"))


def _with_features(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    return rows.join(_features(vectors), "doc_id", "left").withColumn("f", F.coalesce("f", F.array().cast("array<struct<attr_id:int,value:double>>")))


def svmlight_lines(vectors: DataFrame, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, line: label id, two blanks, id:value by id. Documents without features have none after the blanks."""
    return _svmlight(_joined(_with_features(labelled(docs, lexicon), vectors), ":", " "))


def _joined(rows: DataFrame, between: str, separator: str) -> DataFrame:
    return rows.withColumn("parts", F.when(F.size("f") > 0, F.array_join(F.transform("f", lambda x: F.concat_ws(between, x["attr_id"], x["value"])), separator)))


def packed_svmlight(rows: DataFrame) -> DataFrame:
    """svmlight_lines() of rows with doc_id, label_id, f."""
    return _svmlight(_joined(rows, ":", " "))


def _svmlight(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.concat(F.coalesce("label_id", F.lit(0)).cast("string"), F.lit("  "), F.coalesce("parts", F.lit(""))).alias("line"))


def arff_header(lexicon: Lexicon) -> DataFrame:
    """ord, line: the relation, the label values, and the attributes 1 to the largest id, of which gaps are named NULL."""
    spark = lexicon.terms.sparkSession
    labels = lexicon.labels.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label_id", "label"))), lambda x: x["label"]), ",").alias("x"))
    n = lexicon.terms.agg(F.max("attr_id")).first()[0] or 0
    names = spark.range(1, n + 1).select(F.col("id").cast("int").alias("attr_id")).join(lexicon.terms.select("attr_id", "token"), "attr_id", "left")
    shown = F.regexp_replace(F.replace(F.trim(F.regexp_replace(F.coalesce("token", F.lit("NULL")), r"\s+", " ")), F.lit('"'), F.lit("&quote;")), r"\\$", "")
    attributes = names.select((F.col("attr_id") + 3).cast("long").alias("ord"), F.concat(F.lit('@attribute "i_'), F.col("attr_id").cast("string"), F.lit("_"), shown, F.lit('"  NUMERIC')).alias("line"))
    fixed = spark.createDataFrame([(0, "@relation dataset"), (1, ""), (n + 4, ""), (n + 5, "@data")], "ord long, line string")
    named = labels.select(F.lit(2).cast("long").alias("ord"), F.concat(F.lit("@attribute label {"), "x", F.lit("}")).alias("line"))
    return fixed.unionAll(named).unionAll(attributes)


def arff_lines(vectors: DataFrame, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, line: a sparse row with the label in place 0."""
    return _arff(_joined(_with_features(labelled(docs, lexicon), vectors), " ", ", "))


def _arff(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.concat(F.lit("{"), F.concat_ws(", ", F.concat(F.lit("0 "), F.col("label")), "parts"), F.lit("}")).alias("line"))


def uci_lines(vectors: DataFrame, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, line: the label and the values of ids 1 to the largest, set apart by commas. The zeros between two
    features are one repeated string, so a line takes as long as it is."""
    n = lexicon.terms.agg(F.max("attr_id")).first()[0] or 0
    return _uci(_with_features(labelled(docs, lexicon), vectors.filter(F.col("attr_id") <= n)), n)


def _uci(rows: DataFrame, n: int) -> DataFrame:
    before = lambda i: F.coalesce(F.get("f", i - 1)["attr_id"], F.lit(0))
    values = F.transform("f", lambda x, i: F.concat(F.repeat(F.lit(",0.0"), x["attr_id"] - before(i) - 1), F.lit(","), x["value"].cast("string")))
    rest = F.repeat(F.lit(",0.0"), F.lit(n) - F.when(F.size("f") > 0, F.element_at("f", -1)["attr_id"]).otherwise(0))
    whole = F.concat(F.array_join(values, ""), rest)
    return rows.select("doc_id", F.when(F.col("label").isNull(), F.substring(whole, 2, 2**31 - 1)).otherwise(F.concat("label", whole)).alias("line"))


def vector_lines(vectors: DataFrame, docs: DataFrame, lexicon: Lexicon, format: str = "svmlight") -> DataFrame:
    """By name of the format, in any case: arff, uci, or else svmlight."""
    return {"arff": arff_lines, "uci": uci_lines}.get(format.lower(), svmlight_lines)(vectors, docs, lexicon)


def document_lines(docs: DataFrame, lexicon: Lexicon, scheme: str | None = None, format: str = "svmlight") -> DataFrame:
    """vector_lines() of flat documents under a lexicon; a row of docs is a document."""
    scheme, arff = Scheme.parse(scheme or lexicon.scheme).value, format.lower() == "arff"
    if format.lower() == "uci":
        return _uci(packed(docs, lexicon, scheme), lexicon.terms.agg(F.max("attr_id")).first()[0] or 0)
    between, separator = (" ", ", ") if arff else (":", " ")
    if scheme in ("boolean", "occurrences") and not lexicon.normalize:
        rows = _named(chunks.rendered(docs, lexicon.terms, between, separator, scheme), docs, lexicon)
    else:
        rows = _joined(packed(docs, lexicon, scheme), between, separator)
    return _arff(rows) if arff else _svmlight(rows)


def read_svmlight(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """label, features (0-based sparse vectors) of a file in this format."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", str(features)) if features else reader).load(path)


def lexicon_lines(lexicon: Lexicon, scores: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """token, line: term, id, document frequency and, if given, weight (terms of weight 0 or none are left out) and score
    (-1 for terms without one). scores: attr_id, score; weights: attr_id, weight."""
    t = lexicon.terms
    extra: list[Column] = []
    if weights is not None:
        t = t.join(weights.filter("weight <> 0").select("attr_id", F.col("weight").alias("_weight")), "attr_id")
        extra.append(F.col("_weight").cast("string"))
    if scores is not None:
        t = t.join(scores.select("attr_id", F.col("score").alias("_score")), "attr_id", "left")
        extra.append(F.coalesce("_score", F.lit(-1.0)).cast("string"))
    return t.select("token", F.concat_ws("\t", "token", F.col("attr_id").cast("string"), F.col("df").cast("string"), *extra).alias("line"))


def lexicon_header(lexicon: Lexicon) -> DataFrame:
    """ord, line: documents, scheme, whether vectors are normalised, classifier, labels, fields with their own schemes;
    each label and field has a blank after it, so names with blanks cannot be told apart (save_lexicon() keeps them)."""
    spark = lexicon.terms.sparkSession
    listed = lambda t, by, of: t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, of.alias("x")))), lambda x: F.concat(x["x"], F.lit(" "))), "").alias("line"))
    none = spark.createDataFrame([("",)], "line string")
    own = F.lit("")
    for name, s in lexicon.field_schemes:
        own = F.when(F.col("field") == name, ":" + s.name).otherwise(own)
    labels = none if lexicon.labels is None else listed(lexicon.labels, "label_id", F.col("label"))
    fields = none if lexicon.fields is None else listed(lexicon.fields, "field_id", F.concat("field", own))
    first = [(0, str(lexicon.doc_num)), (1, lexicon.scheme.value), (2, str(lexicon.normalize).lower()), (3, lexicon.classifier)]
    at = lambda t, k: t.select(F.lit(k).cast("long").alias("ord"), "line")
    return spark.createDataFrame(first, "ord long, line string").unionAll(at(labels, 4)).unionAll(at(fields, 5))


def write_lexicon_text(lexicon: Lexicon, path: str, scores: DataFrame | None = None, weights: DataFrame | None = None) -> None:
    """The header and the terms in order, as text files that are one lexicon file if put together by name."""
    terms = lexicon_lines(lexicon, scores, weights).select(F.lit(6).cast("long").alias("ord"), "token", "line")
    header = lexicon_header(lexicon).select("ord", F.lit("").alias("token"), "line")
    header.unionAll(terms).orderBy("ord", "token").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """Of a text file, or of the first file by name of a folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", ".")))
        at = jvm.org.apache.hadoop.fs.Path(at, names[0])
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
    try:
        return [reader.readLine() or "" for _ in range(n)]
    finally:
        reader.close()


def read_lexicon_text(spark: SparkSession, path: str) -> Lexicon:
    """A lexicon file or folder: six header lines, then term, id, document frequency; further columns are ignored."""
    documents, scheme, normal, classifier, labels, fields = _first_lines(spark, path, 6)
    p = F.split("value", "\t")
    terms = spark.read.text(path).filter(F.size(p) >= 3).select(p[0].alias("token"), p[1].cast("int").alias("attr_id"), p[2].cast("bigint").alias("df"))
    label_rows = [(x, i) for i, x in enumerate(labels.split(" ")[:-1])]
    field_rows = [(x.split(":")[0], i) for i, x in enumerate(fields.split(" ")) if x]
    own = tuple((x.split(":")[0], Scheme.parse(x.split(":")[1])) for x in fields.split(" ") if ":" in x)
    table = lambda rows, schema: spark.createDataFrame(rows, schema) if rows else None
    return Lexicon(terms, table(label_rows, "label string, label_id int"), table(field_rows, "field string, field_id int"), int(documents), Scheme.parse(scheme), own, normal.lower() == "true", classifier)


def save_lexicon(lexicon: Lexicon, path: str) -> None:
    """As Parquet tables, which keep any label and field name whole."""
    lexicon.terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark = lexicon.terms.sparkSession
    for name, t in (("labels", lexicon.labels), ("fields", lexicon.fields)):
        if t is not None:
            t.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = [(lexicon.doc_num, lexicon.scheme.value, lexicon.normalize, lexicon.classifier, {k: v.value for k, v in lexicon.field_schemes}, lexicon.labels is not None, lexicon.fields is not None)]
    spark.createDataFrame(meta, "doc_num bigint, scheme string, normalize boolean, classifier string, field_schemes map<string,string>, labels boolean, fields boolean").write.mode("overwrite").parquet(f"{path}/meta")


def load_lexicon(spark: SparkSession, path: str) -> Lexicon:
    m = spark.read.parquet(f"{path}/meta").first()
    get = lambda name: spark.read.parquet(f"{path}/{name}") if m[name] else None
    own = tuple((k, Scheme.parse(v)) for k, v in m["field_schemes"].items())
    return Lexicon(spark.read.parquet(f"{path}/terms"), get("labels"), get("fields"), m["doc_num"], Scheme.parse(m["scheme"]), own, m["normalize"], m["classifier"])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of a file, or of the files of a folder whose names end in txt."""
    return spark.read.option("pathGlobFilter", "*txt").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_line_corpus(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """label, text: a document a line, with one label for each file."""
    parts = [spark.read.text(path).select(F.lit(label).alias("label"), F.col("value").alias("text")) for label, path in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpack(archive: str, folder: str) -> str:
    """Unpack a zipped model; entries that lead out of the folder are refused."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"entry leads out of the folder: {name}")
        z.extractall(root)
    tops = {Path(n).parts[0] for n in zipfile.ZipFile(archive).namelist() if Path(n).parts}
    return str(root / tops.pop()) if len(tops) == 1 else str(root)


def fresh_folder() -> str:
    """A folder on the driver's machine, for what only the driver reads; it goes when the driver ends."""
    path = tempfile.mkdtemp(prefix="lexiweave-model-")
    atexit.register(shutil.rmtree, path, True)
    return path


@dataclass(frozen=True)
class Options:
    """How a raw corpus is vectorised again: with the top_n terms by log-likelihood ratio, or, if top_n is negative,
    with those that min_df to max_df documents have."""

    scheme: str = "tfidf"
    top_n: int = -1
    min_df: int = 1
    max_df: int | None = None
    compact: bool = False
    format: str = "svmlight"
    vectors: str | None = None
    lexicon: str | None = None

    #: Names of properties files, and the fields that they set.
    NAMES = {
        "classification_weight_scheme": "scheme", "keepNBestAttributes": "top_n", "classification_minFreq": "min_df", "classification_maxFreq": "max_df",
        "compact.attribute.nums": "compact", "format": "format", "vector_location": "vectors", "new_lexicon_file": "lexicon",
    }

    @classmethod
    def of(cls, text: str) -> Options:
        """From lines `name = value` or `name: value`, by either name; lines that begin with # or ! are comments."""
        given: dict = {}
        for line in map(str.strip, text.splitlines()):
            cut = min((i for i in (line.find("="), line.find(":")) if i > 0), default=0)
            name = line[:cut].strip()
            name = cls.NAMES.get(name, name)
            if not cut or line[0] in "#!" or name not in cls.__dataclass_fields__:
                continue
            value = line[cut + 1 :].strip()
            given[name] = value.lower() == "true" if name == "compact" else int(value) if name in ("top_n", "min_df", "max_df") else value
        return cls(**given)


def revectorized(parsed: DataFrame, lexicon: Lexicon, options: Options) -> tuple[DataFrame, Lexicon]:
    """(doc_id, line of every parsed document; the lexicon as selected)."""
    lexicon = replace(lexicon, scheme=Scheme.parse(options.scheme))
    labels = lexicon.labels if lexicon.labels is not None else parsed.select(F.col("label_id").cast("string").alias("label"), "label_id").distinct()
    if options.top_n > 0:
        scores = scorers.log_likelihood(raw_vectors(parsed, lexicon), parsed.select("doc_id", F.col("label_id").cast("string").alias("label")))
        lexicon = lexicon.restricted(scorers.select_best(lexicon.terms, scores, options.top_n))
    else:
        lexicon = lexicon.pruned(options.min_df, options.max_df)
    ids = lexicon.terms.select("token", F.col("attr_id").alias("term"), "attr_id", "df")
    if options.compact:
        ids = kept(ids.drop("attr_id").join(compact(lexicon.terms).select("token", F.col("new_id").alias("attr_id")), "token"), "ids")
        lexicon = replace(lexicon, terms=ids.select("token", "attr_id", "df"))
    own = dict(lexicon.field_schemes)
    fields = {r["field_id"]: own[r["field"]].value for r in lexicon.fields.filter(F.col("field").isin(list(own))).collect()} if lexicon.fields is not None and own else {}
    rows = chunks.parsed_features(parsed, ids, lexicon.scheme.value, lexicon.scheme.value, fields, lexicon.doc_num)
    rows = rows.join(F.broadcast(labels), "label_id", "left").withColumn("label", normalize_label(F.col("label")))
    if options.format.lower() == "uci":
        return _uci(rows, lexicon.terms.agg(F.max("attr_id")).first()[0] or 0), lexicon
    return _arff(_joined(rows, " ", ", ")) if options.format.lower() == "arff" else packed_svmlight(rows), lexicon


def revectorize(spark: SparkSession, raw: str, lexicon: str, options: Options) -> None:
    """From a raw corpus and a lexicon file to vectors at options.vectors and the selected lexicon at options.lexicon."""
    if not options.vectors:
        raise ValueError("where the vectors go must be given")
    parsed = kept(read_raw(spark, raw).withColumn("doc_id", F.monotonically_increasing_id()), "parsed")
    lines, new = revectorized(parsed, read_lexicon_text(spark, lexicon), options)
    if options.lexicon:
        write_lexicon_text(new, options.lexicon)
    if options.format.lower() == "arff":
        body = lines.select(F.lit(2**40).alias("ord"), "doc_id", "line")
        lines = arff_header(new).select("ord", F.lit(0).cast("long").alias("doc_id"), "line").unionAll(body).orderBy("ord", "doc_id")
    write_lines(lines, options.vectors, "overwrite")
