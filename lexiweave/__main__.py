"""Commands on corpora and models: python -m lexiweave COMMAND ..."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiweave.functions.stemmer import stem_text
from lexiweave.functions.text import tokenize
from lexiweave.operators import corpus, scorers
from lexiweave.operators.models import Classifier
from lexiweave.sources import corpus as src


def _numbered(spark: SparkSession, raw: str):
    return src.read_raw(spark, raw).withColumn("doc_id", F.monotonically_increasing_id())


def generate_vector(spark: SparkSession, a: argparse.Namespace) -> None:
    src.revectorize(spark, a.raw, a.lexicon, src.Options.of(Path(a.properties).read_text()))


def best_attributes(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every term with its score, the best first."""
    lexicon, parsed = src.read_lexicon_text(spark, a.lexicon), _numbered(spark, a.raw)
    parsed = src.kept(parsed, "parsed")
    scores = scorers.log_likelihood(src.raw_vectors(parsed, lexicon), parsed.select("doc_id", F.col("label_id").cast("string").alias("label")))
    named = scores.join(lexicon.terms, "attr_id").orderBy(F.desc("score"), "token")
    src.write_lines(named.select(F.concat_ws("\t", "token", F.col("score").cast("string")).alias("line")), a.out, "overwrite")


def filter_fields(spark: SparkSession, a: argparse.Namespace) -> None:
    src.write_lines(src.render_lines(src.kept_fields(src.read_raw(spark, a.raw), a.field, a.literal)), a.out, "overwrite")


def random_selection(spark: SparkSession, a: argparse.Namespace) -> None:
    """n lines of a file, and, unless not wanted, the others in another."""
    lines = src.kept(spark.read.text(a.raw).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("line")), "numbered")
    drawn = src.kept(corpus.sample(lines, a.n, a.seed), "drawn")
    src.write_lines(drawn, f"{a.raw}_{a.n}", "overwrite")
    if not a.no_test:
        src.write_lines(corpus.complement(lines, drawn), f"{a.raw}_{a.n}.test", "overwrite")


def compact_attributes(spark: SparkSession, a: argparse.Namespace) -> None:
    """A raw corpus and its lexicon under ids without gaps."""
    lexicon = src.read_lexicon_text(spark, a.lexicon)
    new = lexicon.compacted()
    ids = lexicon.terms.select("token", "attr_id").join(new.terms.select("token", F.col("attr_id").alias("new_id")), "token")
    parsed = src.kept(_numbered(spark, a.raw), "parsed")
    each = parsed.select("doc_id", F.explode("features").alias("f")).select("doc_id", "f.*").join(ids, "attr_id")
    features = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("new_id").alias("attr_id"), "occ", "field_id"))).alias("new"))
    rows = parsed.join(features, "doc_id", "left").withColumn("features", F.coalesce("new", F.filter("features", lambda x: F.lit(False)))).drop("new")
    src.write_lines(src.render_lines(rows), a.out, "overwrite")
    src.write_lexicon_text(new, a.new_lexicon)


def attribute_scores(spark: SparkSession, a: argparse.Namespace) -> None:
    """The weights of a linear model, all or the top ones of each label."""
    w = Classifier.load(spark, a.model).attribute_weights(a.top)
    order = ["label", *(["rank"] if a.top >= 0 else ["token"])]
    for r in w.orderBy(*order).toLocalIterator():
        print(r["token"], r["label"], r["score"], sep="\t")


def classify_text_file(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = src.kept(src.read_texts(spark, a.input).select(F.monotonically_increasing_id().alias("doc_id"), "path", tokenize(F.col("text")).alias("tokens")), "texts")
    out = Classifier.load(spark, a.model).scores(docs).join(docs.select("doc_id", "path"), "doc_id").orderBy("path")
    for r in out.toLocalIterator():
        print(f"{r['path']} classified as : {r['predicted']}")


def stem_files(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every word of the files stemmed, all other characters as they are."""
    src.write_lines(spark.read.text(a.input).select(stem_text(F.col("value")).alias("line")), a.out, "overwrite")


def unzip(spark: SparkSession, a: argparse.Namespace) -> None:
    print(src.unpack(a.archive, a.folder))


COMMANDS = {
    "generateVector": (generate_vector, ["raw", "lexicon", "properties"]), "bestAttributes": (best_attributes, ["raw", "lexicon", "out"]),
    "filterFields": (filter_fields, ["raw", "out"]), "randomSelection": (random_selection, ["raw"]), "compactAttributes": (compact_attributes, ["raw", "out", "lexicon", "new_lexicon"]),
    "getAttributeScores": (attribute_scores, ["model"]), "classifyTextFile": (classify_text_file, ["model", "input"]), "stem": (stem_files, ["input", "out"]), "unzip": (unzip, ["archive", "folder"]),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lexiweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (f, places) in COMMANDS.items():
        one = sub.add_parser(name, help=f.__doc__)
        for x in places:
            one.add_argument(x)
        if name == "filterFields":
            one.add_argument("field", type=int, nargs="+")
            one.add_argument("--literal", action="store_true", help="keep every field from the least one on")
        elif name == "randomSelection":
            one.add_argument("n", type=int)
            one.add_argument("--seed", type=int, default=7)
            one.add_argument("--no-test", action="store_true")
        elif name == "getAttributeScores":
            one.add_argument("top", type=int, nargs="?", default=-1)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command][0](spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
