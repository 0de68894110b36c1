"""The learner and the classifier as an Estimator and a Model, for use in pipelines of pyspark.ml."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.session import kept
from lexiweave.operators.models import Classifier, Learner


class _Shared(Params):
    idCol = Param(Params._dummy(), "idCol", "column that tells documents apart and orders them", TypeConverters.toString)
    tokensCol = Param(Params._dummy(), "tokensCol", "column of tokens, array<string>, or of fields, array<struct<name, tokens>>", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of the predicted label", TypeConverters.toString)
    scoresCol = Param(Params._dummy(), "scoresCol", "column of the decision values, by label", TypeConverters.toString)

    def _documents(self, df: DataFrame, *others) -> DataFrame:
        c = self.getOrDefault("tokensCol")
        name = "fields" if "struct" in dict(df.dtypes)[c] else "tokens"
        return df.select(F.col(self.getOrDefault("idCol")).alias("doc_id"), F.col(c).alias(name), *others)


class TextLearner(Estimator, _Shared):
    """Fits a Learner; see there for kind, scheme, cost, topN, minDf and iterations."""

    labelCol = Param(Params._dummy(), "labelCol", "column of labels", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "kind of classifier", TypeConverters.toString)
    scheme = Param(Params._dummy(), "scheme", "weighting scheme", TypeConverters.toString)
    cost = Param(Params._dummy(), "cost", "cost of the penalised loss", TypeConverters.toFloat)
    topN = Param(Params._dummy(), "topN", "terms kept by score, all if negative", TypeConverters.toInt)
    minDf = Param(Params._dummy(), "minDf", "documents that a term must occur in", TypeConverters.toInt)
    iterations = Param(Params._dummy(), "iterations", "iterations of the trainer", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, idCol="doc_id", tokensCol="tokens", labelCol="label", predictionCol="predicted", scoresCol="scores", kind="svc", scheme="tfidf", cost=1.0, topN=-1, minDf=1, iterations=20):
        super().__init__()
        self._setDefault(idCol="doc_id", tokensCol="tokens", labelCol="label", predictionCol="predicted", scoresCol="scores", kind="svc", scheme="tfidf", cost=1.0, topN=-1, minDf=1, iterations=20)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TextModel:
        get = self.getOrDefault
        docs = self._documents(dataset, F.col(get("labelCol")).alias("label"))
        learner = Learner(get("kind"), get("scheme"), get("cost"), get("topN"), get("minDf"), get("iterations"))
        return self._copyValues(TextModel(learner.fit(docs)))


class TextModel(Model, _Shared):
    """Adds the predicted label and the decision values to documents; rows that repeat an id each get theirs."""

    def __init__(self, classifier: Classifier | None = None):
        super().__init__()
        self._setDefault(idCol="doc_id", tokensCol="tokens", predictionCol="predicted", scoresCol="scores")
        self.classifier = classifier

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        docs = kept(self._documents(dataset).dropDuplicates(["doc_id"]), "documents")
        got = self.classifier.scores(docs).select(F.col("doc_id").alias(get("idCol")), F.col("predicted").alias(get("predictionCol")), F.col("scores").alias(get("scoresCol")))
        return dataset.join(got, get("idCol"), "left")

    def save(self, path: str) -> None:
        self.classifier.save(path)

    @classmethod
    def load(cls, spark, path: str) -> TextModel:
        return cls(Classifier.load(spark, path))
