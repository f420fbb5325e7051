"""Training and applying label models: steps that are saved with a pipeline, features of clusters, a multiclass model
with class weights, and a search over settings on grouped folds."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .clusters import interval_bin
from .lookup import small

#: Features of a cluster, in the order of the vector.
FEATURES = ["n", "mean_amount", "spread", "least", "most", "credits", "days", "mean_gap", "n_words"]


class CleanText(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The cleaners as a step of a pipeline; null texts are empty."""

    @keyword_only
    def __init__(self, *, inputCol: str = "description", outputCol: str = "clean"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        said = F.coalesce(F.col(self.getInputCol()), F.lit(""))
        return dataset.withColumn(self.getOutputCol(), T.clean_for_clusters(T.clean_for_ngrams(said)))


class RuleLabels(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The first rule whose pattern a text matches, as a step; rules are saved as JSON with it."""

    rules = Param(Params._dummy(), "rules", "JSON list of [label, [pattern, ...]]", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "clean", outputCol: str = "ruled", rules: str = "[]"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, rules=rules)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rules = [(label, patterns) for label, patterns in json.loads(self.getOrDefault(self.rules))]
        return dataset.withColumn(self.getOutputCol(), T.regex_label(F.col(self.getInputCol()), rules) if rules else F.lit(None).cast("string"))


class ClusterFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Rows (account, cluster, date, amount, type, clean) to a row per cluster with FEATURES and ``gap_bin``; one
    aggregation.  A cluster of one day has gap 0."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        days = F.datediff(F.max("date"), F.min("date"))
        n_days = F.count_distinct("date")
        gap = F.when(n_days > 1, days / (n_days - 1)).otherwise(F.lit(0.0))
        out = dataset.groupBy("account", "cluster").agg(
            F.count("*").cast("double").alias("n"), F.avg("amount").alias("mean_amount"), F.coalesce(F.stddev_pop("amount"), F.lit(0.0)).alias("spread"), F.min("amount").alias("least"), F.max("amount").alias("most"),
            F.avg((F.col("type") == "CREDIT").cast("double")).alias("credits"), days.cast("double").alias("days"), gap.alias("mean_gap"), F.avg(F.size(F.split("clean", " "))).alias("n_words"),
        )
        return out.na.fill(0.0, FEATURES).withColumn("gap_bin", interval_bin(F.round("mean_gap").cast("int")))


def weighted(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with a label, and ``weight``, under which every label counts the same."""
    known = rows.where(F.col(label).isNotNull())
    counts = known.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("t"), F.count("*").alias("k")).first()
    return known.join(small(counts), label).withColumn("weight", F.lit(float(total["t"] or 0)) / (F.lit(float(total["k"] or 1)) * F.col("_n"))).drop("_n")


def label_stages(label: str = "label", trees: int = 30, depth: int = 6, seed: int = 7) -> list:
    """Index labels (most frequent first, ties by name), gather features, a forest over all labels."""
    return [
        StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep", stringOrderType="frequencyDesc"),
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        RandomForestClassifier(labelCol="label_index", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed),
    ]


def fit_labels(clusters: DataFrame, label: str = "label", **settings) -> PipelineModel:
    """A multiclass model of cluster labels; ``clusters``: FEATURES and ``label`` (null rows are not used)."""
    model = Pipeline(stages=label_stages(label, **settings)).fit(weighted(clusters, label))
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*model.stages[0].labels, "other"])
    return PipelineModel([*model.stages[1:], names])


def predicted(model: PipelineModel, clusters: DataFrame) -> DataFrame:
    """(account, cluster, predicted)."""
    return model.transform(clusters).select("account", "cluster", "predicted")


def with_predictions(rows: DataFrame, model: PipelineModel, clusters: DataFrame) -> DataFrame:
    """Rows without a label take that of their cluster; ``from_model`` says so."""
    out = rows.join(predicted(model, clusters), ["account", "cluster"], "left")
    return out.withColumn("from_model", F.col("label").isNull() & F.col("predicted").isNotNull()).withColumn("label", F.coalesce("label", "predicted")).drop("predicted")


def fold(group: str, folds: int):
    """Fold of a row by the hash of its group: no group is in two folds."""
    return F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")


def grouped_search(clusters: DataFrame, group: str = "account", label: str = "label", folds: int = 3, trees: tuple[int, ...] = (10, 30), depths: tuple[int, ...] = (3, 6), parallelism: int = 4, seed: int = 7) -> tuple[PipelineModel, DataFrame]:
    """The best model by mean F measure over grouped folds, and a table (trees, depth, f1, best) of all settings."""
    rows = weighted(clusters, label).withColumn("fold", fold(group, folds))
    index, assembler, forest = label_stages(label, seed=seed)
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).build()
    judge = MulticlassClassificationEvaluator(labelCol="label_index", metricName="f1")
    # labels are indexed once, so that a fold without one of them has the same numbers
    indexed = index.fit(rows)
    search = CrossValidator(estimator=Pipeline(stages=[assembler, forest]), estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(indexed.transform(rows))
    scores = [float(x) for x in search.avgMetrics]
    best = scores.index(max(scores))
    table = clusters.sparkSession.createDataFrame([(p[forest.numTrees], p[forest.maxDepth], s, k == best) for k, (p, s) in enumerate(zip(grid, scores))], "trees int, depth int, f1 double, best boolean")
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*indexed.labels, "other"])
    return PipelineModel([*search.bestModel.stages, names]), table
