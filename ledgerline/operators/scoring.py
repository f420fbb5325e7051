"""Feature matrices, tree models, calibration, contributions and reasons."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import small

#: Steps of a quantile mapping.
STEPS = 1000


def pivoted(sources: DataFrame, key: str, values: list, amount: str = "monthly_income") -> DataFrame:
    """Counts and sums per account and value of ``key``, wide; the value list fixes the columns."""
    out = sources.groupBy("account").pivot(key, values).agg(F.count(amount).alias("count"), F.round(F.sum(amount), 4).alias("sum"))
    return out.na.fill(0)


def aligned(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns of a feature schema, cast; those missing are 0."""
    return rows.select("account", *[(F.coalesce(F.col(c), F.lit(0)) if c in rows.columns else F.lit(0)).cast(t).alias(c) for c, t in types.items()])


def grouped_split(rows: DataFrame, key: str, shares: tuple[float, ...] = (0.7, 0.15, 0.15)) -> Column:
    """Fold number of a row by the hash of its group, so that a group is never in two folds."""
    place = F.pmod(F.xxhash64(key), F.lit(10_000)) / 10_000
    out, reach = F.lit(len(shares) - 1), 1.0
    for k in reversed(range(len(shares) - 1)):
        reach = sum(shares[: k + 1])
        out = F.when(place < reach, k).otherwise(out)
    return out.cast("int")


def fit_trees(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 7) -> PipelineModel:
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def auc(model: PipelineModel, rows: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(rows))


def top_contributions(rows: DataFrame, n: int = 5) -> DataFrame:
    """(account, sign, rank, feature, contribution): the n largest of either sign, padded with nulls to n rows."""
    signed = rows.where("contribution <> 0").withColumn("sign", F.when(F.col("contribution") > 0, 1).otherwise(-1))
    order = Window.partitionBy("account", "sign").orderBy(F.desc(F.abs("contribution")), "feature")
    top = signed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    slots = rows.select("account").distinct().select("account", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")).select("account", "sign", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    return slots.join(top, ["account", "sign", "rank"], "left").select("account", "sign", "rank", "feature", "contribution")


def calibrated(scores: DataFrame, reference: DataFrame, target: DataFrame) -> DataFrame:
    """Quantile mapping: a score's share in the reference becomes the quantile of the target.

    The share counts reference scores at or below; the two distributions come as (score) tables and are
    summarised to STEPS + 1 quantiles by mergeable sketches, a bounded row that every task gets."""
    grid = [k / STEPS for k in range(STEPS + 1)]
    ref = reference.agg(F.percentile_approx("score", grid, 10_000).alias("ref"))
    tar = target.agg(F.percentile_approx("score", grid, 10_000).alias("tar"))
    rows = scores.join(F.broadcast(ref)).join(F.broadcast(tar))  # one row each
    place = F.greatest(F.size(F.filter("ref", lambda q: q <= F.col("score"))) - 1, F.lit(0))
    return rows.select(*scores.columns, F.get("tar", place).alias("calibrated"))


def distinct_reasons(rows: DataFrame, suppressed: dict[str, str] | None = None) -> DataFrame:
    """An account's distinct reasons, sorted and joined; a reason goes where the one that covers it stands."""
    sets = rows.groupBy("account").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    left = F.col("reasons")
    for reason, cover in (suppressed or {}).items():
        left = F.when(F.array_contains("reasons", cover), F.array_remove(left, reason)).otherwise(left)
    return sets.select("account", F.array_join(left, "|").alias("reasons"))


def range_text(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """Texts of open intervals: ``ranges`` (feature, low, high, text) joins by feature and low < value < high."""
    r = small(ranges.withColumnRenamed("feature", "_f"))
    return values.join(r, (F.col("feature") == F.col("_f")) & (F.col("value") > F.col("low")) & (F.col("value") < F.col("high"))).drop("_f", "low", "high")


def alerts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(account, alerts): names of the rules that hold, in the order given, joined."""
    hit = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    return rows.select("account", F.array_join(hit, "|").alias("alerts"))
