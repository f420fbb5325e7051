"""Saved steps and models, grouped folds and held-out labels."""

import datetime as dt
import json
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ledgerline.operators import training as G

RULES = [("loan", [r"\blend"]), ("payroll", [r"\bpayroll\b"])]


@pytest.fixture(scope="module")
def ledger(spark):
    r = random.Random(8)
    rows = []
    for a in range(40):
        for label, every, amount, kind, text in (("payroll", 14, 1500, "CREDIT", "Acme Payroll"), ("loan", 30, 300, "DEBIT", "QuickLend payment"), ("food", 3, 20, "DEBIT", "Grocer")):
            for k in range(r.randrange(5, 9)):
                rows.append((f"a{a}", label + "_c", dt.date(2024, 1, 1) + dt.timedelta(every * k), amount * r.uniform(0.8, 1.2), kind, f"{text} {k}", label))
    return spark.createDataFrame(rows, "account string, cluster string, date date, amount double, type string, description string, label string")


def steps():
    return Pipeline(stages=[G.CleanText(inputCol="description", outputCol="clean"), G.RuleLabels(inputCol="clean", outputCol="ruled", rules=json.dumps(RULES))])


def test_saved_steps_and_held_out_labels(spark, ledger, tmp_path):
    prepared = steps().fit(ledger)
    prepared.write().overwrite().save(f"file://{tmp_path}/steps")
    again = PipelineModel.load(f"file://{tmp_path}/steps")
    rows = prepared.transform(ledger)
    assert sorted(map(str, again.transform(ledger).collect())) == sorted(map(str, rows.collect()))
    assert {r.ruled for r in rows.select("ruled").distinct().collect()} == {"payroll", "loan", None}
    names = rows.groupBy("account", "cluster").agg(F.first("label").alias("label"))
    clusters = G.ClusterFeatures().transform(rows).join(names, ["account", "cluster"]).withColumn("fold", G.fold("account", 3)).cache()
    model = G.fit_labels(clusters.where("fold > 0"), trees=10, depth=4)
    held = clusters.where("fold = 0")
    right = held.join(G.predicted(model, held), ["account", "cluster"]).where("label = predicted").count()
    assert right >= 0.95 * held.count() > 0
    model.write().overwrite().save(f"file://{tmp_path}/model")
    loaded = PipelineModel.load(f"file://{tmp_path}/model")
    assert sorted(G.predicted(loaded, held).collect()) == sorted(G.predicted(model, held).collect())
    bare = rows.withColumn("label", F.when(F.col("label") != "food", F.col("label")))
    out = G.with_predictions(bare, model, clusters)
    assert out.count() == rows.count() and out.where("from_model and label <> 'food'").count() <= 0.05 * out.where("from_model").count()


def test_search_on_grouped_folds(ledger):
    clean = ledger.withColumn("clean", F.lower("description"))
    clusters = G.ClusterFeatures().transform(clean).withColumn("label", F.split("cluster", "_")[0])
    assert clusters.withColumn("fold", G.fold("account", 3)).groupBy("account").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    model, table = G.grouped_search(clusters, trees=(3,), depths=(1, 4), parallelism=2)
    scores = {(r.trees, r.depth): (r.f1, r.best) for r in table.collect()}
    assert set(scores) == {(3, 1), (3, 4)} and sum(b for _, b in scores.values()) == 1
    assert max(f for f, _ in scores.values()) > 0.9 and G.predicted(model, clusters).where("predicted = split(cluster, '_')[0]").count() > 0.9 * clusters.count()
