"""Classifiers beside the risk model, the two-model comparison and the report."""

import pytest
from pyspark.sql import functions as F

from txrisk.ml import boosting, forest
from txrisk.operators import metrics
from txrisk.plans import evaluation
from txrisk.schema import EVALUATION
from txrisk.sources import tables


@pytest.fixture(scope="module")
def rows(spark, sf):
    k = F.expr("cast(substring(receiver_account, 2) AS int)")
    error = (F.col("transaction_type") == "error").cast("int")
    return tables.transactions(spark, sf).select("*", k.alias("k"), error.alias("error"))


def test_random_forest_learns_the_rule(rows):
    model = boosting.fit_random_forest(rows, ["k", "error", "amount"], trees=10, depth=6)
    scored = boosting.as_scored(boosting.predict(model, rows))
    assert scored.count() == 1000
    assert metrics.areas(metrics.curve(scored)).first()["roc_auc"] > 0.95


def test_cross_validation_scores_every_fold(rows):
    row = boosting.cross_validate(rows, ["k", "error"], folds=2, rounds=3).first()
    assert row["n_folds"] == 2 and 0.9 < row["min_score"] <= row["mean_score"] <= row["max_score"] <= 1


def test_dual_evaluation_compares_both_models(spark, sf):
    small = forest.ForestSettings(hidden=8, trees=5, sample=32)
    out = evaluation.dual_evaluation(tables.transactions(spark, sf), rounds=3, minimum=1, forest=small)
    results = {r["dataset_type"]: r for r in out.results.collect()}
    assert out.results.columns == EVALUATION.names and set(results) == {"imbalanced", "balanced"}
    assert results["imbalanced"]["train_samples"] == 800 and results["imbalanced"]["test_samples"] == 200
    for r in results.values():
        cells = ("true_positives", "true_negatives", "false_positives", "false_negatives")
        assert sum(r[c] for c in cells) == r["test_samples"]
        assert r["training_time"] > 0 and r["evaluation_time"] > 0
    assert results["balanced"]["train_fraud_rate"] == pytest.approx(0.5, abs=0.02)
    table = {r["metric_name"]: r for r in out.comparison.collect()}
    assert len(table) == 13 and table["recall"]["balanced_value"] == pytest.approx(results["balanced"]["recall"])
    assert out.recommendations.count() >= 2


def test_report_holds_all_parts(spark, sf):
    row = evaluation.performance_report(tables.scored(spark, sf)).first()
    assert len(row["thresholds"]) == 17 and len(row["benchmarks"]) == 4
    assert [t["threshold"] for t in row["thresholds"]] == metrics.SWEEP
    assert "f1_optimal" in {p["strategy"] for p in row["operating_points"]}
    assert row["metrics"]["tp"] + row["metrics"]["fn"] == row["metrics"]["total_fraud"]
