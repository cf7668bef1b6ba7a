"""Metric formulas and threshold picks against direct computation on small arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import compare, decision, impact, metrics


def table(spark, y, p):
    return spark.createDataFrame([(f"t{i}", int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                                 "transaction_id string, y int, p double")


def ranked_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def average_precision(y, p):
    total, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - before) * y[hit].mean()
        before = recall
    return total


def trapezoid(y, p):
    points = [(0.0, 1.0)] + [(y[p >= t].sum() / y.sum(), y[p >= t].mean()) for t in sorted(set(p), reverse=True)]
    return sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(points, points[1:]))


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(7)
    y = (rng.random(150) < 0.3).astype(int)
    return y, np.round(np.clip(0.4 * y + 0.6 * rng.random(150), 0, 1), 2)


def test_known_counts(spark):
    y = [1] * 7 + [0] * 3
    p = [0.9, 0.8, 0.7, 0.4, 0.3, 0.2, 0.1, 0.6, 0.2, 0.1]
    row = metrics.compact(table(spark, y, p), 0.5).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (3, 2, 1, 4)
    assert row["precision"] == pytest.approx(0.75) and row["recall"] == pytest.approx(3 / 7)
    assert row["accuracy"] == pytest.approx(0.5) and row["false_positive_rate"] == pytest.approx(1 / 3)
    assert row["f1_score"] == pytest.approx(2 * 0.75 * (3 / 7) / (0.75 + 3 / 7))


@pytest.mark.parametrize("y,p,expected", [
    ([0] * 5, [0.1, 0.2, 0.3, 0.9, 0.4], dict(precision=0, recall=0, f1_score=0, roc_auc=0, pr_auc=0, fp=1, tn=4)),
    ([1] * 5, [0.1, 0.6, 0.7, 0.9, 0.4], dict(precision=1, recall=0.6, roc_auc=0, false_positive_rate=0)),
    ([0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8], dict(precision=1, recall=1, f1_score=1, accuracy=1, roc_auc=1, pr_auc=1)),
    ([0, 1, 0, 1], [0.9, 0.9, 0.8, 0.8], dict(tn=0, false_positive_rate=1, recall=1)),
])
def test_edge_cases(spark, y, p, expected):
    row = metrics.compact(table(spark, y, p), 0.5).first()
    for name, value in expected.items():
        assert row[name] == pytest.approx(value), name


@pytest.mark.parametrize("seed", range(3))
def test_counts_sum_to_rows_and_rates_lie_in_range(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(50, 200))
    row = metrics.comprehensive(table(spark, rng.integers(0, 2, n), rng.random(n)), 0.5).first()
    assert row["tp"] + row["tn"] + row["fp"] + row["fn"] == n
    for c in ("precision", "recall", "f1_score", "roc_auc", "pr_auc", "specificity", "customer_friction_rate"):
        assert 0 <= row[c] <= 1


def test_areas_equal_brute_force(spark, arrays):
    y, p = arrays
    row = metrics.areas(metrics.curve(table(spark, y, p))).first()
    assert row["roc_auc"] == pytest.approx(ranked_auc(y, p))
    assert row["pr_auc"] == pytest.approx(average_precision(y, p))
    assert row["pr_auc_trapezoid"] == pytest.approx(trapezoid(y, p))


def test_sweep_equals_one_scan_per_threshold(spark, arrays):
    y, p = arrays
    rows = {r["threshold"]: r for r in metrics.sweep(table(spark, y, p), metrics.SEARCH).collect()}
    assert sorted(rows) == metrics.SEARCH
    for t, r in rows.items():
        hit = p >= t
        assert (r["tp"], r["fp"]) == (int(y[hit].sum()), int((1 - y[hit]).sum()))
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == len(y)


def test_weights_are_counts(spark, arrays):
    y, p = arrays
    df = table(spark, y, p).withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    doubled = table(spark, np.concatenate([y, y[y == 1]]), np.concatenate([p, p[y == 1]]))
    a, b = metrics.areas(metrics.curve(df, "w")).first(), metrics.areas(metrics.curve(doubled)).first()
    assert a["pr_auc"] == pytest.approx(b["pr_auc"]) and a["roc_auc"] == pytest.approx(b["roc_auc"])
    assert metrics.confusion(df, 0.5, "w").first()["tp"] == metrics.confusion(doubled, 0.5).first()["tp"]


def test_tuned_thresholds_take_the_first_of_equals(spark, arrays):
    y, p = arrays
    tuned = {r["strategy"]: r for r in metrics.tuned_thresholds(metrics.curve_points(table(spark, y, p))).collect()}
    cuts = sorted(set(p))
    precision = np.array([y[p >= t].mean() for t in cuts])
    recall = np.array([y[p >= t].sum() / y.sum() for t in cuts])
    fpr = np.array([(1 - y[p >= t]).sum() / (1 - y).sum() for t in cuts])
    f1 = 2 * precision * recall / (precision + recall + 1e-8)
    assert tuned["f1_optimal"]["threshold"] == cuts[int(np.argmax(f1))]
    j = (recall - fpr)[::-1]
    assert tuned["balanced"]["threshold"] == cuts[::-1][int(np.argmax(j))]
    keep = recall >= 0.9
    assert tuned["business_aggressive"]["threshold"] == np.array(cuts)[keep][int(np.argmax(precision[keep]))]


def test_constrained_search_falls_back(spark):
    nothing = metrics.search_imbalanced(table(spark, [0, 0, 1], [0.995, 0.999, 0.001])).first()
    assert nothing["constraints_met"] == 0 and nothing["threshold"] == pytest.approx(0.5)
    perfect = metrics.search_balanced(table(spark, [0, 1] * 10, [0.2, 0.8] * 10)).first()
    assert perfect["constraints_met"] == 0 and perfect["f1_score"] == 1 and perfect["threshold"] == pytest.approx(0.21)


def test_binned_curve_agrees_at_its_thresholds(spark, arrays):
    y, p = arrays
    for r in metrics.binned_points(table(spark, y, p), 10).collect():
        assert r["tp"] == int(y[p >= r["threshold"]].sum())


def test_levels_cover_all_rows(spark):
    p = [0.0, 0.29, 0.3, 0.69, 0.7, 1.0]
    rows = decision.level_counts(table(spark, [0] * 6, p)).collect()
    assert {r["risk_level"]: r["n_rows"] for r in rows} == {"low": 2, "medium": 2, "high": 2}


def test_unusable_probabilities_have_no_level(spark):
    df = table(spark, [0, 0, 0], [float("nan"), 1.2, -0.1])
    assert df.select(decision.risk_level(F.col("p")).alias("l")).filter("l IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        decision.require_probabilities(df)


def test_ranked_rows_and_head(spark):
    tx = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "transaction_id string, amount double")
    pred = spark.createDataFrame(
        [("a", 0.2, "low", 0), ("b", 0.9, "high", 1)],
        "transaction_id string, fraud_probability double, risk_level string, fraud_prediction int")
    rows = decision.ranked(tx, pred, ["transaction_id"]).collect()
    assert [r["transaction_id"] for r in rows] == ["b", "a", "c"]
    assert decision.ranked(tx, pred, ["transaction_id"], top=1).count() == 1


def test_infinite_percent_change(spark):
    a = spark.createDataFrame([(0.0, 0.5, 100.0)], "precision double, recall double, train_samples double")
    b = spark.createDataFrame([(0.4, 0.5, 40.0)], "precision double, recall double, train_samples double")
    rows = {r["metric_name"]: r for r in compare.compare_results(a, b).collect()}
    assert rows["precision"]["percent_change"] == float("inf") and rows["accuracy"]["percent_change"] == 0
    assert len(rows) == 13
    changes = compare.trade_offs(compare.compare_results(a, b)).first()
    assert changes["precision_improvement"] == 1 and changes["training_data_reduction"] == pytest.approx(0.6)
    assert compare.interpretation(compare.compare_results(a, b)).count() == 4


def test_missing_metric_renormalises_the_weights(spark):
    df = spark.createDataFrame(
        [("a", 0.5, 0.5, 0.8, None, 0.6), ("b", 0.4, 0.9, 0.7, 0.5, 0.5)],
        "model string, pr_auc double, roc_auc double, f1_score double, precision double, recall double")
    rows = {(r["model"], r["metric"]): r for r in compare.rank_models(df).collect()}
    assert rows[("a", "overall")]["value"] == pytest.approx((0.5 * 0.3 + 0.8 * 0.3 + 0.6 * 0.2) / 0.8)
    assert rows[("a", "overall")]["metric_rank"] == 1


def test_impact_without_detections(spark):
    counts = spark.createDataFrame([("s", 0.5, 0, 0, 3, 7)], "strategy string, threshold double, tp long, fp long, fn long, tn long")
    row = impact.unit_impact(counts).first()
    assert row["cost_per_fraud_detected"] is None and row["net_benefit"] == 0 and row["fraud_loss_value"] == 300
    assert impact.detailed_impact(counts).first()["roi_percentage"] == 0
