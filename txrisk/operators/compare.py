"""Comparison of models and of evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.scalars import ratio

# Compared metrics and overall weights.
RANKED_METRICS = ["pr_auc", "roc_auc", "f1_score", "precision", "recall"]
WEIGHTS = {"pr_auc": 0.3, "f1_score": 0.3, "precision": 0.2, "recall": 0.2}
COMPARED = [
    "accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc", "fraud_detection_rate",
    "false_positive_rate", "customer_friction_rate",
]
DATASET_STATS = {
    "train_samples": "Train Samples", "test_samples": "Test Samples",
    "train_fraud_rate": "Train Fraud Rate", "test_fraud_rate": "Test Fraud Rate",
}


def metric_rows(results: DataFrame, metrics=RANKED_METRICS) -> DataFrame:
    """One row per model → (model, metric, value)."""
    return results.select("model", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["model"], list(metrics), "metric", "value"
    )


def rank_models(results: DataFrame) -> DataFrame:
    """Rank per metric, weighted overall score over the metrics present, and overall rank."""
    rows = metric_rows(results)
    weight = F.lit(None).cast("double")
    for m, w in WEIGHTS.items():
        weight = F.when(F.col("metric") == m, w).otherwise(weight)
    known = F.when(F.col("value").isNotNull(), weight)
    overall = rows.groupBy("model").agg(ratio(F.sum(F.col("value") * known), F.sum(known)).alias("value"))
    both = rows.unionByName(overall.withColumn("metric", F.lit("overall")))
    order = Window.partitionBy("metric").orderBy(F.col("value").desc())
    return both.filter("value IS NOT NULL").withColumn("metric_rank", F.rank().over(order))


def _percent_change(a: Column, b: Column) -> Column:
    return F.when(a != 0, (b - a) / a * 100).when(b == 0, 0.0).otherwise(F.lit(float("inf")))


def compare_results(imbalanced: DataFrame, balanced: DataFrame) -> DataFrame:
    """Side-by-side values, difference and percent change of two one-row results."""
    names = [*COMPARED, *DATASET_STATS]

    def long(result: DataFrame, value: str) -> DataFrame:
        wide = result.select(
            *[(F.col(m) if m in result.columns else F.lit(0.0)).cast("double").alias(m) for m in names]
        )
        return wide.unpivot([], names, "metric_name", value)

    both = long(imbalanced, "imbalanced_value").join(long(balanced, "balanced_value"), "metric_name", "full_outer")
    a, b = F.coalesce("imbalanced_value", F.lit(0.0)), F.coalesce("balanced_value", F.lit(0.0))
    shown = F.col("metric_name")
    for key, title in DATASET_STATS.items():
        shown = F.when(F.col("metric_name") == key, title).otherwise(shown)
    return both.select(
        shown.alias("metric_name"),
        a.alias("imbalanced_value"),
        b.alias("balanced_value"),
        (b - a).alias("difference"),
        _percent_change(a, b).alias("percent_change"),
    )


def trade_offs(table: DataFrame) -> DataFrame:
    """One row of gains and losses from an E24 table."""

    def pick(metric: str, column: str) -> Column:
        return F.max(F.when(F.col("metric_name") == metric, F.col(column)))

    diff = {m: pick(m, "difference") for m in ("precision", "recall", "false_positive_rate", "f1_score")}
    train_a, train_b = pick("Train Samples", "imbalanced_value"), pick("Train Samples", "balanced_value")
    return table.agg(
        (diff["precision"] > 0).cast("int").alias("precision_improvement"),
        diff["precision"].alias("precision_change"),
        (diff["recall"] > 0).cast("int").alias("recall_improvement"),
        diff["recall"].alias("recall_change"),
        (diff["false_positive_rate"] < 0).cast("int").alias("lower_customer_friction"),
        diff["false_positive_rate"].alias("fpr_change"),
        (diff["f1_score"] > 0).cast("int").alias("f1_improvement"),
        diff["f1_score"].alias("f1_change"),
        F.when(train_a > 0, 1 - train_b / train_a).otherwise(0.0).alias("training_data_reduction"),
    )


def recommendations(changes: DataFrame) -> DataFrame:
    """Recommendation codes from an E25 row."""
    better_p, better_r = F.col("precision_improvement") == 1, F.col("recall_improvement") == 1
    entries = [
        F.when(F.col("f1_improvement") == 1, "prefer_balanced").otherwise("prefer_imbalanced"),
        F.when(better_p & better_r, "precision_and_recall_gain")
        .when(better_r, "more_fraud_caught_more_alarms")
        .when(better_p, "fewer_alarms_more_fraud_missed"),
        F.when(F.col("lower_customer_friction") == 1, "friction_reduced").otherwise("friction_not_reduced"),
        F.when(F.col("training_data_reduction") > 0.5, "training_cost_reduced"),
    ]
    return changes.select(F.posexplode(F.array_compact(F.array(*entries))).alias("position", "code"))


def interpretation(table: DataFrame) -> DataFrame:
    """One sentence per key metric with both values and the signed percent change."""
    titles = {
        "recall": "Recall", "precision": "Precision", "f1_score": "F1-Score",
        "false_positive_rate": "False positive rate",
    }
    title = F.lit(None).cast("string")
    for key, text in titles.items():
        title = F.when(F.col("metric_name") == key, text).otherwise(title)
    sentence = F.format_string(
        "%s: %.3f (imbalanced) vs %.3f (balanced) - Change: %+.1f%%",
        title, F.col("imbalanced_value"), F.col("balanced_value"), F.col("percent_change"),
    )
    return table.filter(F.col("metric_name").isin(*titles)).select("metric_name", sentence.alias("sentence"))


def metric_differences(table: DataFrame) -> DataFrame:
    """E27."""
    return table.select("metric_name", "difference")
