"""Decisions and risk levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.operators.skew import attach
from txrisk.operators.statistics import quantiles
from txrisk.schema import ALTERNATIVE_BANDS, HIGH_RISK, LOW_RISK


def risk_level(p: Column, low: float | Column = LOW_RISK, high: float | Column = HIGH_RISK) -> Column:
    """Below low → low, at or above high → high, else medium; NULL for an unusable p."""
    usable = p.isNotNull() & ~F.isnan(p) & p.between(0, 1)
    return F.when(usable, F.when(p < low, "low").when(p >= high, "high").otherwise("medium"))


def require_probabilities(scored: DataFrame, column: str = "p") -> DataFrame:
    """R1 strict: fail when a probability is missing, NaN or outside [0, 1]."""
    if scored.filter(risk_level(F.col(column)).isNull()).limit(1).count():
        raise ValueError(f"{column} holds values outside [0, 1]")
    return scored


def decision(p: Column, threshold: float = 0.5) -> Column:
    """R2."""
    return (p >= threshold).cast("int")


def explanation(p: Column, level: Column, anomaly: Column) -> Column:
    """One sentence per row. The sentences are fixed values."""
    high_unusual = F.format_string(
        "High fraud risk (probability: %.2f) due to unusual transaction patterns (anomaly score: %.2f)", p, anomaly
    )
    return (
        F.when((level == "high") & (anomaly > 0.7), high_unusual)
        .when(level == "high", F.format_string("High fraud risk (probability: %.2f) based on learned fraud patterns", p))
        .when(
            level == "medium",
            F.format_string("Medium fraud risk (probability: %.2f) - requires additional verification", p),
        )
        .otherwise(F.format_string("Low fraud risk (probability: %.2f) - transaction appears legitimate", p))
    )


PERCENTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def risk_summary(scored: DataFrame) -> DataFrame:
    """Range, mean, population deviation and exact percentiles of the scores."""
    cuts = quantiles(scored, {"p": list(PERCENTILES.values())})["p"]
    return scored.agg(
        F.count("*").alias("n_rows"),
        F.min("p").alias("min_p"),
        F.max("p").alias("max_p"),
        F.avg("p").alias("mean_p"),
        F.stddev_pop("p").alias("std_p"),
        *[F.max(F.lit(v)).alias(name) for name, v in zip(PERCENTILES, cuts)],
    )


def level_summary(scored: DataFrame) -> DataFrame:
    """Count, share, range, mean and exact median of the scores per level."""
    levels = scored.withColumn("risk_level", risk_level(F.col("p")))
    per_level = levels.select(
        *[F.when(F.col("risk_level") == v, F.col("p")).alias(v) for v in ("low", "medium", "high")]
    )
    medians = quantiles(per_level, {v: [0.5] for v in ("low", "medium", "high")})
    median = F.lit(None).cast("double")
    for v, m in medians.items():
        median = F.when(F.col("risk_level") == v, F.lit(m[0])).otherwise(median)
    total = scored.agg(F.count("*")).scalar()
    return levels.groupBy("risk_level").agg(
        F.count("*").alias("n_rows"),
        F.min("p").alias("min_p"),
        F.max("p").alias("max_p"),
        F.avg("p").alias("mean_p"),
    ).select("*", median.alias("median_p"), (F.col("n_rows") / total * 100).alias("percentage"))


def label_by_level(scored: DataFrame, level: Column | None = None) -> DataFrame:
    """Rows, positives, positive rate (= precision of the level) and share of the total."""
    levels = scored.withColumn("risk_level", risk_level(F.col("p")) if level is None else level)
    total = scored.agg(F.count("*")).scalar()
    return levels.groupBy("risk_level").agg(
        F.count("*").alias("n_rows"),
        F.sum("y").alias("fraud_count"),
        F.avg(F.col("y").cast("double")).alias("fraud_rate"),
    ).withColumn("percentage_of_total", F.col("n_rows") / total * 100)


def level_counts(scored: DataFrame) -> DataFrame:
    """R6."""
    return scored.groupBy(risk_level(F.col("p")).alias("risk_level")).agg(F.count("*").alias("n_rows"))


def recommended_bands(tuned: DataFrame) -> DataFrame:
    """Bounds 0.2 around the F1-optimal threshold, within [0.1, 0.9]; ``tuned`` is E13."""
    t = F.col("threshold")
    return tuned.filter("strategy = 'f1_optimal'").select(
        t.alias("f1_threshold"),
        F.greatest(F.lit(0.1), t - 0.2).alias("new_low"),
        F.least(F.lit(0.9), t + 0.2).alias("new_high"),
    )


def alternative_levels(scored: DataFrame) -> DataFrame:
    """Level counts under each alternative pair of bounds, from one scan.

    Each row names its level under every configuration; the partial aggregate folds them.
    """
    bands = {"current": (LOW_RISK, HIGH_RISK), **ALTERNATIVE_BANDS}
    options = F.array(
        *[
            F.struct(F.lit(name).alias("config"), risk_level(F.col("p"), lo, hi).alias("risk_level"))
            for name, (lo, hi) in bands.items()
        ]
    )
    return (
        scored.select(F.inline(options), "y")
        .groupBy("config", "risk_level")
        .agg(F.count("*").alias("n_rows"), F.sum("y").alias("fraud_count"))
    )


def ranked(
    transactions: DataFrame, predictions: DataFrame, keys: Sequence[str], top: int | None = None
) -> DataFrame:
    """Transactions with their predictions, most suspicious first; ``top`` keeps the head."""
    joined = attach(transactions, predictions, keys).orderBy(F.col("fraud_probability").desc_nulls_last(), *keys)
    return joined if top is None else joined.limit(top)


def ranked_summary(ranked_rows: DataFrame) -> DataFrame:
    """Level counts, flagged rows and mean probability."""
    level = F.col("risk_level")
    return ranked_rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(level == "high").alias("n_high"),
        F.count_if(level == "medium").alias("n_medium"),
        F.count_if(level == "low").alias("n_low"),
        F.sum("fraud_prediction").alias("n_flagged"),
        F.avg("fraud_probability").alias("mean_probability"),
    )
