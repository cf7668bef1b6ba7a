"""Scaling and score arithmetic around the models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators.statistics import quantiles
from txrisk.schema import COLUMNS, CONTAMINATION

CLIP = 1e10  # fixed value


def _value(c: str):
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: (m[0] if m[0] is not None else 0.0) for c, m in quantiles(df, {c: [0.5] for c in columns}).items()}


def impute_clip(df: DataFrame, columns: Sequence[str], fills: dict[str, float] | None = None) -> DataFrame:
    """M1: missing values take the (training) median, everything lies within ±1e10."""
    fills = medians(df, columns) if fills is None else fills
    return df.withColumns(
        {
            c: F.least(F.greatest(F.coalesce(_value(c), F.lit(fills[c])), F.lit(-CLIP)), F.lit(CLIP))
            for c in columns
        }
    )


MOMENTS_AT_ONCE = 8  # columns of one aggregate: the code for more is too long for the JVM to compile


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """M2 fit: mean and population deviation per column; a constant column is divided by 1."""
    parts = [columns[i : i + MOMENTS_AT_ONCE] for i in range(0, len(columns), MOMENTS_AT_ONCE)]
    out: dict[str, tuple[float, float]] = {}
    for part in parts:
        row = df.select(*part).agg(
            *[F.avg(_value(c)).alias(f"m_{c}") for c in part],
            *[F.stddev_pop(_value(c)).alias(f"s_{c}") for c in part],
        ).first()
        out |= {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in part}
    return out


def standardise(
    df: DataFrame, columns: Sequence[str], fitted: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """M2 apply."""
    fitted = moments(df, columns) if fitted is None else fitted
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in fitted.items()})


def normalise_scores(
    df: DataFrame,
    raw: str,
    out: str,
    ends: tuple[float, float] | None = None,
    contamination: float = CONTAMINATION,
) -> DataFrame:
    """M6: (max - s) / (max - min) within [0, 1]; all-equal scores take the contamination.

    ``ends`` are the training minimum and maximum: with them a batch of any size, or a
    stream, gets the same score for the same row. Without them the batch's own are used.
    """
    lo, hi = ends if ends else df.agg(F.min(raw), F.max(raw)).first()
    if lo is None or lo == hi:
        return df.withColumn(out, F.lit(float(contamination)))
    scaled = (hi - F.col(raw)) / (hi - lo)
    return df.withColumn(out, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def flag_anomalies(
    df: DataFrame, score: str, threshold: float | None = None, contamination: float = CONTAMINATION
) -> DataFrame:
    """M7: 1 at or above the threshold, by default the exact (1 - contamination) percentile."""
    if threshold is None:
        threshold = quantiles(df, {score: [1 - contamination]})[score][0]
    return df.withColumn("is_anomaly", (F.col(score) >= threshold).cast("int"))


def score_stats(df: DataFrame, score: str, contamination: float = CONTAMINATION) -> DataFrame:
    """M8."""
    cut = quantiles(df, {score: [1 - contamination]})[score][0]
    return df.agg(
        F.count("*").alias("n_samples"),
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.max(F.lit(cut)).alias("threshold_percentile"),
    )


def positive_ratio(df: DataFrame, label: str = COLUMNS.label) -> float:
    """Negatives / positives; 1 without positives."""
    y = F.col(label)
    n = df.agg(F.count_if(y == 1), F.count_if(y == 0)).first()
    return float(n[1] / n[0]) if n[0] else 1.0


def with_weight(df: DataFrame, ratio: float, label: str = COLUMNS.label) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0)))


def class_weight(df: DataFrame, label: str = COLUMNS.label) -> DataFrame:
    """``weight`` = negatives / positives for positives, 1 for the rest."""
    return with_weight(df, positive_ratio(df, label), label)
