"""Evaluation of a scored table (id, y, p[, weight]).

Everything starts from counts per distinct score, pre-aggregated before the shuffle,
or from counts per threshold bucket: no threshold costs a scan of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.scalars import ratio
from txrisk.operators.ordered import ordered_scan

# Threshold grids.
SWEEP = [float(t) for t in np.arange(0.1, 0.95, 0.05)]
KEY_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
SEARCH = [float(t) for t in np.linspace(0.01, 0.99, 99)]
F1_EPSILON = 1e-8


def _weight(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1).cast("long")


# ------------------------------------------------------ one threshold: E1, E2

def confusion(scored: DataFrame, threshold: float, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """true/false positive/negative counts (or weights) at ``threshold``."""
    w, hit, y = _weight(weight), F.col("p") >= threshold, F.col("y")

    def total(cell: Column) -> Column:
        return F.coalesce(F.sum(F.when(cell, w)), F.lit(0))

    return scored.groupBy(*by).agg(
        total((y == 1) & hit).alias("tp"),
        total((y == 0) & hit).alias("fp"),
        total((y == 1) & ~hit).alias("fn"),
        total((y == 0) & ~hit).alias("tn"),
    )


def normalised_confusion(scored: DataFrame, threshold: float, how: str) -> DataFrame:
    """The matrix as shares of the true class, of the predicted class, or of all."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    base = {
        "true": {"tp": tp + fn, "fn": tp + fn, "fp": fp + tn, "tn": fp + tn},
        "pred": {"tp": tp + fp, "fp": tp + fp, "fn": fn + tn, "tn": fn + tn},
        "all": dict.fromkeys(("tp", "fp", "fn", "tn"), tp + fp + fn + tn),
    }[how]
    return confusion(scored, threshold).select(*[ratio(c, base[c]).alias(c) for c in ("tp", "fp", "fn", "tn")])


def _f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def with_rates(counts: DataFrame) -> DataFrame:
    """All rates that follow from tp, fp, fn, tn; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1_score": _f1(precision, recall),
            "accuracy": ratio(tp + tn, n),
            "false_positive_rate": ratio(fp, fp + tn),
            "true_positive_rate": recall,
            "false_negative_rate": ratio(fn, tp + fn),
            "specificity": ratio(tn, fp + tn),
            "fraud_detection_rate": recall,
            "fraud_miss_rate": ratio(fn, tp + fn),
            "customer_friction_rate": ratio(tp + fp, n),
        }
    )


def precision_recall_f1(scored: DataFrame, threshold: float, weight: str | None = None) -> DataFrame:
    """E2."""
    return with_rates(confusion(scored, threshold, weight)).select("precision", "recall", "f1_score")


# ------------------------------------------------------------ curves: E3-E8

def curve(scored: DataFrame, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """E6 kernel: per distinct score its positives and negatives and the running counts at or above it."""
    w, y = _weight(weight), F.col("y")
    per_score = scored.groupBy(*by, F.col("p").alias("threshold")).agg(
        F.sum(F.when(y == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(y == 0, w).otherwise(0)).alias("neg"),
    )
    return ordered_scan(
        per_score,
        by,
        [F.col("threshold").desc()],
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))},
    )


def curve_points(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """(threshold, tp, fp, precision, recall, fpr, tpr) at every distinct score."""
    y, w = F.col("y"), _weight(weight)
    ends = scored.agg(F.sum(F.when(y == 1, w)).alias("P"), F.sum(F.when(y == 0, w)).alias("N"))
    positives, negatives = ends.select("P").scalar(), ends.select("N").scalar()
    return curve(scored, weight).select(
        "threshold", "tp", "fp",
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), positives).alias("recall"),
        ratio(F.col("fp"), negatives).alias("fpr"),
        ratio(F.col("tp"), positives).alias("tpr"),
    )


def binned_points(scored: DataFrame, bins: int) -> DataFrame:
    """E6 with a fixed number of equal score bins, for plots of very large tables."""
    grid = [i / bins for i in range(bins)]
    return sweep(scored, grid).select("threshold", "tp", "fp", "precision", "recall", "false_positive_rate")


def areas(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """E3, E4 and E5 from :func:`curve` rows, in one aggregate.

    Each row knows the counts before it (its own taken off), so no row needs its neighbour:
    average precision sums pos·precision, ROC adds trapezoids neg·(tp - pos/2), and the
    trapezoid PR area starts from precision 1 at recall 0.
    """
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    precision = F.try_divide(tp, tp + fp)
    before = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), F.lit(1.0))
    P, N = F.sum(pos), F.sum(neg)
    return points.groupBy(*by).agg(
        ratio(F.sum(pos * precision), P).alias("pr_auc"),
        ratio(F.sum(neg * (tp - pos / 2)), P * N).alias("roc_auc"),
        ratio(F.sum(pos * (precision + before) / 2), P).alias("pr_auc_trapezoid"),
    )


def _from_curve(points: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Areas and the confusion counts at one threshold, in one pass over the curve rows."""
    hit = F.col("threshold") >= threshold

    def total(value: str, cell: Column) -> Column:
        return F.coalesce(F.sum(F.when(cell, F.col(value))), F.lit(0))

    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    P, N = F.sum(pos), F.sum(neg)
    return points.groupBy(*by).agg(
        total("pos", hit).alias("tp"),
        total("neg", hit).alias("fp"),
        total("pos", ~hit).alias("fn"),
        total("neg", ~hit).alias("tn"),
        ratio(F.sum(pos * F.try_divide(tp, tp + fp)), P).alias("pr_auc"),
        ratio(F.sum(neg * (tp - pos / 2)), P * N).alias("roc_auc"),
    )


def comprehensive(
    scored: DataFrame, threshold: float = 0.5, weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Rates, areas, counts and dataset statistics, one row (per group)."""
    counts = with_rates(_from_curve(curve(scored, weight, by), threshold, by))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumns(
        {
            "total_transactions": n,
            "total_fraud": F.col("tp") + F.col("fn"),
            "total_legitimate": F.col("fp") + F.col("tn"),
            "fraud_rate": ratio(F.col("tp") + F.col("fn"), n),
            "threshold_used": F.lit(float(threshold)),
        }
    )


COMPACT = [
    "accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc", "tp", "tn", "fp", "fn",
    "false_positive_rate",
]


def compact(scored: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """E8."""
    return comprehensive(scored, threshold, by=by).select(*by, *COMPACT)


# ------------------------------------------------ many thresholds: E10-E16

def _bucket(p: Column, grid: Sequence[float], lo: int = 0, hi: int | None = None) -> Column:
    """How many grid values are ≤ p, as a balanced CASE tree (7 comparisons for 99 values)."""
    hi = len(grid) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(p >= grid[mid], _bucket(p, grid, mid + 1, hi)).otherwise(_bucket(p, grid, lo, mid))


def sweep(scored: DataFrame, grid: Sequence[float], weight: str | None = None) -> DataFrame:
    """E10/E11 kernel: counts and rates at every threshold of an ascending grid, from one scan.

    The scan ends in one row per bucket; each bucket then adds to all thresholds at or
    below it. Zero rows keep thresholds that nothing reaches.
    """
    w, y = _weight(weight), F.col("y")
    buckets = scored.groupBy(_bucket(F.col("p"), grid).alias("bucket")).agg(
        F.sum(F.when(y == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(y == 0, w).otherwise(0)).alias("neg"),
    )
    spread = buckets.select(F.explode(F.sequence(F.lit(0), "bucket")).alias("i"), "pos", "neg")
    zeros = scored.sparkSession.range(len(grid) + 1).select(
        F.col("id").cast("int").alias("i"), F.lit(0).alias("pos"), F.lit(0).alias("neg")
    )
    at = spread.unionAll(zeros).groupBy("i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    whole = Window.partitionBy(F.lit(0))  # at most len(grid) + 1 rows; i = 0 holds the totals
    counts = at.withColumns(
        {
            "fn": F.max("tp").over(whole) - F.col("tp"),
            "tn": F.max("fp").over(whole) - F.col("fp"),
        }
    ).filter("i > 0")
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in grid]), F.col("i"))
    return with_rates(counts.select(threshold.alias("threshold"), "tp", "fp", "fn", "tn"))


def sweep_table(scored: DataFrame) -> DataFrame:
    """0.10 … 0.90 in steps of 0.05."""
    return sweep(scored, SWEEP).select(
        "threshold", "precision", "recall", "f1_score", "false_positive_rate", "specificity",
        "customer_friction_rate", "tp", "fp", "fn", "tn",
    )


def sweep_summary(table: DataFrame) -> DataFrame:
    """Min, max and mean of precision, recall and F1 over the sweep."""
    long = table.unpivot(["threshold"], ["precision", "recall", "f1_score"], "metric", "value")
    return long.groupBy("metric").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value")
    )


def key_threshold_table(scored: DataFrame) -> DataFrame:
    """Nine fixed thresholds."""
    return sweep(scored, KEY_THRESHOLDS).select(
        "threshold", "precision", "recall", "f1_score", "specificity", "false_positive_rate",
        "tp", "fp", "tn", "fn",
        F.col("customer_friction_rate").alias("predicted_fraud_rate"), "fraud_detection_rate",
    )


def _best_rows(rows: DataFrame, aims: Sequence[tuple[str, Column, Column, bool]]) -> DataFrame:
    """Per aim (name, score, keep, highest) the kept row with the largest score, all in one aggregate.

    Ties go to the lowest threshold, or with ``highest`` to the highest one. An aim
    that no row meets has no row in the result.
    """
    def best(score: Column, keep: Column, highest: bool) -> Column:
        tie = F.col("threshold") if highest else -F.col("threshold")
        row = F.struct(score.alias("score"), tie.alias("tie"), *[F.col(c) for c in rows.columns])
        return F.max(F.when(keep & score.isNotNull(), row))

    found = rows.agg(*[best(score, keep, highest).alias(name) for name, score, keep, highest in aims])
    entries = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("b")) for n, *_ in aims])
    return (
        found.select(F.inline(entries))
        .filter("b IS NOT NULL")
        .select("strategy", "b.*")
        .drop("tie")
    )


def operating_points(table: DataFrame) -> DataFrame:
    """The best sweep row for each of six aims; aims that nothing meets have no row."""
    P, R, friction = F.col("precision"), F.col("recall"), F.col("customer_friction_rate")
    business = R * 0.6 + (1 - friction) * 0.4
    rows = table.select("threshold", "precision", "recall", "f1_score", "customer_friction_rate")
    return _best_rows(
        rows,
        [
            ("f1_optimal", F.col("f1_score"), F.lit(True), False),
            ("precision_focused", R, P >= 0.5, False),
            ("recall_focused", P, R >= 0.8, False),
            ("business_balanced", business, F.lit(True), False),
            ("conservative", R, (P >= 0.7) & (friction <= 0.1), False),
            ("aggressive", P, R >= 0.9, False),
        ],
    )


def tuned_thresholds(points: DataFrame, min_precision: float = 0.1, min_recall: float = 0.8) -> DataFrame:
    """The best point of the full curve for each of six aims, from :func:`curve_points` rows.

    Precision-recall aims prefer the lowest threshold among equals, Youden's J the highest.
    """
    P, R = F.col("precision"), F.col("recall")
    f1 = 2 * (P * R) / (P + R + F1_EPSILON)
    everything = F.lit(True)
    return _best_rows(
        points,
        [
            ("f1_optimal", f1, everything, False),
            ("precision_focused", R, P >= min_precision, False),
            ("recall_focused", P, R >= min_recall, False),
            ("balanced", F.col("tpr") - F.col("fpr"), everything, True),
            ("business_conservative", R, P >= 0.5, False),
            ("business_aggressive", P, R >= 0.9, False),
        ],
    )


def threshold_ranges(points: DataFrame) -> DataFrame:
    """Where precision ≥ 0.8, where recall ≥ 0.8, and where both lie within 0.1."""
    P, R = F.col("precision"), F.col("recall")
    f1 = 2 * (P * R) / (P + R + F1_EPSILON)

    def summary(name: str, keep: Column, value: Column) -> Column:
        t = F.when(keep, F.col("threshold"))
        # lowest threshold among equals
        best = F.max(F.when(keep, F.struct(value.alias("value"), (-t).alias("t"))))
        return F.struct(
            F.lit(name).alias("range_name"),
            F.min(t).alias("min_threshold"),
            F.max(t).alias("max_threshold"),
            (-best["t"]).alias("best_threshold"),
            best["value"].alias("best_value"),
            F.count(t).alias("n_thresholds"),
        )

    ranges = [
        summary("high_precision", P >= 0.8, P),
        summary("high_recall", R >= 0.8, R),
        summary("balanced", F.abs(P - R) <= 0.1, f1),
    ]
    return points.agg(F.array(*ranges).alias("r")).select(F.inline("r"))


def _constrained(scored: DataFrame, meets: Column, fallback: Column, score: Column) -> DataFrame:
    """The first threshold that meets all constraints, else the best ``score`` among ``fallback``, else 0.5."""
    rows = sweep(scored, SEARCH)
    none, t = F.lit(None).cast("double"), F.col("threshold")
    default = F.abs(t - 0.5) < 0.001
    choice = (
        F.when(meets, F.struct(F.lit(0).alias("rank"), F.lit(0.0).alias("loss"), t.alias("threshold")))
        .when(fallback & (score > 0), F.struct(F.lit(1).alias("rank"), (-score).alias("loss"), t.alias("threshold")))
        .when(default, F.struct(F.lit(2).alias("rank"), F.lit(0.0).alias("loss"), t.alias("threshold")))
    )
    carried = ["precision", "recall", "f1_score", "false_positive_rate", "accuracy", "tp", "fp", "fn", "tn"]
    best = F.min(F.struct(choice.alias("c"), *carried))
    return (
        rows.filter(choice.isNotNull())
        .agg(best.alias("b"))
        .select(
            F.col("b.c.threshold").alias("threshold"),
            (F.col("b.c.rank") == 0).cast("int").alias("constraints_met"),
            *[F.col(f"b.{c}").alias(c) for c in carried],
        )
        .withColumn("threshold", F.coalesce("threshold", none))
    )


def search_imbalanced(
    scored: DataFrame, recall: tuple[float, float] = (0.70, 0.85), max_fpr: float = 0.05
) -> DataFrame:
    """Recall within a band at a bounded false positive rate."""
    allowed = F.col("false_positive_rate") <= max_fpr
    return _constrained(scored, allowed & F.col("recall").between(*recall), allowed, F.col("recall"))


def search_balanced(
    scored: DataFrame,
    recall: tuple[float, float] = (0.85, 0.95),
    precision: tuple[float, float] = (0.70, 0.90),
    min_f1: float = 0.75,
) -> DataFrame:
    """Recall and precision within bands and F1 above a limit."""
    meets = (
        F.col("recall").between(*recall)
        & F.col("precision").between(*precision)
        & (F.col("f1_score") > min_f1)
    )
    return _constrained(scored, meets, F.lit(True), F.col("f1_score"))


def zero_miss(scored: DataFrame) -> DataFrame:
    """The threshold just below the lowest positive score, its metrics and the targets met."""
    cut = scored.agg((F.min(F.when(F.col("y") == 1, F.col("p"))) - 0.001).alias("t")).scalar()
    hit, y = F.col("p") >= cut, F.col("y")
    counts = scored.agg(
        F.count_if((y == 1) & hit).alias("tp"),
        F.count_if((y == 0) & hit).alias("fp"),
        F.count_if((y == 1) & ~hit).alias("fn"),
        F.count_if((y == 0) & ~hit).alias("tn"),
    )
    # The stated targets.
    targets = {"accuracy": 0.9998, "precision": 0.9996, "recall": 1.0, "f1_score": 0.9998}
    return with_rates(counts).select(
        cut.alias("threshold"), "accuracy", "precision", "recall", "f1_score", "tp", "fp", "fn", "tn",
        *[(F.col(m) >= v).cast("int").alias(f"{m}_on_target") for m, v in targets.items()],
    )
