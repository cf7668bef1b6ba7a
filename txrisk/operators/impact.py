"""Business impact of thresholds and models (E18-E22). Inputs are metric rows, one per threshold or model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.scalars import ratio
from txrisk.schema import DETAILED_COSTS, UNIT_COSTS


def _cell(*names: str) -> list[Column]:
    return [F.col(n).cast("double") for n in names]


def strategy_counts(points: DataFrame, tuned: DataFrame) -> DataFrame:
    """The confusion counts of each tuned strategy; ``points``/``tuned`` are E6 and E13 rows.

    A tuned row is a curve row, so its counts are at hand; the totals come from the curve's end.
    """
    ends = points.agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    P, N = ends.select("P").scalar(), ends.select("N").scalar()
    return tuned.select(
        "strategy", "threshold", "tp", "fp", (P - F.col("tp")).alias("fn"), (N - F.col("fp")).alias("tn")
    )


def unit_impact(counts: DataFrame, costs: dict[str, float] = UNIT_COSTS) -> DataFrame:
    """Value and cost per strategy at a value per fraud and a cost per false alarm."""
    tp, fp, fn, tn = _cell("tp", "fp", "fn", "tn")
    value, cost = costs["fraud_value"], costs["false_positive_cost"]
    net = tp * value - fp * cost
    return counts.withColumns(
        {
            "fraud_detection_rate": ratio(tp, tp + fn),
            "false_alarm_rate": ratio(fp, fp + tn),
            "customers_flagged": F.col("tp") + F.col("fp"),
            "customer_friction_rate": ratio(tp + fp, tp + fp + fn + tn),
            "fraud_prevented_value": tp * value,
            "fraud_loss_value": fn * value,
            "false_positive_total": fp * cost,
            "net_benefit": net,
            "cost_per_fraud_detected": F.try_divide(fp * cost, tp),
            "roi_ratio": F.try_divide(net, fp * cost),
        }
    )


def detailed_impact(counts: DataFrame, costs: dict[str, float] = DETAILED_COSTS) -> DataFrame:
    """Prevented value, operating costs, churn, net benefit and KPIs."""
    tp, fp, fn, tn = _cell("tp", "fp", "fn", "tn")
    n = tp + fp + fn + tn
    gross = tp * costs["fraud_amount"] * costs["recovered"]
    losses = fn * costs["fraud_amount"]
    operating = (tp + fp) * costs["investigation"] + fp * costs["service"]
    net = gross - operating - losses
    return counts.withColumns(
        {
            "fraud_prevented_value": gross,
            "fraud_losses": losses,
            "investigation_costs": (tp + fp) * costs["investigation"],
            "customer_service_costs": fp * costs["service"],
            "total_operational_costs": operating,
            "satisfaction_impact": fp * 0.1,
            "potential_churn": fp * 0.02,
            "customer_friction_percentage": ratio(tp + fp, n) * 100,
            "net_benefit": net,
            "roi_percentage": ratio(gross - operating, operating) * 100,
            "cost_per_fraud_detected": F.try_divide(operating, tp),
            "prevention_efficiency": ratio(gross, operating),
            "customer_impact_ratio": ratio(fp, tp + fp),
            "net_benefit_per_transaction": ratio(net, n),
        }
    )


# Fixed values: (metric, lower is better, excellent, good, acceptable).
BENCHMARKS = [
    ("fraud_detection_rate", False, 0.95, 0.85, 0.75),
    ("false_positive_rate", True, 0.01, 0.03, 0.05),
    ("precision", False, 0.8, 0.6, 0.4),
    ("customer_friction_rate", True, 0.02, 0.05, 0.1),
]


def benchmark_report(rates: DataFrame) -> DataFrame:
    """Category and gap to excellent of each benchmarked metric of a metric row."""

    def entry(name: str, lower: bool, excellent: float, good: float, acceptable: float) -> Column:
        v = F.col(name)
        category = F.lit("needs_improvement")
        for limit, word in ((acceptable, "acceptable"), (good, "good"), (excellent, "excellent")):
            category = F.when((v <= limit) if lower else (v >= limit), word).otherwise(category)
        return F.struct(
            F.lit(name).alias("metric"),
            v.alias("current_value"),
            category.alias("category"),
            ((v - excellent) if lower else (excellent - v)).alias("gap_to_excellent"),
        )

    return rates.select(F.inline(F.array(*[entry(*b) for b in BENCHMARKS])))


# Fixed values: (code, group, metric, comparison, limit).
RULES = [
    ("retrain_model", "immediate_action", "pr_auc", "<", 0.5),
    ("raise_threshold", "immediate_action", "precision", "<", 0.3),
    ("review_features", "immediate_action", "recall", "<", 0.6),
    ("invest_in_features", "strategic_improvement", "pr_auc", "<", 0.8),
    ("reduce_investigation_cost", "business_optimisation", "cost_per_fraud_detected", ">", 50.0),
    ("add_risk_based_checks", "business_optimisation", "customer_impact_ratio", ">", 0.5),
    ("more_fraud_examples", "model_improvement", "pr_auc", "<", 0.6),
    ("fewer_false_positives", "model_improvement", "precision", "<", 0.5),
    ("study_missed_fraud", "model_improvement", "recall", "<", 0.8),
    ("many_false_positives", "finding", "precision", "<", 0.5),
    ("missed_fraud", "finding", "recall", "<", 0.7),
    ("strong_detection", "finding", "pr_auc", ">", 0.7),
]
# Alert limits as multiples of today's metric.
ALERTS = [("pr_auc", 0.9), ("precision", 0.8), ("recall", 0.85), ("false_positive_rate", 1.5)]
GRADES = [(0.8, "Excellent"), (0.6, "Good"), (0.4, "Fair")]


def grade(pr_auc: Column) -> Column:
    out = F.lit("Poor")
    for limit, word in reversed(GRADES):
        out = F.when(pr_auc >= limit, word).otherwise(out)
    return out


def fired_rules(metrics: DataFrame) -> DataFrame:
    """The grade, every rule a metric row breaks, and its alert limits: (group, code, metric, value, limit).

    The threshold advice is one of raise / lower / keep: precision is looked at first.
    """
    def row(group, code, metric, value, limit):
        return F.struct(
            F.lit(group).alias("group"), code.alias("code"), F.lit(metric).alias("metric"),
            value.cast("double").alias("value"), limit.cast("double").alias("limit"),
        )

    entries = []
    for code, group, metric, comparison, limit in RULES:
        value = F.col(metric)
        fired = value < limit if comparison == "<" else value > limit
        entries.append(F.when(fired, row(group, F.lit(code), metric, value, F.lit(limit))))
    advice = (
        F.when(F.col("precision") < 0.3, "increase_threshold")
        .when(F.col("recall") < 0.7, "decrease_threshold")
        .otherwise("current_threshold")
    )
    entries.append(row("grade", grade(F.col("pr_auc")), "pr_auc", F.col("pr_auc"), F.lit(None)))
    entries.append(row("threshold_advice", advice, "precision", F.col("precision"), F.lit(None)))
    for metric, factor in ALERTS:
        entries.append(row("alert", F.lit(f"{metric}_alert"), metric, F.col(metric), F.col(metric) * factor))
    return metrics.select(F.inline(F.array_compact(F.array(*entries))))


def compare_strategies(impact: DataFrame, months: int = 12, reviews_per_analyst: int = 50) -> DataFrame:
    """Strategies ranked by net benefit (at most a handful of rows), with yearly value and staff."""
    tp, fp, fn, tn = _cell("tp", "fp", "fn", "tn")
    best = Window.partitionBy(F.lit(0)).orderBy(F.col("net_benefit").desc(), "strategy")
    every = Window.partitionBy(F.lit(0))
    daily = F.sum("customers_flagged").over(every) / F.count("*").over(every)
    return impact.select(
        "strategy",
        "net_benefit",
        (F.col("fraud_detection_rate") - ratio(tp + fn, tp + fp + fn + tn)).alias("detection_improvement"),
        "customer_friction_rate",
        (F.col("net_benefit") * months).alias("annual_benefit"),
        (F.col("net_benefit") / F.greatest(F.col("false_positive_total"), F.lit(1.0))).alias("risk_adjusted_return"),
        F.row_number().over(best).alias("benefit_rank"),
        daily.alias("estimated_daily_reviews"),
        F.greatest(F.lit(1), F.floor(daily / reviews_per_analyst)).alias("recommended_team_size"),
    )


def confidence(strategies: DataFrame, has_impact: bool = True) -> DataFrame:
    """Confidence in tuned thresholds from how many *optimal* aims were met."""
    optimal = F.count_if(F.col("strategy").endswith("_optimal"))
    score = F.least(optimal * 20, F.lit(60)) + (30 if has_impact else 0) + F.when(F.count("*") > 0, 10).otherwise(0)
    return strategies.agg(score.alias("confidence_score")).withColumn(
        "confidence",
        F.when(F.col("confidence_score") >= 80, "high").when(F.col("confidence_score") >= 60, "medium").otherwise("low"),
    )
