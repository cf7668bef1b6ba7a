"""The registered queries: one entry per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.scalars import probability, safe_divide, safe_log
from txrisk.ml import boosting, forest, oversample
from txrisk.ml.model import RiskModel, integrate
from txrisk.ml.scaling import class_weight, flag_anomalies, impute_clip, normalise_scores, score_stats, standardise
from txrisk.operators import compare, decision, features, impact, metrics, preprocess, quality, registry, splits
from txrisk.plans import evaluation, files
from txrisk.session import materialise, new_path
from txrisk.sources import tables as t
from txrisk.sources.readers import normalise_requests, parse_requests
from txrisk.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def averaged(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Averages of cents, rounded to 4 digits after a step off exact ties (see the SQL side)."""
    return df.withColumns({c: F.round(F.col(c) + 1.37e-7, 4) for c in columns})


def longs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def event_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with the event's own number ``k``."""
    return t.as_transactions(t.table(spark, sf_dir, "events")).withColumn(
        "k", F.expr("cast(substring(receiver_account, 2) AS int)")
    )


# ---------------------------------------------------------------- features

SENDER_MONEY = ["total_amount_last_24h", "max_amount_last_24h", "velocity_1h"]
SENDER_AVERAGES = ["avg_amount_last_24h", "velocity_24h"]
CYCLES = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]
CALENDAR = ["hour", "day_of_week", "day_of_month", "month", "year"]


def f1(spark, d):
    out = features.time_features(t.transactions(spark, d)).select("transaction_id", *features.TIME_FEATURES)
    return longs(rounded(out, 6, CYCLES), CALENDAR)


def _sender(tx):
    out = features.sender_windows(tx).select("transaction_id", *features.SENDER_FEATURES)
    return averaged(rounded(out, 4, SENDER_MONEY), SENDER_AVERAGES)


def f2(spark, d):
    return _sender(t.transactions(spark, d))


def f2_ties(spark, d):
    return _sender(t.with_hourly_ties(t.transactions(spark, d)))


def f2_dense(spark, d):
    """The time-block plan, on many rows per sender and instant."""
    tx = t.orders_as_wide_amounts(spark, d)
    out = features.sender_windows(tx, plan="blocks").select("transaction_id", *features.SENDER_FEATURES)
    return averaged(rounded(out, 4, SENDER_MONEY), SENDER_AVERAGES)


def _receiver(out):
    out = averaged(rounded(out, 4, ["receiver_total_amount"]), ["receiver_avg_amount"])
    out = rounded(out, 6, ["receiver_fraud_rate", "receiver_risk_score"])
    return out.withColumn("receiver_fraud_count", F.col("receiver_fraud_count").cast("double"))


def f3(spark, d):
    tx = t.transactions(spark, d)
    spread = features.traffic(tx)
    return _receiver(
        features.receiver_risk(tx, spread=spread).select("transaction_id", *features.RECEIVER_FEATURES)
    )


def f3_point_in_time(spark, d):
    tx = t.transactions(spark, d)
    out = features.receiver_risk(tx, spread=features.traffic(tx), mode="point_in_time")
    return _receiver(out.select("transaction_id", *features.RECEIVER_FEATURES))


def f4(spark, d):
    tx = t.transactions(spark, d)
    return features.novelty(tx, spread=features.traffic(tx)).select("transaction_id", *features.NOVELTY_FEATURES)


def f5(spark, d):
    tx = t.transactions(spark, d)
    out = features.pair_features(tx, spread=features.traffic(tx)).select("transaction_id", *features.PAIR_FEATURES)
    return averaged(rounded(out, 4, ["sender_receiver_total_amount"]), ["sender_receiver_avg_amount"])


def f6(spark, d):
    n = F.col("transaction_id").cast("long")
    text = F.when(n % 11 == 0, "abc").when(n % 13 != 0, F.col("k").cast("string"))
    return features.numeric_or_zero(event_k(spark, d).select("transaction_id", text.alias("k")), ["k"])


COUNTS = [
    "tx_count_last_1h", "tx_count_last_24h", "receiver_tx_count", "sender_receiver_frequency",
    *features.NOVELTY_FEATURES, *CALENDAR,
]
FLAGS = [c for c in features.TIME_FEATURES if c not in CYCLES and c not in CALENDAR]


def f7(spark, d):
    out = features.engineer(t.transactions(spark, d)).select("transaction_id", *features.ENGINEERED)
    out = rounded(longs(out, COUNTS), 6, CYCLES)
    out = rounded(out, 4, [*SENDER_MONEY, "sender_receiver_total_amount"])
    out = averaged(out, [*SENDER_AVERAGES, "sender_receiver_avg_amount"])
    return _receiver(out.withColumns({c: F.col(c).cast("int") for c in FLAGS}))


def flagship(spark, d):
    """Senders by their highest 24 h velocity, with the mean risk of whom they pay."""
    tx = t.transactions(spark, d)
    spread = features.traffic(tx)
    out = features.receiver_risk(features.sender_windows(tx, spread=spread), spread=spread, source=tx)
    return out.groupBy("sender_account").agg(
        F.count("*").alias("n_tx"),
        F.max(F.round(F.col("velocity_24h") + 1.37e-7, 4)).alias("max_velocity_24h"),
        F.round(F.avg("receiver_risk_score"), 6).alias("mean_receiver_risk"),
        F.max("tx_count_last_24h").alias("max_tx_24h"),
        F.sum("is_fraud").alias("n_fraud"),
    )


# ----------------------------------------------------------------- quality

def v7(spark, d):
    n = F.col("transaction_id").cast("long")
    text = F.when(n % 11 == 0, "n/a").otherwise(F.concat(F.col("k").cast("string"), F.lit(".5")))
    return quality.coerce_amounts(event_k(spark, d).select("transaction_id", text.alias("amount")))


def v10(spark, d):
    df = t.dirty_transactions(spark, d).select("transaction_id", "sender_account", "amount")
    return rounded(quality.fill_nulls(df, quality.null_fills(df)), 4, ["amount"])


def v11(spark, d):
    n, inf = F.col("transaction_id").cast("long"), float("inf")
    amount = F.when(n % 211 == 0, F.lit(inf)).when(n % 223 == 0, F.lit(-inf)).otherwise(F.col("amount"))
    return quality.make_finite(t.transactions(spark, d).select("transaction_id", amount.alias("amount")))


def v12(spark, d):
    df = t.dirty_transactions(spark, d).select("transaction_id", "amount")
    return rounded(quality.clip_columns(df, quality.outlier_bounds(df)), 4, ["amount"])


def v13(spark, d):
    """The time as text, which is a type issue."""
    columns = ["sender_account", "amount", "receiver_account", "timestamp"]
    odd = t.dirty_transactions(spark, d).withColumn("timestamp", F.col("timestamp").cast("string"))
    return rounded(quality.null_report(odd, columns, limit=0.05), 6, ["null_ratio"])


def v18(spark, d):
    i = F.col("transaction_id").cast("long")
    raw = (
        F.when(i % 5 == 0, F.lit(float("nan"))).when(i % 7 == 0, F.lit(float("inf")))
        .when(i % 11 == 0, F.lit(float("-inf"))).when(i % 13 == 0, F.col("p") + 0.9).otherwise(F.col("p"))
    )
    return t.scored(spark, d).select("transaction_id", probability(raw).alias("p"))


def predictions(spark, d):
    p = F.col("p")
    return t.scored(spark, d).select(
        "transaction_id",
        p.alias("fraud_probability"),
        decision.risk_level(p).alias("risk_level"),
        decision.decision(p).alias("fraud_prediction"),
    )


def v19(spark, d):
    broken = predictions(spark, d).withColumns(
        {
            "fraud_probability": F.col("fraud_probability") + 0.1,
            "risk_level": F.regexp_replace("risk_level", "high", "severe"),
        }
    )
    return quality.output_violations(broken)


def v20(spark, d):
    tx = event_k(spark, d)
    return tx.select(
        "transaction_id",
        F.round(safe_divide(F.col("amount"), F.col("k") % 5, -1.0), 6).alias("quotient"),
        F.round(safe_log(F.col("k") - 50), 6).alias("logarithm"),
    )


def _failed(spark, d):
    kind, message = quality.row_error()
    return t.dirty_transactions(spark, d).withColumns({"_kind": kind, "_message": message}).filter("_kind IS NOT NULL")


def v21(spark, d):
    return quality.fallback_predictions(_failed(spark, d)).select(
        "transaction_id", "fraud_probability", "anomaly_score", "risk_level", "fraud_prediction",
        "model_version", "explanation",
    )


def v22(spark, d):
    return quality.error_predictions(_failed(spark, d), F.col("_kind"), F.col("_message")).select(
        "transaction_id", "fraud_probability", "risk_level", "error_type", "error_message", "explanation"
    )


def v23(spark, d):
    df = t.dirty_transactions(spark, d).select("sender_account", "amount", "location")
    return rounded(quality.data_profile(df), 6, ["quality_score"])


def v25(spark, d):
    tx = event_k(spark, d)
    return quality.overlap(tx.filter("k < 60"), tx.filter("k >= 40"))


# ------------------------------------------------------------ preprocessing

def p1(spark, d):
    raw = t.raw_timestamps(spark, d)
    return preprocess.parse_times(raw, "raw").select("transaction_id", F.unix_micros("raw").alias("us"))


def p3(spark, d):
    raw = preprocess.parse_times(t.raw_timestamps(spark, d), "raw")
    return preprocess.time_parts(raw, "raw").drop("raw")


def p4(spark, d):
    df = t.dirty_transactions(spark, d)
    codes = preprocess.code_table(df.filter("is_fraud = 1"), "sender_account")
    return preprocess.label_encode(df.select("transaction_id", "sender_account"), "sender_account", codes)


def p5(spark, d):
    df = t.transactions(spark, d).select("transaction_id", "merchant_category")
    return preprocess.one_hot(df, "merchant_category", preprocess.categories(df, "merchant_category"))


def p6(spark, d):
    df = t.transactions(spark, d).select("amount", "device_used")
    return preprocess.dummies(df, ["device_used"], ["amount", "device_used_D1", "device_used_D3", "device_used_D9"])


def p7(spark, d):
    n = F.col("transaction_id").cast("long")
    df = t.dirty_transactions(spark, d).select(
        "transaction_id", F.when(n % 19 == 0, F.lit(0.0)).otherwise(F.col("amount")).alias("amount")
    )
    out = preprocess.log_amounts(df, preprocess.amount_params(df, ["amount"]))
    return rounded(rounded(out, 6, ["amount"]), 4, ["amount_original"])


def p8(spark, d):
    df = t.dirty_transactions(spark, d).select("transaction_id", "sender_account", "amount")
    out = preprocess.impute(df, preprocess.imputation(df, {"amount": "mean"}))
    return rounded(out, 4, ["amount"])


def p9(spark, d):
    df = event_k(spark, d).select("amount", "sender_account", "location", "k")
    amounts, texts = preprocess.detect_columns(df)
    kind = F.when(F.col("name").isin(amounts), "amount").when(F.col("name").isin(texts), "category")
    name = F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("name")
    return spark.range(1).select(name).select("name", kind.alias("kind")).filter("kind IS NOT NULL")


# ------------------------------------------------------------------ splits

def d1(spark, d):
    return splits.balanced_undersample(t.transactions(spark, d), minimum=1).select("transaction_id", "is_fraud")


def d2(spark, d):
    return splits.time_split(t.transactions(spark, d), 0.2).select("transaction_id", "split")


def d2_ties(spark, d):
    return splits.time_split(t.with_hourly_ties(t.transactions(spark, d)), 0.2).select("transaction_id", "split")


def d3(spark, d):
    report = splits.split_report(splits.time_split(t.transactions(spark, d), 0.2))
    return report.select(
        "split", "n_rows", F.round("label_rate", 6).alias("label_rate"),
        F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"),
    )


def d4(spark, d):
    return splits.stratified_split(t.transactions(spark, d), 0.2).select("transaction_id", "split")


def d4_drift(spark, d):
    return rounded(splits.drift_report(splits.stratified_split(t.transactions(spark, d), 0.2)), 6, ["label_rate"])


def d5(spark, d):
    return splits.assign_folds(t.transactions(spark, d), 5).select("transaction_id", "fold")


def d6(spark, d):
    """Both classes at the size of the larger one."""
    tx = t.transactions(spark, d)
    most = max(splits.label_counts(tx, "is_fraud").values(), default=0)
    out = splits.resample(tx, {0: most, 1: most})
    return out.select("draw", "transaction_id", "is_fraud")


def _coded(spark, d):
    tx = event_k(spark, d).withColumn("hour", F.hour("timestamp"))
    places = preprocess.categories(tx, "location")
    code = F.array_position(F.array(*[F.lit(v) for v in places]), F.col("location")) - 1
    return tx.select("transaction_id", "amount", "k", "hour", code.alias("location"), "is_fraud"), places


def d7(spark, d):
    """As many synthetic positives as bring the class level with the negatives."""
    coded, places = _coded(spark, d)
    wanted = splits.label_counts(coded, "is_fraud").get(0, 0)
    made = oversample.decode(oversample.smote(coded, ["amount", "k", "hour", "location"], wanted), "location", places)
    return rounded(made, 6, ["amount", "k", "hour"])


def d7_whole(spark, d):
    coded, places = _coded(spark, d)
    whole = oversample.decode(oversample.balanced_set(coded, ["amount", "k", "hour", "location"]), "location", places)
    return rounded(whole, 6, ["amount", "k", "hour"])


def d8(spark, d):
    tx = t.transactions(spark, d)
    out = splits.assign_metadata(tx, [F.col("timestamp"), F.col("transaction_id")])
    return out.select(
        "transaction_id", "sequence_id", F.unix_seconds("sequence_time").alias("sequence_seconds"), "fraud_type"
    )


# -------------------------------------------------------------- model maths

def m1(spark, d):
    df = t.dirty_transactions(spark, d).select("transaction_id", "amount")
    return rounded(impute_clip(df, ["amount"]), 4, ["amount"])


def m2(spark, d):
    df = event_k(spark, d).select("transaction_id", "amount", F.col("k").cast("double").alias("k"))
    return rounded(standardise(df, ["amount", "k"]), 6, ["amount", "k"])


def m6(spark, d):
    out = normalise_scores(t.scored(spark, d), "p", "score")
    return rounded(out.select("transaction_id", "score"), 6, ["score"])


def m7(spark, d):
    return flag_anomalies(t.scored(spark, d), "p").select("transaction_id", "is_anomaly")


def m8(spark, d):
    return rounded(score_stats(t.scored(spark, d), "p"), 6, ["score_mean", "score_std", "threshold_percentile"])


def m10(spark, d):
    return rounded(class_weight(t.transactions(spark, d)).select("transaction_id", "weight"), 6, ["weight"])


def registry_table(spark, d):
    """`orders` as a registry: five names with thousands of versions each."""
    return t.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("name"),
        F.concat(F.lit("v"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("version"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"),
    )


# ------------------------------------------------------------------ scoring

def curve_of(spark, d):
    return metrics.curve_points(t.scored(spark, d))


def r2(spark, d):
    best = metrics.tuned_thresholds(curve_of(spark, d)).filter("strategy = 'f1_optimal'").select("threshold").scalar()
    return t.scored(spark, d).select("transaction_id", (F.col("p") >= best).cast("int").alias("fraud_prediction"))


def r3(spark, d):
    p = F.col("p") + 1e-6  # thousandths end in an exact 5 too
    anomaly = F.col("transaction_id").cast("long") % 10 / F.lit(10.0)
    sentence = decision.explanation(p, decision.risk_level(p), anomaly)
    return t.scored(spark, d).select("transaction_id", sentence.alias("explanation"))


def r9(spark, d):
    tx = t.transactions(spark, d).select("transaction_id", "amount")
    return decision.ranked(tx, predictions(spark, d), ["transaction_id"])


RATES = ["precision", "recall", "f1_score"]
CELLS = ["tp", "fp", "fn", "tn"]


def e1_weighted(spark, d):
    weighted = t.scored(spark, d).withColumn("w", 1 + F.col("p") * 2)
    return rounded(metrics.confusion(weighted, 0.5, "w"), 4, CELLS)


def e6(spark, d):
    return rounded(curve_of(spark, d), 6, ["precision", "recall", "fpr", "tpr"])


def e7(spark, d):
    names = [*RATES, "pr_auc", "roc_auc", "false_positive_rate", "specificity", "customer_friction_rate",
             "accuracy", "false_negative_rate", "fraud_rate"]
    out = metrics.comprehensive(t.scored(spark, d)).select(*CELLS, *names, "total_transactions", "total_fraud")
    return rounded(out, 6, names)


def e8(spark, d):
    return rounded(
        metrics.compact(t.scored(spark, d), 0.5), 6,
        ["accuracy", *RATES, "roc_auc", "pr_auc", "false_positive_rate"],
    )


def _area(name):
    return lambda spark, d: metrics.areas(metrics.curve(t.scored(spark, d))).select(F.round(name, 6).alias(name))


def e10(spark, d):
    return rounded(
        metrics.sweep_table(t.scored(spark, d)), 6,
        ["threshold", *RATES, "false_positive_rate", "specificity", "customer_friction_rate"],
    )


def e10_summary(spark, d):
    out = metrics.sweep_summary(metrics.sweep_table(t.scored(spark, d)))
    return rounded(out, 6, ["min_value", "max_value", "mean_value"])


def e11(spark, d):
    return rounded(
        metrics.key_threshold_table(t.scored(spark, d)), 6,
        [*RATES, "specificity", "false_positive_rate", "predicted_fraud_rate", "fraud_detection_rate"],
    )


def e12(spark, d):
    out = metrics.operating_points(metrics.sweep_table(t.scored(spark, d)))
    return rounded(out, 6, ["threshold", "score", *RATES, "customer_friction_rate"])


def e13(spark, d):
    out = metrics.tuned_thresholds(curve_of(spark, d))
    return rounded(out.select("strategy", "threshold", "score", "precision", "recall"), 6, ["score", "precision", "recall"])


def e14(spark, d):
    return rounded(metrics.threshold_ranges(curve_of(spark, d)), 6, ["best_value"])


def _search(search):
    names = ["threshold", *RATES, "false_positive_rate"]
    return lambda spark, d: rounded(
        search(t.scored(spark, d)).select(*names, "constraints_met", *CELLS), 6, names
    )


def e17(spark, d):
    return rounded(metrics.zero_miss(t.scored(spark, d)), 6, ["threshold", "accuracy", *RATES])


def unit_impact_of(spark, d):
    points = curve_of(spark, d)
    return impact.unit_impact(impact.strategy_counts(points, metrics.tuned_thresholds(points)))


def e18(spark, d):
    return rounded(
        unit_impact_of(spark, d), 6,
        ["fraud_detection_rate", "false_alarm_rate", "customer_friction_rate", "fraud_prevented_value",
         "fraud_loss_value", "false_positive_total", "net_benefit", "cost_per_fraud_detected", "roi_ratio"],
    )


def e19(spark, d):
    names = ["fraud_prevented_value", "fraud_losses", "total_operational_costs", "potential_churn", "net_benefit",
             "roi_percentage", "cost_per_fraud_detected", "prevention_efficiency", "customer_impact_ratio",
             "net_benefit_per_transaction"]
    out = impact.detailed_impact(metrics.sweep(t.scored(spark, d), metrics.KEY_THRESHOLDS))
    return rounded(out.select("threshold", *names), 6, names)


def e20(spark, d):
    return rounded(
        impact.benchmark_report(metrics.with_rates(metrics.confusion(t.scored(spark, d), 0.5))), 6,
        ["current_value", "gap_to_excellent"],
    )


def e21(spark, d):
    full = impact.detailed_impact(metrics.comprehensive(t.scored(spark, d)))
    return rounded(impact.fired_rules(full), 6, ["value", "limit"])


def e22(spark, d):
    out = impact.compare_strategies(unit_impact_of(spark, d))
    return rounded(
        longs(out, ["benefit_rank", "recommended_team_size"]), 6,
        ["net_benefit", "detection_improvement", "customer_friction_rate", "annual_benefit",
         "risk_adjusted_return", "estimated_daily_reviews"],
    )


def e22_confidence(spark, d):
    return longs(impact.confidence(metrics.tuned_thresholds(curve_of(spark, d))), ["confidence_score"])


def e23(spark, d):
    p = F.col("p")
    models = F.array(
        *[F.struct(F.lit(n).alias("model"), v.alias("p")) for n, v in
          (("direct", p), ("inverse", 1 - p), ("squared", p * p))]
    )
    long = t.scored(spark, d).select("y", F.inline(models))
    ranked = compare.rank_models(metrics.comprehensive(long, 0.5, by=["model"]))
    return longs(rounded(ranked, 6, ["value"]), ["metric_rank"])


def compared(spark, d):
    """The same scores judged at 0.5 (all rows) and 0.6 (a balanced sample's size)."""
    scored = t.scored(spark, d)

    def side(threshold, train, rate):
        return metrics.comprehensive(scored, threshold).select(
            "*",
            F.lit(float(train)).alias("train_samples"),
            F.col("total_transactions").alias("test_samples"),
            F.lit(rate).alias("train_fraud_rate"),
            F.col("fraud_rate").alias("test_fraud_rate"),
        )

    return compare.compare_results(side(0.5, 8000, 0.04), side(0.6, 788, 0.5))


def e24(spark, d):
    return rounded(compared(spark, d), 6, ["imbalanced_value", "balanced_value", "difference", "percent_change"])


def e25(spark, d):
    names = ["precision_change", "recall_change", "fpr_change", "f1_change", "training_data_reduction"]
    return rounded(compare.trade_offs(compared(spark, d)), 6, names)


def e26(spark, d):
    return compare.recommendations(compare.trade_offs(compared(spark, d)))


# ------------------------------------------------------------------ sources

def s4(spark, d):
    """Each transaction written as one of the three request shapes, then read back."""
    tx = t.transactions(spark, d)
    n = F.col("transaction_id").cast("long")
    one = F.to_json(F.struct("transaction_id", "sender_account", "amount"))
    body = (
        F.when(n % 3 == 0, one)
        .when(n % 3 == 1, F.concat(F.lit("["), one, F.lit("]")))
        .otherwise(F.concat(F.lit('{"transactions":['), one, F.lit("]}")))
    )
    parsed = parse_requests(tx.select(body.alias("body")), "body")
    return parsed.select("transaction_id", "sender_account", F.col("amount").cast("double").alias("amount"))


def s7(spark, d):
    tx = event_k(spark, d)
    n = F.col("transaction_id").cast("long")
    raw = tx.select(
        "transaction_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(n % 3 == 0, "").otherwise(F.col("sender_account")).alias("sender_account"),
        "receiver_account",
        F.when(n % 7 == 0, "").otherwise(F.col("k").cast("string")).alias("amount"),
        F.lit(None).cast("string").alias("transaction_type"),
        "merchant_category",
        F.when(n % 5 != 0, F.col("location")).alias("location"),
        "device_used",
    )
    return normalise_requests(raw).select(
        "transaction_id", "sender_account", "location", "amount", "transaction_type", "merchant_category"
    )


# ------------------------------------------------------------ fitted models

ROUNDS, PATIENCE = 20, 100  # of the registered fits; the operators go on to 1,000 rounds
_MODELS: dict[tuple[str, str], RiskModel] = {}
_TABLES: dict[tuple[str, str], DataFrame] = {}


def fitted(spark: SparkSession, d: str) -> RiskModel:
    """One fitted model per session and folder, shared by the queries that only read it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = RiskModel.fit(t.transactions(spark, d), rounds=ROUNDS, patience=PATIENCE)
    return _MODELS[key]


def feature_table(spark, d):
    return fitted(spark, d).features(t.transactions(spark, d))


def written_features(spark, d):
    """:func:`feature_table`, written once per session and folder, for queries that read it again and again."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TABLES:
        _TABLES[key] = materialise(feature_table(spark, d), "feature-table")
    return _TABLES[key]


def scaled_features(spark, d):
    """The engineered columns as the fitted forest sees them."""
    model = fitted(spark, d)
    ready = model.forest.prepare(feature_table(spark, d))
    return model, standardise(ready, model.forest.columns, model.forest.scale)


def m3(spark, d):
    model, scaled = scaled_features(spark, d)
    return forest.deep_features(scaled, model.forest.columns, "deep").select("transaction_id", "deep")


def m4(spark, d):
    model, scaled = scaled_features(spark, d)
    ids = t.transactions(spark, d).select("transaction_id")
    return forest.fit_trees(scaled, model.forest.columns, "transaction_id", forest.ForestSettings(), ids)


def m4_samples(spark, d):
    tx = t.transactions(spark, d).select("transaction_id")
    return forest.tree_samples(tx, "transaction_id", forest.ForestSettings()).select("tree", "transaction_id")


def m5(spark, d):
    model = fitted(spark, d)
    ready = model.forest.prepare(feature_table(spark, d))
    return model.forest.raw_score(ready).select("transaction_id", "raw_score")


def m9(spark, d):
    return forest.permutation_importance(fitted(spark, d).forest, feature_table(spark, d))


def with_score(spark, d):
    model = fitted(spark, d)
    return integrate(model.forest, feature_table(spark, d), model.feature_names)


def m11(spark, d):
    """A classifier on the engineered features alone: no anomaly score."""
    model = fitted(spark, d)
    table = splits.stratified_split(written_features(spark, d), 0.2).withColumn("held", F.col("split") == "test")
    booster = boosting.fit_boosting(table, model.feature_names, validation="held", rounds=ROUNDS, patience=PATIENCE)
    return boosting.predict(booster, table.filter("held")).select("transaction_id", "fraud_probability")


def m12(spark, d):
    model = fitted(spark, d)
    out = boosting.predict(model.classifier, with_score(spark, d), model.threshold)
    return out.select("transaction_id", "fraud_probability", "fraud_prediction")


def m13(spark, d):
    return boosting.feature_importance(fitted(spark, d).classifier, t.transactions(spark, d))


def m14(spark, d):
    model = fitted(spark, d)
    return boosting.evaluate(model.classifier, with_score(spark, d), model.threshold)


def m15(spark, d):
    model = fitted(spark, d)
    return boosting.cross_validate(written_features(spark, d), model.feature_names, rounds=20)


def m16(spark, d):
    table = preprocess.one_hot(
        event_k(spark, d), "transaction_type", ["click", "error", "purchase", "signup", "view"], drop_first=True
    )
    columns = ["amount", "k", *[c for c in table.columns if c.startswith("transaction_type_")]]
    model = boosting.fit_random_forest(table, columns)
    return boosting.predict(model, table).select("transaction_id", "fraud_probability", "fraud_prediction")


def m17(spark, d):
    """The fitted model's tuned thresholds."""
    rows = sorted(fitted(spark, d).thresholds.items())
    return spark.createDataFrame(rows, "strategy string, threshold double")


def m17_facts(spark, d):
    """Sizes, rounds and quality of the fit."""
    facts = sorted((k, float(v)) for k, v in fitted(spark, d).training.items() if v is not None)
    return spark.createDataFrame(facts, "fact string, value double")


def m21_published(spark, d):
    """The fitted model published twice, as the registry tells."""
    root, model = new_path(spark, "registry"), fitted(spark, d)
    for _ in range(2):
        model.publish(spark, root)
    rows = registry.registry_table(spark, root)
    return registry.keep_latest(rows, 5).select(
        "name", "version", F.get_json_object("statistics", "$.n_train_samples").cast("long").alias("n_train_samples"), (F.col("size_bytes") > 0).alias("has_files")
    )


PREDICTED = ["transaction_id", "fraud_probability", "anomaly_score", "risk_level", "fraud_prediction", "explanation"]


def m18(spark, d):
    return fitted(spark, d).transform(t.transactions(spark, d)).select(*PREDICTED)


def m19(spark, d):
    """The table's last transaction, alone, with the earlier ones as history."""
    tx = t.transactions(spark, d)
    last = tx.orderBy(F.col("timestamp").desc(), F.col("transaction_id").desc()).limit(1)
    earlier = tx.join(last.select("transaction_id"), "transaction_id", "left_anti")
    return fitted(spark, d).transform(last, history=earlier).select(*PREDICTED)


def e9(spark, d):
    model, scored = evaluation.time_split_evaluation(t.transactions(spark, d), rounds=ROUNDS, patience=PATIENCE)
    return evaluation.evaluate(model, scored)


def e28(spark, d):
    return evaluation.dual_evaluation(t.transactions(spark, d), rounds=ROUNDS, minimum=1, patience=PATIENCE).comparison


def e29(spark, d):
    return evaluation.performance_report(t.scored(spark, d))


# ----------------------------------------------------------------- streams

def event_stream(spark, d):
    """`events` read as a stream: the file source watches the folder for the table's file name."""
    schema = t.table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return t.as_transactions(source.parquet(d))


def _folders(spark, name):
    at = new_path(spark, name)
    return f"{at}/state", f"{at}/out", f"{at}/checkpoint"


def t1(spark, d):
    state, out, checkpoint = _folders(spark, "t1")
    jobs.score_stream(event_stream(spark, d), fitted(spark, d), out, checkpoint, state=state).awaitTermination()
    return spark.read.parquet(out).select(*PREDICTED)


def t2(spark, d):
    state, out, checkpoint = _folders(spark, "t2")
    jobs.windows_with_history(event_stream(spark, d), state, out, checkpoint).awaitTermination()
    done = spark.read.parquet(out).select("transaction_id", *features.SENDER_FEATURES, *features.NOVELTY_FEATURES)
    return averaged(rounded(done, 4, SENDER_MONEY), SENDER_AVERAGES)


def t3(spark, d):
    _, out, checkpoint = _folders(spark, "t3")
    jobs.keep_state_on_disk(spark)
    done = jobs.run_to_table(jobs.velocity_stream(event_stream(spark, d)), out, checkpoint)
    return rounded(done.drop("sender_account"), 4, ["total_amount_last_24h", "velocity_1h"])


def _counts(length, step=None):
    def query(spark, d):
        _, out, checkpoint = _folders(spark, "t4")
        jobs.keep_state_on_disk(spark)
        counts = jobs.flat_counts(jobs.windowed_counts(event_stream(spark, d), length, step))
        done = jobs.run_to_table(counts, out, checkpoint)
        return done.select(
            "sender_account", F.unix_seconds("window_start").alias("window_start"), "tx_count",
            F.round("total_amount", 4).alias("total_amount"),
        )

    return query


def t5(spark, d):
    """Every fiftieth row arrives twice."""
    _, out, checkpoint = _folders(spark, "t5")
    twice = F.when(F.col("transaction_id").cast("long") % 50 == 0, F.sequence(F.lit(0), F.lit(1)))
    stream = event_stream(spark, d).withColumn("copy", F.explode(twice.otherwise(F.array(F.lit(0)))))
    done = jobs.run_to_table(jobs.distinct_stream(stream), out, checkpoint)
    return done.select("transaction_id", "sender_account", "amount")


def t6(spark, d):
    """Rows without a sender or an amount come out of the stream as error rows."""
    _, out, checkpoint = _folders(spark, "t6")
    n = F.col("transaction_id").cast("long")
    stream = event_stream(spark, d).withColumns(
        {
            "sender_account": F.when(n % 101 != 0, F.col("sender_account")),
            "amount": F.when(n % 13 != 0, F.col("amount")),
        }
    )
    jobs.score_stream(stream, fitted(spark, d), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).groupBy("has_error", "error_type").agg(F.count("*").alias("n_rows"))


def queries() -> dict[str, Query]:
    return files.queries() | {
        "flagship_risky_senders": flagship,
        "f1_time_features": f1,
        "f2_sender_windows": f2,
        "f2_sender_windows_ties": f2_ties,
        "f2_sender_windows_dense": f2_dense,
        "f3_receiver_risk": f3,
        "f3_receiver_point_in_time": f3_point_in_time,
        "f4_novelty": f4,
        "f5_pair_features": f5,
        "f6_numeric_or_zero": f6,
        "f7_all_features": f7,
        "s4_json_requests": s4,
        "s7_request_defaults": s7,
        "v3_label_check": lambda s, d: quality.label_check(t.transactions(s, d)),
        "v4_drop_empty_rows": lambda s, d: rounded(
            quality.drop_empty_rows(t.dirty_transactions(s, d).select("sender_account", "amount")), 4, ["amount"]
        ),
        "v5_drop_empty_columns": lambda s, d: quality.drop_empty_columns(
            t.transactions(s, d).select("transaction_id", "amount", F.lit(None).cast("string").alias("empty"))
        ),
        "v6_trim_text": lambda s, d: quality.trim_text(
            t.dirty_transactions(s, d).select("transaction_id", "sender_account", "location", "device_used")
        ),
        "v7_coerce_amounts": v7,
        "v8_dedupe_by_id": lambda s, d: rounded(
            quality.dedupe_by_id(t.dirty_transactions(s, d)).select(
                "transaction_id", "sender_account", "amount", "device_used"
            ), 4, ["amount"],
        ),
        "v8_duplicate_report": lambda s, d: quality.duplicate_report(t.dirty_transactions(s, d)),
        "v9_dedupe_rows": lambda s, d: rounded(
            quality.dedupe_rows(t.dirty_transactions(s, d)).select(
                "transaction_id", "sender_account", "amount", "location", "device_used", "is_fraud"
            ), 4, ["amount"],
        ),
        "v10_fill_nulls": v10,
        "v11_make_finite": v11,
        "v12_clip_outliers": v12,
        "v13_null_report": v13,
        "v15_label_rate": lambda s, d: rounded(quality.label_rate_check(t.transactions(s, d)), 6, ["label_rate"]),
        "v18_sanitise_output": v18,
        "v19_output_violations": v19,
        "v20_safe_math": v20,
        "v21_fallback_rows": v21,
        "v22_error_rows": v22,
        "v23_data_profile": v23,
        "v23_class_distribution": lambda s, d: quality.class_distribution(t.transactions(s, d)),
        "v24_fingerprint": lambda s, d: quality.fingerprint(
            t.transactions(s, d).withColumns({"timestamp": F.unix_micros("timestamp"), "amount": F.round(F.col("amount") * 100).cast("long")})
        ),
        "v25_split_overlap": v25,
        "v26_score_distribution": lambda s, d: rounded(
            quality.score_distribution(t.scored(s, d), ["y"]), 6, ["mean_p", "std_p"]
        ),
        "p1_parse_timestamps": p1,
        "p2_parse_report": lambda s, d: rounded(
            preprocess.parse_report(t.raw_timestamps(s, d), "raw"), 6, ["success_rate"]
        ),
        "p3_time_parts": p3,
        "p4_label_encode": p4,
        "p5_one_hot": p5,
        "p6_dummies": p6,
        "p7_log_amounts": p7,
        "p8_impute": p8,
        "p9_detect_columns": p9,
        "d1_balanced_undersample": d1,
        "d2_time_split": d2,
        "d2_time_split_ties": d2_ties,
        "d3_split_report": d3,
        "d4_stratified_split": d4,
        "d4_drift_report": d4_drift,
        "d5_folds": d5,
        "d6_resample": d6,
        "d7_smote": d7,
        "d7_balanced_set": d7_whole,
        "d8_assign_metadata": d8,
        "m1_impute_clip": m1,
        "m2_standardise": m2,
        "m6_normalise_scores": m6,
        "m7_flag_anomalies": m7,
        "m8_score_stats": m8,
        "m10_class_weight": m10,
        "m21_registry_list": lambda s, d: registry.list_versions(registry_table(s, d)),
        "m21_registry_latest": lambda s, d: registry.latest(registry_table(s, d)).select("name", "version", "size_bytes"),
        "m21_registry_keep": lambda s, d: registry.keep_latest(registry_table(s, d), 5).select("name", "version"),
        "m21_registry_superseded": lambda s, d: registry.superseded(registry_table(s, d), 5).select(
            "name", "version", "size_bytes"
        ),
        "m21_published_models": m21_published,
        "m17_training_facts": m17_facts,
        "m21_registry_storage": lambda s, d: rounded(registry.storage(registry_table(s, d)), 4, ["mean_bytes"]),
        "r1_risk_levels": lambda s, d: t.scored(s, d).select(
            "transaction_id", decision.risk_level(F.col("p")).alias("risk_level")
        ),
        "r2_decisions": r2,
        "r3_explanations": r3,
        "r4_risk_summary": lambda s, d: rounded(
            decision.risk_summary(t.scored(s, d)), 6, ["mean_p", "std_p", *decision.PERCENTILES]
        ),
        "r4_level_summary": lambda s, d: rounded(
            decision.level_summary(t.scored(s, d)), 6, ["mean_p", "median_p", "percentage"]
        ),
        "r5_label_by_level": lambda s, d: rounded(
            decision.label_by_level(t.scored(s, d)), 6, ["fraud_rate", "percentage_of_total"]
        ),
        "r6_level_counts": lambda s, d: decision.level_counts(t.scored(s, d)),
        "r7_recommended_bands": lambda s, d: rounded(
            decision.recommended_bands(metrics.tuned_thresholds(curve_of(s, d))), 6,
            ["f1_threshold", "new_low", "new_high"],
        ),
        "r8_alternative_levels": lambda s, d: decision.alternative_levels(t.scored(s, d)),
        "r9_ranked_transactions": r9,
        "r9_ranked_summary": lambda s, d: rounded(
            decision.ranked_summary(predictions(s, d)), 6, ["mean_probability"]
        ),
        "e1_confusion": lambda s, d: metrics.confusion(t.scored(s, d), 0.5),
        "e1_confusion_normalised": lambda s, d: rounded(
            metrics.normalised_confusion(t.scored(s, d), 0.5, "true"), 6, CELLS
        ),
        "e1_confusion_weighted": e1_weighted,
        "e2_precision_recall_f1": lambda s, d: rounded(metrics.precision_recall_f1(t.scored(s, d), 0.5), 6, RATES),
        "e3_average_precision": _area("pr_auc"),
        "e4_roc_auc": _area("roc_auc"),
        "e5_pr_auc_trapezoid": _area("pr_auc_trapezoid"),
        "e6_curve_points": e6,
        "e7_comprehensive": e7,
        "e8_compact": e8,
        "e10_threshold_sweep": e10,
        "e10_sweep_summary": e10_summary,
        "e11_key_thresholds": e11,
        "e12_operating_points": e12,
        "e13_tuned_thresholds": e13,
        "e14_threshold_ranges": e14,
        "e15_search_imbalanced": _search(metrics.search_imbalanced),
        "e16_search_balanced": _search(metrics.search_balanced),
        "e17_zero_miss": e17,
        "e18_unit_impact": e18,
        "e19_detailed_impact": e19,
        "e20_benchmark_report": e20,
        "e21_fired_rules": e21,
        "e22_strategy_comparison": e22,
        "e22_confidence": e22_confidence,
        "e23_rank_models": e23,
        "e24_compare_results": e24,
        "e25_trade_offs": e25,
        "e26_recommendations": e26,
        "m3_deep_features": m3,
        "m4_isolation_trees": m4,
        "m4_tree_samples": m4_samples,
        "m5_isolation_scores": m5,
        "m9_permutation_importance": m9,
        "m11_boosted_probabilities": m11,
        "m12_predictions": m12,
        "m13_feature_importance": m13,
        "m14_model_metrics": m14,
        "m15_cross_validation": m15,
        "m16_random_forest": m16,
        "m17_tuned_model": m17,
        "m18_risk_scores": m18,
        "m19_single_with_history": m19,
        "e9_time_split_evaluation": e9,
        "e28_dual_evaluation": e28,
        "e29_performance_report": e29,
        "t1_stream_scores": t1,
        "t2_stream_windows": t2,
        "t3_stream_velocity": t3,
        "t4_hourly_counts": _counts("1 hour"),
        "t4_daily_sliding_counts": _counts("24 hours", "1 hour"),
        "t5_stream_dedup": t5,
        "t6_stream_errors": t6,
        "e27_metric_differences": lambda s, d: rounded(
            compare.metric_differences(compared(s, d)), 6, ["difference"]
        ),
    }
