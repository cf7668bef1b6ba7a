"""Validation and data quality (V1-V26). Checks that need no data look only at the schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalars import ratio
from txrisk.operators.statistics import modes, quantiles
from txrisk.schema import COLUMNS, PREDICTION, Columns

AMOUNT_NAMES = {"amount", "transaction_amount", "value"}  # fixed values


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


# ------------------------------------------------------------- schema checks

def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """V1."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def bound_rows(df: DataFrame, min_rows: int = 1, max_rows: int | None = None) -> DataFrame:
    """V2: fail below ``min_rows`` and, where one is given, above ``max_rows``; no row is dropped."""
    if df.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} rows")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return df


def compare_schema(df: DataFrame, expected: T.StructType) -> dict:
    """Missing, extra and differently typed columns."""
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = {c: (want[c], have[c]) for c in want if c in have and want[c] != have[c]}
    missing = [c for c in want if c not in have]
    return {
        "valid": not missing and not wrong,
        "missing": missing,
        "extra": [c for c in have if c not in want],
        "mismatched": wrong,
    }


def align_columns(df: DataFrame, expected: Sequence[str], fill: str = "zero") -> DataFrame:
    """Every expected column, in order; absent ones hold a constant."""
    value = {"zero": 0.0, "mean": 0.5, "median": 0.0}[fill]  # fixed values
    return df.select(*[F.col(c) if c in df.columns else F.lit(value).alias(c) for c in expected])


def completeness(df: DataFrame, expected: Sequence[str]) -> dict:
    """V17."""
    have, want = set(df.columns), set(expected)
    return {
        "complete": want <= have,
        "missing": sorted(want - have),
        "extra": sorted(have - want),
        "found": len(want & have),
    }


# ------------------------------------------------------------- label checks

def label_check(df: DataFrame, label: str = COLUMNS.label) -> DataFrame:
    """V3: one row with the number of labels that are not 0 or 1."""
    bad = F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))
    return df.agg(F.count("*").alias("n_rows"), bad.alias("n_invalid")).withColumn(
        "is_binary", (F.col("n_invalid") == 0).cast("int")
    )


def require_binary(df: DataFrame, label: str = COLUMNS.label) -> DataFrame:
    if label_check(df, label).first()["is_binary"] != 1:
        raise ValueError(f"{label} must hold only 0 and 1")
    return df


def label_rate_check(df: DataFrame, label: str = COLUMNS.label) -> DataFrame:
    """Label rate, flagged below 0.1 % or above 50 %."""
    rate = F.col("label_rate")
    return df.agg(F.count("*").alias("n_rows"), F.avg(F.col(label).cast("double")).alias("label_rate")).withColumn(
        "status", F.when(rate < 0.001, "too_low").when(rate > 0.5, "too_high").otherwise("ok")
    )


# ----------------------------------------------------------------- cleaning

def drop_empty_rows(df: DataFrame) -> DataFrame:
    """V4."""
    return df.na.drop("all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """V5: one aggregate finds the columns without any value."""
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if filled[c] > 0])


def trim_text(df: DataFrame) -> DataFrame:
    """V6: text without outer blanks; empty text is NULL and NULL stays NULL."""
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in text_columns(df)})


def coerce_amounts(df: DataFrame) -> DataFrame:
    """V7: amount-like columns as doubles; unreadable text is NULL."""
    named = [c for c in df.columns if c.lower() in AMOUNT_NAMES]
    return df.withColumns({c: F.col(c).try_cast("double") for c in named})


def dedupe_by_id(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """V8: the earliest row per id.

    Spark turns ``row_number = 1`` into a group limit before the shuffle, so an id with
    many copies reaches its task as one row per map task. Ties in time are settled by
    a hash of the whole row; rows equal in that too are the same row.
    """
    order = [F.col(cols.time).asc_nulls_last(), F.xxhash64(*df.columns)]
    nth = F.row_number().over(Window.partitionBy(cols.id).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def dedupe_rows(df: DataFrame) -> DataFrame:
    """V9: hash aggregate on all columns, pre-aggregated before the shuffle."""
    return df.dropDuplicates()


def duplicate_report(df: DataFrame, id_col: str = COLUMNS.id) -> DataFrame:
    """V8/V9: rows, distinct ids and rows that a dedup by id removes."""
    per_id = df.groupBy(id_col).agg(F.count("*").alias("n"))
    return per_id.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_ids"),
        (F.sum("n") - F.count("*")).alias("n_removed"),
    )


def sanitise(df: DataFrame) -> DataFrame:
    """V4, V5, V6 and V7 in one go."""
    return coerce_amounts(trim_text(drop_empty_columns(drop_empty_rows(df))))


def null_fills(df: DataFrame) -> dict[str, object]:
    """V10 fit: median per numeric column (0 when empty), mode per text column ('unknown').

    Only columns with holes are looked at: a unique id is never grouped by its values.
    """
    doubles = set(double_columns(df))

    def known(c: str) -> Column:
        return F.when(~F.isnan(c), F.col(c)) if c in doubles else F.col(c)

    names = [*numeric_columns(df), *text_columns(df)]
    counts = df.agg(F.count("*").alias("_n"), *[F.count(known(c)).alias(c) for c in names]).first()
    holes = {c for c in names if counts[c] < counts["_n"]}
    numeric = [c for c in numeric_columns(df) if c in holes]
    text = [c for c in text_columns(df) if c in holes]
    medians = quantiles(df, {c: [0.5] for c in numeric}) if numeric else {}
    common = modes(df, text)
    fills: dict[str, object] = {c: (m[0] if m[0] is not None else 0.0) for c, m in medians.items()}
    fills.update({c: common[c][0] if c in common else "unknown" for c in text})
    return fills


def fill_nulls(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """V10 apply; NaN counts as missing."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def value(c: str) -> Column:
        known = F.col(c)
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            known = F.when(~F.isnan(c), F.col(c))
        return F.coalesce(known, F.lit(fills[c]).cast(kinds[c]))

    return df.withColumns({c: value(c) for c in fills if c in kinds})


def finite_ends(df: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """V11 fit: smallest and largest finite value of each floating-point column."""
    names = double_columns(df)
    if not names:
        return {}
    finite = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in names}
    ends = df.agg(*[f(finite[c]).alias(f"{k}_{c}") for c in names for k, f in (("min", F.min), ("max", F.max))]).first()
    return {c: (ends[f"min_{c}"], ends[f"max_{c}"]) for c in names}


def make_finite(df: DataFrame, ends: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """+inf and -inf become the largest and smallest finite value of the column (or of ``ends``)."""
    ends, inf = finite_ends(df) if ends is None else ends, float("inf")
    return df.withColumns({
        c: F.when(F.col(c) == inf, F.lit(high)).when(F.col(c) == -inf, F.lit(low)).otherwise(F.col(c))
        for c, (low, high) in ends.items() if c in df.columns
    })


def varied_columns(df: DataFrame, columns: Sequence[str], more_than: int = 10) -> list[str]:
    """Columns with more than ``more_than`` distinct values, NULL counting as one.

    The sketch is trusted only far above the limit. What may be near it has few
    values, and these the exact count folds before its shuffle.
    """
    if not columns:
        return []
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    near = [c for c in columns if rough[c] <= 10 * more_than]
    exact = (
        df.agg(
            *[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in near]
        ).first()
        if near
        else {}
    )
    return [c for c in columns if c not in near or exact[c] > more_than]


def outlier_bounds(df: DataFrame, columns: Sequence[str] | None = None, width: float = 5.0) -> dict:
    """V12 fit: mean ± 5 sample deviations of the varied numeric columns."""
    columns = numeric_columns(df) if columns is None else list(columns)
    varied = varied_columns(df, columns)
    if not varied:
        return {}
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in varied], *[F.stddev_samp(c).alias(f"s_{c}") for c in varied]
    ).first()
    return {
        c: (row[f"m_{c}"] - width * row[f"s_{c}"], row[f"m_{c}"] + width * row[f"s_{c}"])
        for c in varied
        if row[f"s_{c}"] and row[f"s_{c}"] > 0
    }


def clip_columns(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """V12 apply."""
    clipped = {
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
        for c, (lo, hi) in bounds.items()
        if c in df.columns
    }
    return df.withColumns(clipped) if clipped else df


def resolve_quality(df: DataFrame, protect: Sequence[str] = (COLUMNS.label,)) -> DataFrame:
    """V10, V11, V12 and V9 in the order of use; ``protect`` columns are never clipped."""
    df = make_finite(fill_nulls(df, null_fills(df)))
    names = [c for c in numeric_columns(df) if c not in protect]
    return dedupe_rows(clip_columns(df, outlier_bounds(df, names)))


# ------------------------------------------------------------------ reports

def null_report(df: DataFrame, columns: Sequence[str], limit: float = 0.5, cols: Columns = COLUMNS) -> DataFrame:
    """(column, null_ratio, issue, type_issue), the ratios from one aggregate.

    An amount has to be numeric and a time a timestamp; both are judged by the schema.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def type_issue(c: str) -> str:
        if c == cols.amount and not isinstance(kinds[c], T.NumericType):
            return "amount_not_numeric"
        if c == cols.time and not isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType)):
            return "time_not_timestamp"
        return "none"

    ratios = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    long = ratios.unpivot([], list(columns), "column", "null_ratio")
    told = F.create_map(*[F.lit(x) for c in columns for x in (c, type_issue(c))])
    return long.withColumns({
        "issue": F.when(F.col("null_ratio") > limit, "excessive_nulls").otherwise("none"), "type_issue": told[F.col("column")],
    })


def data_profile(df: DataFrame) -> DataFrame:
    """Null count per column and the table's share of filled cells."""
    nulls = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in df.columns])
    scored = nulls.withColumn(
        "quality_score", 1 - ratio(total, F.col("_n") * F.lit(len(df.columns)))
    )
    return scored.unpivot(["quality_score"], list(df.columns), "column", "null_count")


def class_distribution(df: DataFrame, label: str = COLUMNS.label) -> DataFrame:
    """V23."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order- and partition-independent fingerprint of the rows, from an MD5 of each row's values as text."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(df.columns)]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.bit_xor(h).alias("xor_hash"),
        F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("sum_hash"),
    )


def overlap(train: DataFrame, test: DataFrame, id_col: str = COLUMNS.id) -> DataFrame:
    """Ids that appear on both sides. Distinct first, so copies do not skew the join."""
    left, right = train.select(id_col).distinct(), test.select(id_col).distinct()
    return left.join(right, id_col, "left_semi").agg(F.count("*").alias("n_overlap"))


def score_distribution(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct count, range, mean and deviation of the scores; degenerate below 0.001."""
    # Distinct scores first: the second aggregate then sees one row per score.
    per_score = scored.groupBy(*by, "p").agg(F.count("*").alias("n"))
    stats = scored.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.min("p").alias("min_p"),
        F.max("p").alias("max_p"),
        F.avg("p").alias("mean_p"),
        F.stddev_pop("p").alias("std_p"),
    )
    distinct = per_score.groupBy(*by).agg(F.count("*").alias("n_distinct"))
    joined = stats.join(distinct, list(by)) if by else stats.withColumn(
        "n_distinct", distinct.select("n_distinct").scalar()
    )
    return joined.withColumn("is_degenerate", (F.col("std_p") < 0.001).cast("int"))


# --------------------------------------------------- outputs and fallbacks

def output_violations(predictions: DataFrame) -> DataFrame:
    """How many rows break each rule of the prediction schema."""
    require_columns(predictions, ["fraud_probability", "risk_level", "fraud_prediction"])

    def broken(rule: Column) -> Column:
        return F.count_if(~F.coalesce(rule, F.lit(False)))

    return predictions.agg(
        F.count("*").alias("n_rows"),
        broken(F.col("fraud_probability").between(0, 1)).alias("bad_probability"),
        broken(F.col("risk_level").isin("low", "medium", "high")).alias("bad_level"),
        broken(F.col("fraud_prediction").isin(0, 1)).alias("bad_prediction"),
    )


def require_valid_output(predictions: DataFrame) -> DataFrame:
    row = output_violations(predictions).first()
    bad = {k: row[k] for k in row.asDict() if k.startswith("bad_") and row[k]}
    if bad:
        raise ValueError(f"prediction rows break the output schema: {bad}")
    return predictions


def as_predictions(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows in the prediction schema; fields not given are NULL."""
    return df.select(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in PREDICTION.fields
        ]
    )


def fallback_predictions(df: DataFrame, id_col: str = COLUMNS.id) -> DataFrame:
    """Neutral, conservative rows for transactions that could not be scored."""
    return as_predictions(
        df,
        {
            "transaction_id": F.col(id_col),
            "fraud_probability": F.lit(0.5),
            "anomaly_score": F.lit(0.5),
            "risk_level": F.lit("medium"),
            "fraud_prediction": F.lit(1),
            "explanation": F.lit("Fallback prediction due to model failure (probability: 0.5)"),
            "processed_at": F.current_timestamp(),
            "model_version": F.lit("fallback_v1.0"),
            "is_fallback": F.lit(True),
            "has_error": F.lit(False),
        },
    )


def error_predictions(df: DataFrame, kind: Column, message: Column, id_col: str = COLUMNS.id) -> DataFrame:
    """Conservative rows that carry the error they stand for."""
    return as_predictions(
        df,
        {
            "transaction_id": F.col(id_col),
            "fraud_probability": F.lit(0.5),
            "anomaly_score": F.lit(0.5),
            "risk_level": F.lit("medium"),
            "fraud_prediction": F.lit(1),
            "explanation": F.concat(F.lit("Error during processing: "), message),
            "processed_at": F.current_timestamp(),
            "model_version": F.lit("error_handler_v1.0"),
            "is_fallback": F.lit(False),
            "has_error": F.lit(True),
            "error_type": kind,
            "error_message": message,
        },
    )


def row_error(cols: Columns = COLUMNS) -> tuple[Column, Column]:
    """(type, message) of the first thing that keeps a row from being scored, else NULL."""
    checks = [
        (F.col(cols.time).isNull(), "TimestampError", "timestamp is missing or unreadable"),
        (F.col(cols.sender).isNull(), "MissingValueError", "sender is missing"),
        (F.col(cols.receiver).isNull(), "MissingValueError", "receiver is missing"),
        (F.col(cols.amount).isNull(), "AmountError", "amount is missing or not a number"),
    ]
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, k, m in reversed(checks):
        kind = F.when(condition, k).otherwise(kind)
        message = F.when(condition, m).otherwise(message)
    return kind, message
