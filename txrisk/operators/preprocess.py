"""Preprocessing: parameters are fitted by Spark jobs, applied as plain expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalars import parse_timestamp, ratio
from txrisk.operators.ordered import ordered_scan
from txrisk.operators.quality import align_columns, fill_nulls, numeric_columns, text_columns
from txrisk.operators.skew import attach
from txrisk.operators.statistics import modes, quantiles
from txrisk.schema import COLUMNS, Columns
from txrisk.session import new_path

MISSING = "MISSING"
CODES = "value string, code long"
SMALL_TABLE = 100_000  # categories that one task may number
ONE_HOT_LIMIT = 1_000


# ------------------------------------------------------------- P1-P3: time

def parse_times(df: DataFrame, column: str = COLUMNS.time) -> DataFrame:
    """Text to timestamp; a column that already is one stays as it is."""
    kind = df.schema[column].dataType
    parsed = parse_timestamp(F.col(column)) if isinstance(kind, T.StringType) else F.col(column).cast("timestamp")
    return df.withColumn(column, parsed)


def parse_report(df: DataFrame, column: str) -> DataFrame:
    """Rows, parsed rows and the success rate of P1."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count(parse_timestamp(F.col(column))).alias("n_parsed")
    ).withColumn("success_rate", ratio("n_parsed", "n_rows"))


def require_parsed(df: DataFrame, column: str) -> DataFrame:
    if parse_report(df, column).first()["n_parsed"] == 0:
        raise ValueError(f"no value of {column} is a readable timestamp")
    return df


TIME_PARTS = ["hour", "day_of_week", "day_of_month", "month", "year"]
TIME_FLAGS = ["is_weekend", "is_business_hours", "is_night"]


def time_parts(df: DataFrame, column: str = COLUMNS.time) -> DataFrame:
    """Calendar parts; flags of rows without a time take the mode, other parts the median."""
    t = F.col(column)
    parts = df.withColumns(
        {
            "hour": F.hour(t).cast("double"),
            "day_of_week": F.weekday(t).cast("double"),
            "day_of_month": F.dayofmonth(t).cast("double"),
            "month": F.month(t).cast("double"),
            "year": F.year(t).cast("double"),
            "is_weekend": (F.weekday(t) >= 5).cast("int"),
            "is_business_hours": F.hour(t).between(9, 17).cast("int"),
            "is_night": ((F.hour(t) >= 22) | (F.hour(t) <= 6)).cast("int"),
        }
    )
    medians = quantiles(parts, {c: [0.5] for c in TIME_PARTS})
    common = modes(parts, TIME_FLAGS, "double")
    fills = {c: (m[0] if m[0] is not None else 0.0) for c, m in medians.items()}
    fills.update({c: int(common[c][0]) if c in common else 0 for c in TIME_FLAGS})
    return fill_nulls(parts, fills)


# ----------------------------------------------------------- P4-P6: codes

def code_table(df: DataFrame, column: str) -> DataFrame:
    """P4 fit: (value, code) with codes 0..k-1 in value order.

    Few categories are numbered by one small window; more of them by a ranged scan, so an
    account column with billions of values does not pass through one task.
    """
    values = df.select(F.coalesce(F.col(column), F.lit(MISSING)).alias("value")).distinct()
    if values.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        numbered = values.withColumn("code", F.row_number().over(Window.orderBy("value")).cast("long"))
    else:
        numbered = ordered_scan(values, [], [F.col("value")], {"code": ("sum", F.lit(1).cast("long"))})
    return numbered.withColumn("code", F.col("code") - 1)


def label_encode(df: DataFrame, column: str, codes: DataFrame, hot: dict | None = None) -> DataFrame:
    """P4 apply: replace the values by their codes; unseen ones become -1."""
    table = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    keyed = df.withColumn("_value", F.coalesce(F.col(column), F.lit(MISSING)))
    joined = attach(keyed, table, ["_value"], hot)
    return joined.withColumn(column, F.coalesce(F.col("_code"), F.lit(-1))).select(*df.columns)


def categories(df: DataFrame, column: str, limit: int = ONE_HOT_LIMIT) -> list[str]:
    """P5 fit: sorted categories; more than ``limit`` of them cannot be one-hot columns."""
    rows = df.select(F.coalesce(F.col(column), F.lit(MISSING)).alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories, too many for columns; use one_hot_vector")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, column: str, known: Sequence[str], drop_first: bool = False) -> DataFrame:
    """P5: an int column ``<column>_<category>`` per category; unseen values are all zeros."""
    value = F.coalesce(F.col(column), F.lit(MISSING))
    kept = list(known)[1:] if drop_first else known
    return df.withColumns({f"{column}_{v}": (value == v).cast("int") for v in kept}).drop(column)


def one_hot_vector(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """P5 for any number of categories: a sparse 0/1 vector ``out`` by the codes of P4; unseen values are all zeros."""
    size = codes.count()
    encoder = OneHotEncoder(inputCols=["_place"], outputCols=[out], dropLast=True, handleInvalid="keep")
    model = encoder.fit(codes.select(F.col("code").cast("double").alias("_place")))
    coded = label_encode(df.withColumn("_place", F.col(column)), "_place", codes)
    unseen = F.when(F.col("_place") < 0, size).otherwise(F.col("_place"))
    return model.transform(coded.withColumn("_place", unseen.cast("double"))).drop("_place")


def dummies(df: DataFrame, columns: Sequence[str], training_columns: Sequence[str]) -> DataFrame:
    """One-hot without the first category, aligned to the training columns."""
    for c in columns:
        df = one_hot(df, c, categories(df, c), drop_first=True)
    return align_columns(df, training_columns)


# -------------------------------------------------------- P7, P9: amounts

def amount_params(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """P7 fit: median, ε (smallest positive value / 1000, else 0.001) and whether ε is needed.

    With a missing positive value the smallest is taken as 1.0. The median fill
    is itself a value of the table, so it can be the smallest positive one only if it is positive.
    """
    medians = quantiles(df, {c: [0.5] for c in columns})

    def filled(c: str):
        value = F.col(c).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(medians[c][0]))

    row = df.agg(
        *[F.min(F.when(filled(c) > 0, filled(c))).alias(f"low_{c}") for c in columns],
        *[F.max((filled(c) <= 0).cast("int")).alias(f"shift_{c}") for c in columns],
    ).first()
    return {
        c: {
            "median": medians[c][0],
            "epsilon": (row[f"low_{c}"] if row[f"low_{c}"] is not None else 1.0) / 1000,
            "shift": bool(row[f"shift_{c}"]),
        }
        for c in columns
    }


def log_amounts(df: DataFrame, params: dict[str, dict]) -> DataFrame:
    """P7 apply: log1p of the (shifted) amount; ``<c>_original`` is that amount less ε."""
    out = {}
    for c, p in params.items():
        value = F.col(c).cast("double")
        value = F.coalesce(F.when(~F.isnan(value), value), F.lit(p["median"]))
        value = value + (p["epsilon"] if p["shift"] else 0.0)
        out[f"{c}_original"] = value - p["epsilon"]
        out[c] = F.log1p(value)
    return df.withColumns(out)


def detect_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(amount columns, categorical columns), from the schema and one aggregate."""
    numeric = numeric_columns(df)
    ends = df.agg(
        *[F.min(c).alias(f"min_{c}") for c in numeric], *[F.max(c).alias(f"max_{c}") for c in numeric]
    ).first() if numeric else {}

    def looks_like_amount(c: str) -> bool:
        if "amount" in c.lower():
            return True
        return c in numeric and ends[f"max_{c}"] is not None and ends[f"max_{c}"] > 1 and ends[f"min_{c}"] >= 0

    amounts = [c for c in df.columns if looks_like_amount(c)]
    return amounts, [c for c in text_columns(df) if "timestamp" not in c.lower()]


# --------------------------------------------------------------- P8: nulls

def default_strategy(kind: T.DataType) -> str:
    return "median" if isinstance(kind, T.NumericType) else "mode"


def imputation(df: DataFrame, strategy: dict[str, str] | None = None) -> dict[str, dict]:
    """P8 fit: per column the strategy and its fill value; columns without nulls need none."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in df.columns]).first()
    holes = [c for c in df.columns if counts[c] < counts["_n"]]
    plan = {c: (strategy or {}).get(c, default_strategy(kinds[c])) for c in holes}
    filled = [c for c in holes if counts[c] > 0]
    constant = {c: (0 if isinstance(kinds[c], T.NumericType) else False if isinstance(kinds[c], T.BooleanType) else "UNKNOWN") for c in holes}

    def using(name: str) -> list[str]:
        return [c for c in filled if plan[c] == name]

    values: dict[str, object] = {c: constant[c] for c in holes}
    medians, means, common = using("median"), using("mean"), using("mode")
    if medians:
        values.update({c: v[0] for c, v in quantiles(df, {c: [0.5] for c in medians}).items()})
    if means:
        values.update(df.agg(*[F.avg(c).alias(c) for c in means]).first().asDict())
    text = [c for c in common if isinstance(kinds[c], T.StringType)]
    values.update({c: v for c, (v, _) in modes(df, text).items()})
    times = [c for c in common if isinstance(kinds[c], T.TimestampType)]
    if times:  # a time is compared as microseconds and kept as such
        as_long = df.select(*[F.unix_micros(c).alias(c) for c in times])
        values.update({c: int(v) for c, (v, _) in modes(as_long, times, "long").items()})
    other = [c for c in common if c not in text and c not in times]
    values.update({c: v for c, (v, _) in modes(df, other, "double").items()})
    return {
        c: {"strategy": plan[c], "value": values[c], "micros": c in times} for c in holes
    }


def impute(df: DataFrame, params: dict[str, dict]) -> DataFrame:
    """P8 apply."""
    drops = [c for c, p in params.items() if p["strategy"] == "drop"]
    if drops:
        df = df.na.drop(subset=drops)
    fills = {}
    for c, p in params.items():
        if p["strategy"] == "drop" or c not in df.columns:
            continue
        value = p["value"]
        if p.get("micros"):
            value = datetime.fromtimestamp(value // 1_000_000, timezone.utc).replace(
                microsecond=value % 1_000_000
            )
        fills[c] = value
    return fill_nulls(df, fills) if fills else df


# ------------------------------------------------------ P10: fit/transform

class Preprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """P10: parse → impute → log amounts → label codes, fitted as one model."""

    timeCol = Param(Params._dummy(), "timeCol", "timestamp column", TypeConverters.toString)
    amountCols = Param(Params._dummy(), "amountCols", "amount columns", TypeConverters.toListString)
    categoryCols = Param(Params._dummy(), "categoryCols", "label-coded columns", TypeConverters.toListString)

    def __init__(self, timeCol: str = COLUMNS.time, amountCols: Sequence[str] = (COLUMNS.amount,),
                 categoryCols: Sequence[str] = ()):
        super().__init__()
        self._set(timeCol=timeCol, amountCols=list(amountCols), categoryCols=list(categoryCols))

    def _fit(self, df: DataFrame) -> "PreprocessorModel":
        time, amounts = self.getOrDefault("timeCol"), self.getOrDefault("amountCols")
        codes = self.getOrDefault("categoryCols")
        parsed = parse_times(df, time)
        fills = imputation(parsed)
        filled = impute(parsed, fills)
        state = {
            "time": time,
            "fills": fills,
            "amounts": amount_params(filled, amounts) if amounts else {},
            # A written table (value, code) for each label-coded column, however many values it has.
            "codes": {c: written(code_table(filled, c), "codes") for c in codes},
        }
        return PreprocessorModel(json.dumps(state))


def written(df: DataFrame, label: str) -> str:
    """The path of a table written to the work folder."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


class PreprocessorModel(Model, MLReadable, MLWritable):
    """The fitted parameters as JSON and the code tables as Parquet; ``transform`` is expressions and joins with the codes,
    so it also runs on streams."""

    state = Param(Params._dummy(), "state", "fitted parameters as JSON", TypeConverters.toString)

    def __init__(self, state: str = "{}"):
        super().__init__()
        self._set(state=state)

    def _transform(self, df: DataFrame) -> DataFrame:
        s = json.loads(self.getOrDefault("state"))
        out = impute(parse_times(df, s["time"]), s["fills"])
        out = log_amounts(out, s["amounts"])
        for c, path in s["codes"].items():
            out = label_encode(out, c, df.sparkSession.read.schema(CODES).parquet(path))
        return out

    def write(self) -> "CodesWriter":
        return CodesWriter(self)

    @classmethod
    def read(cls) -> "CodesReader":
        return CodesReader()


class CodesWriter(MLWriter):
    """Parameters by the default writer, and each code table beside them."""

    def __init__(self, model: PreprocessorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for k, at in enumerate(json.loads(self.model.getOrDefault("state"))["codes"].values()):
            self.sparkSession.read.schema(CODES).parquet(at).write.parquet(f"{path}/codes/{k}")


class CodesReader(MLReader):
    def load(self, path: str) -> PreprocessorModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        state = json.loads(found["paramMap"]["state"])
        state["codes"] = {c: f"{path}/codes/{k}" for k, c in enumerate(state["codes"])}
        model = PreprocessorModel(json.dumps(state))
        model._resetUid(found["uid"])
        return model
