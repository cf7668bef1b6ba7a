"""Writing predictions and reports (S8-S12). Every sink is a folder of partition files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT_VERSION = "1.0"


def write_csv(predictions: DataFrame, path: str) -> None:
    """S8."""
    predictions.write.mode("overwrite").option("header", True).csv(path)


def finite_only(df: DataFrame) -> DataFrame:
    """NaN and infinities have no JSON form; they become NULL."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in doubles}) if doubles else df


def write_json(predictions: DataFrame, path: str) -> None:
    """JSON lines, and a one-row metadata table beside them, counted from what was written."""
    spark = predictions.sparkSession
    finite_only(predictions).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/rows")
    written = spark.read.schema(predictions.schema).json(f"{path}/rows")
    written.agg(F.count("*").alias("count")).select(
        "count", F.current_timestamp().alias("generated_at"), F.lit(FORMAT_VERSION).alias("format_version")
    ).write.mode("overwrite").json(f"{path}/metadata")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each report table as CSV and as JSON under its name."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}/csv")
        finite_only(df).write.mode("overwrite").json(f"{path}/{name}/json")


def write_evaluation(result: DataFrame, settings: dict, path: str) -> None:
    """The evaluation row and the settings it came from."""
    spark: SparkSession = result.sparkSession
    finite_only(result).write.mode("overwrite").json(f"{path}/evaluation")
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").write.mode("overwrite").text(
        f"{path}/settings"
    )


def project(predictions: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return predictions.select(*[c for c in wanted if c in predictions.columns])
