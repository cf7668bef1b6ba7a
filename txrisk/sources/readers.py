"""Reading transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalars import parse_timestamp, text_or
from txrisk.operators.quality import require_binary, require_columns
from txrisk.schema import COLUMNS, REQUEST, TRANSACTION
from txrisk.session import ship

# The declared type of a CSV column is text first: a bad cell becomes NULL, not a failed job.
NUMERIC = {f.name: f.dataType for f in TRANSACTION.fields if isinstance(f.dataType, T.NumericType)}


def read_csv(spark: SparkSession, path: str, label: bool = True) -> DataFrame:
    """S1 (with label) and S3 (without): the header decides the columns, the schema their types."""
    raw = ship(spark).read.option("header", True).csv(path)  # header only: no inference pass over the data
    df = require_columns(raw, COLUMNS.required() + ([COLUMNS.label] if label else []))
    return typed(df)


def typed(df: DataFrame) -> DataFrame:
    """Cast text columns to the transaction types; unreadable values are NULL."""
    casts = {c: F.col(c).try_cast(k) for c, k in NUMERIC.items() if c in df.columns}
    if COLUMNS.time in df.columns and isinstance(df.schema[COLUMNS.time].dataType, T.StringType):
        casts[COLUMNS.time] = parse_timestamp(F.col(COLUMNS.time))
    return df.withColumns(casts)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columnar input; zone-less times become session-zone timestamps."""
    df = ship(spark).read.parquet(path)
    return df.withColumn(COLUMNS.time, F.col(COLUMNS.time).cast("timestamp")) if COLUMNS.time in df.columns else df


def first_rows(df: DataFrame, n: int, key: str = COLUMNS.id) -> DataFrame:
    """A fixed head: Spark keeps the n smallest keys per task and merges them."""
    return df.orderBy(key).limit(n)


REQUEST_LIST = T.ArrayType(REQUEST)
ENVELOPE = T.StructType([T.StructField("transactions", REQUEST_LIST), *REQUEST.fields])


def parse_requests(bodies: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts of three shapes, a list, ``{"transactions": [...]}`` or one object → rows."""
    text = F.trim(F.col(column))
    listed = F.from_json(text, REQUEST_LIST)
    wrapped = F.from_json(text, ENVELOPE)
    single = F.array(F.struct(*[wrapped[f.name].alias(f.name) for f in REQUEST.fields]))
    rows = F.when(text.startswith("["), listed).otherwise(F.coalesce(wrapped["transactions"], single))
    return bodies.select(F.inline(rows))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of whole JSON documents, one document per file."""
    return parse_requests(ship(spark).read.text(path, wholetext=True))


def one_transaction(spark: SparkSession, body: str) -> DataFrame:
    """S5."""
    return parse_requests(spark.createDataFrame([(body,)], "value string"))


# What a request field is when it is missing or empty.
DEFAULTS = {
    "sender_account": "sender_unknown",
    "receiver_account": "receiver_unknown",
    "transaction_type": "payment",
    "merchant_category": "retail",
    "location": "unknown",
    "device_used": "mobile",
}


def normalise_requests(raw: DataFrame) -> DataFrame:
    """Requests with defaults, as typed transactions.

    A missing id is a hash of the content, so a retried batch names its rows alike.
    """
    missing = [f.name for f in REQUEST.fields if f.name not in raw.columns]
    full = raw.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else raw
    content = F.sha2(F.to_json(F.struct(*[F.col(f.name) for f in REQUEST.fields])), 256)
    given = F.nullif(F.col("timestamp").cast("string"), F.lit(""))
    amount = F.nullif(F.col("amount").cast("string"), F.lit(""))
    return full.select(
        F.coalesce(
            F.nullif(F.col("transaction_id"), F.lit("")), F.concat(F.lit("tx_"), F.substring(content, 1, 16))
        ).alias("transaction_id"),
        F.when(given.isNull(), F.current_timestamp()).otherwise(parse_timestamp(given)).alias("timestamp"),
        *[text_or(c, DEFAULTS[c]).alias(c) for c in ("sender_account", "receiver_account")],
        F.when(amount.isNull(), F.lit(0.0)).otherwise(amount.try_cast("double")).alias("amount"),
        *[
            text_or(c, DEFAULTS[c]).alias(c)
            for c in ("transaction_type", "merchant_category", "location", "device_used")
        ],
    )


def load_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """A labelled table with checked columns and labels; CSV or Parquet by suffix."""
    df = read_csv(spark, path) if path.rstrip("/").endswith(".csv") else read_parquet(spark, path)
    return require_binary(require_columns(df, [*COLUMNS.required(), COLUMNS.label]))
