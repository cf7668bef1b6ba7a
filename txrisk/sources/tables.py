"""Transaction views over the star-schema tables (see FIXTURES.md §2).

Every view is a projection: no row is dropped, sampled or moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def label_of_event() -> Column:
    return F.when((F.col("event_type") == "error") & (F.col("k") < 20), 1).otherwise(0)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a ten-column transaction table."""
    return as_transactions(table(spark, sf_dir, "events"))


def as_transactions(events: DataFrame) -> DataFrame:
    return events.withColumn("k", event_number()).select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("S"), "user_id").alias("sender_account"),
        F.concat(F.lit("R"), "k").alias("receiver_account"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("transaction_type"),
        F.concat(F.lit("M"), F.col("event_id") % 8).alias("merchant_category"),
        F.concat(F.lit("L"), (F.col("user_id") + F.col("k")) % 6).alias("location"),
        F.concat(F.lit("D"), F.col("k") % 4).alias("device_used"),
        label_of_event().alias("is_fraud"),
    )


def with_hourly_ties(tx: DataFrame) -> DataFrame:
    """Timestamps cut to the hour, so that many rows of a sender share one."""
    return tx.withColumn("timestamp", F.date_trunc("hour", "timestamp"))


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, padding, empty strings, outliers and repeated rows, by event number."""
    n = F.col("transaction_id").cast("long")
    tx = transactions(spark, sf_dir)
    dirty = tx.select(
        "transaction_id",
        "timestamp",
        F.when(n % 101 == 0, None).otherwise(F.col("sender_account")).alias("sender_account"),
        "receiver_account",
        F.when(n % 13 == 0, None)
        .when(n % 997 == 0, F.col("amount") * 1000)
        .otherwise(F.col("amount"))
        .alias("amount"),
        "transaction_type",
        "merchant_category",
        F.when(n % 7 == 0, F.concat(F.lit("  "), "location", F.lit(" ")))
        .otherwise(F.col("location"))
        .alias("location"),
        F.when(n % 17 == 0, "").otherwise(F.col("device_used")).alias("device_used"),
        "is_fraud",
    )
    # Every fiftieth row appears twice, made by explode: one scan and no union.
    copies = F.when(F.col("transaction_id").cast("long") % 50 == 0, F.sequence(F.lit(0), F.lit(1)))
    return dirty.select("*", F.explode(copies.otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def raw_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transaction_id, raw): each row's time written in one of six text formats, or garbage."""
    tx = transactions(spark, sf_dir)
    n = F.col("transaction_id").cast("long") % 7
    t = F.col("timestamp")
    fmt = F.when(n == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    fmt = fmt.when(n == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
    fmt = fmt.when(n == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    fmt = fmt.when(n == 3, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    fmt = fmt.when(n == 4, F.date_format(t, "MM/dd/yyyy HH:mm:ss"))
    fmt = fmt.when(n == 5, F.date_format(t, "dd/MM/yyyy HH:mm:ss")).otherwise("garbage")
    return tx.select("transaction_id", fmt.alias("raw"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p): a deterministic score in thousandths, with many equal values."""
    ev = table(spark, sf_dir, "events").withColumn("k", event_number())
    y = label_of_event()
    p = ((F.col("k") * 37 + F.col("event_id") * 11) % 600 + 400 * y) / F.lit(1000.0)
    return ev.select(
        F.col("event_id").cast("string").alias("transaction_id"), y.alias("y"), p.alias("p")
    )


def orders_as_wide_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as transactions: few senders, day-granular times, heavy ties."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_suppkey").cast("string").alias("sender_account"),
        F.col("l_partkey").cast("string").alias("receiver_account"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipmode" if "l_shipmode" in li.columns else "l_linestatus").alias("location"),
        F.col("l_linestatus").alias("device_used"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"),
    )
