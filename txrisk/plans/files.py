"""Queries that write the tables to files and read them back: sources, sinks, checks and stored models."""

from __future__ import annotations


from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from txrisk.operators import metrics, preprocess, quality, splits
from txrisk.schema import COLUMNS, EXTENDED_TRANSACTION, TRANSACTION
from txrisk.session import new_path
from txrisk.sources import readers, tables, writers
from txrisk.streaming import jobs


def _as_csv(spark: SparkSession, d: str, *without: str) -> str:
    path = f"{new_path(spark, 'csv')}.csv"
    tx = tables.transactions(spark, d).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    writers.write_csv(tx.drop(*without), path)
    return path


def s1(spark, d):
    read = readers.read_csv(spark, _as_csv(spark, d))
    return read.select("transaction_id", F.unix_micros("timestamp").alias("micros"), "receiver_account", F.round("amount", 4).alias("amount"), "is_fraud")


def s2(spark, d):
    return readers.first_rows(tables.transactions(spark, d), 100).select("transaction_id", F.round("amount", 4).alias("amount"))


def s3(spark, d):
    read = readers.read_csv(spark, _as_csv(spark, d, "is_fraud"), label=False)
    return read.groupBy("transaction_type").agg(F.count("*").alias("n_rows"), F.round(F.sum("amount"), 4).alias("amount"))


def s5(spark, d):
    """The newest transaction as the JSON text of a request."""
    last = tables.transactions(spark, d).orderBy(F.col("timestamp").desc(), F.col("transaction_id").desc()).limit(1)
    body = last.select(F.to_json(F.struct("transaction_id", "sender_account", "amount", "location"))).first()[0]
    return readers.one_transaction(spark, body).select("transaction_id", "sender_account", F.col("amount").cast("double").alias("amount"), "location")


def s6(spark, d):
    path = new_path(spark, "evaluation")
    tables.transactions(spark, d).write.parquet(path)
    return readers.load_evaluation(spark, path).groupBy("is_fraud").agg(F.count("*").alias("n_rows"), F.countDistinct("sender_account").alias("n_senders"))


def s8(spark, d):
    path = new_path(spark, "sink")
    writers.write_csv(tables.scored(spark, d), path)
    read = spark.read.option("header", True).schema("transaction_id string, y int, p double").csv(path)
    return read.select("transaction_id", "y", "p")


def s9(spark, d):
    """Rows beside the count that the metadata tell; scores that are no numbers come back as nulls."""
    path = new_path(spark, "sink")
    odd = F.when(F.col("transaction_id").cast("long") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("p"))
    writers.write_json(tables.scored(spark, d).withColumn("p", odd), path)
    told = spark.read.json(f"{path}/metadata").select("count").scalar()
    rows = spark.read.schema("transaction_id string, y int, p double").json(f"{path}/rows")
    return rows.agg(F.count("*").alias("n_rows"), F.count("p").alias("n_numbers"), F.sum("y").alias("n_positive")).withColumn("n_told", told)


def s10(spark, d):
    path = new_path(spark, "report")
    sweep = metrics.sweep_table(tables.scored(spark, d)).select("threshold", "tp", "fp", "fn", "tn")
    writers.write_report({"sweep": sweep}, path)
    read = spark.read.schema("threshold double, tp long, fp long, fn long, tn long")
    return read.option("header", True).csv(f"{path}/sweep/csv").join(read.json(f"{path}/sweep/json"), ["threshold", "tp", "fp", "fn", "tn"])


def s11(spark, d):
    path = new_path(spark, "evaluation")
    row = metrics.comprehensive(tables.scored(spark, d), 0.5).select("tp", "fp", "fn", "tn")
    writers.write_evaluation(row, {"threshold": 0.5}, path)
    settings = F.get_json_object(spark.read.text(f"{path}/settings").select("value").scalar(), "$.threshold").cast("double")
    return spark.read.schema("tp long, fp long, fn long, tn long").json(f"{path}/evaluation").withColumn("threshold", settings)


def s12(spark, d):
    return writers.project(tables.scored(spark, d), ["p", "absent", "transaction_id"])


def v2(spark, d):
    """Rows that pass the check of columns and of the least number of rows."""
    tx = quality.bound_rows(quality.require_columns(tables.dirty_transactions(spark, d), COLUMNS.required()), 100)
    return tx.agg(F.count("*").alias("n_rows"), F.count("amount").alias("n_amounts"))


def v14(spark, d):
    """How a table with a column too many, one too few and one of another type departs from the transaction schema."""
    odd = tables.transactions(spark, d).drop("location").withColumns({"amount": F.col("amount").cast("string"), "extra": F.lit(1)})
    found = quality.compare_schema(odd, TRANSACTION)
    rows = [(c, "missing") for c in found["missing"]] + [(c, "extra") for c in found["extra"]] + [(c, "type") for c in found["mismatched"]]
    told = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("problem")) for c, k in rows])
    return odd.agg(F.count("*").alias("n_rows")).select(F.inline(told), "n_rows")


def v16(spark, d):
    aligned = quality.align_columns(tables.transactions(spark, d), ["transaction_id", "amount", "absent"], "mean")
    return aligned.withColumn("amount", F.round("amount", 4))


def v17(spark, d):
    found = quality.completeness(tables.transactions(spark, d), ["amount", "timestamp", "absent"])
    return tables.transactions(spark, d).agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(found["found"]).alias("n_found"), F.lit(",".join(found["missing"])).alias("missing"), F.lit(len(found["extra"])).alias("n_extra")
    )


def p5_vector(spark, d):
    """The place that each transaction type has in its one-hot vector."""
    tx = tables.transactions(spark, d)
    coded = preprocess.one_hot_vector(tx, "transaction_type", preprocess.code_table(tx, "transaction_type"), "v")
    hot = F.filter(F.transform(vector_to_array("v"), lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return coded.select("transaction_id", hot[0].alias("place"), F.size(vector_to_array("v")).alias("width"))


def p10(spark, d):
    """Fitted, saved, loaded and applied."""
    tx = tables.transactions(spark, d)
    path = new_path(spark, "prep")
    preprocess.Preprocessor(categoryCols=["location", "device_used", "merchant_category"]).fit(tx).write().save(path)
    out = preprocess.PreprocessorModel.load(path).transform(tx)
    return out.select("transaction_id", F.round("amount", 6).alias("amount"), "location", "device_used", "merchant_category")


def d9(spark, d):
    out = splits.canonical_order(tables.transactions(spark, d))
    assert out.columns == EXTENDED_TRANSACTION.names
    given = [c for c in out.columns if c in TRANSACTION.names]
    return out.select("transaction_id", F.round("amount", 4).alias("amount"), *[
        F.lit(sum(c not in given for c in out.columns)).alias("n_empty")
    ])


def e30(spark, d):
    """Batches and rows of a stream of one file a day, from the table of all its progress entries."""
    at = new_path(spark, "progress")
    tx = tables.transactions(spark, d).withColumn("_day", F.to_date("timestamp"))
    tx.repartition("_day").write.partitionBy("_day").parquet(f"{at}/in")
    log = jobs.ProgressLog(spark, f"{at}/log")
    stream = spark.readStream.schema(TRANSACTION).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    query = jobs.run_batches(stream, f"{at}/out", f"{at}/checkpoint")
    query.awaitTermination()
    log.close(query)
    return jobs.latency_report(log.table()).select("n_batches", "n_rows", (F.col("p95_ms") >= F.col("median_ms")).alias("ordered"))


def queries() -> dict:
    return {
        "s1_csv_with_label": s1, "s2_first_rows": s2, "s3_csv_without_label": s3, "s5_one_request": s5, "s6_load_evaluation": s6,
        "s8_csv_sink": s8, "s9_json_sink": s9, "s10_report": s10, "s11_evaluation_sink": s11, "s12_project": s12,
        "v2_bound_rows": v2, "v14_compare_schema": v14, "v16_align_columns": v16, "v17_completeness": v17,
        "p5_one_hot_vector": p5_vector, "p10_preprocessor": p10, "d9_canonical_order": d9, "e30_latency_report": e30,
    }
