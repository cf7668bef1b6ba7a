"""Streams with state: the same rows however the stream is cut, state that goes, and a full record of progress."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.ml import forest
from txrisk.ml.model import RiskModel
from txrisk.operators import features
from txrisk.sources import tables
from txrisk.streaming import jobs
from txrisk.streaming.state import StateTable

SMALL = forest.ForestSettings(hidden=8, trees=5, sample=32)


@pytest.fixture(scope="module")
def tx(spark, sf):
    return tables.transactions(spark, sf)


@pytest.fixture(scope="module")
def model(tx):
    return RiskModel.fit(tx, rounds=4, forest=SMALL)


def cut(df, path, pieces):
    """The table as files in time order, read one a batch (by modification time)."""
    rows = df.orderBy("timestamp", "transaction_id").toPandas()
    schema = df.schema
    for k, part in enumerate(np.array_split(np.arange(len(rows)), pieces)):
        target = os.path.join(path, f"part-{k:03d}")
        df.sparkSession.createDataFrame(rows.iloc[part], schema).coalesce(1).write.parquet(target)
        name = next(f for f in os.listdir(target) if f.endswith(".parquet"))
        flat = os.path.join(path, f"{k:03d}.parquet")
        os.rename(os.path.join(target, name), flat)
        os.utime(flat, (1_700_000_000 + k, 1_700_000_000 + k))
        for f in os.listdir(target):
            os.remove(os.path.join(target, f))
        os.rmdir(target)
    return path


def test_scores_do_not_depend_on_the_cut(spark, tx, model, tmp_path):
    got = {}
    for pieces in (1, 3, 10):
        folder = tmp_path / f"in{pieces}"
        folder.mkdir()
        stream = jobs.transaction_stream(spark, cut(tx, str(folder), pieces), 1)
        out = f"{tmp_path}/out{pieces}"
        jobs.score_stream(stream, model, out, f"{tmp_path}/c{pieces}", state=f"{tmp_path}/s{pieces}", every=4).awaitTermination()
        rows = spark.read.parquet(out)
        assert rows.count() == 1000 and rows.select("batch").distinct().count() == pieces
        got[pieces] = {r["transaction_id"]: r["fraud_probability"] for r in rows.collect()}
    assert got[1] == pytest.approx(got[3]) and got[1] == pytest.approx(got[10])
    kept = sorted(f for f in os.listdir(f"{tmp_path}/s10/seen") if not f.startswith("."))
    assert "base-8" in kept and "base-4" in kept and "batch-3" not in kept and "batch-9" in kept


def test_state_tables_are_merged_and_read_below_a_number(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    table = StateTable(spark, f"{tmp_path}/t", schema, lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), every=3)
    assert table.before(5).count() == 0
    for number in range(11):
        table.compact(number)
        table.compact(number)  # repeated after a failure
        total = {r["k"]: r["n"] for r in table.before(number).groupBy("k").agg(F.sum("n").alias("n")).collect()}
        assert total == ({"a": number} if number else {})
        table.write(spark.createDataFrame([("a", 1)], schema), number)
        table.write(spark.createDataFrame([("a", 1)], schema), number)
    assert table._numbers("base") == [6, 9] and table._numbers("batch") == [6, 7, 8, 9, 10]


def test_history_as_sums_gives_the_features_of_whole_history(tx, model):
    """Features from the last day's rows and sums are those from all earlier rows at once."""
    rows = tx.orderBy("timestamp", "transaction_id")
    last = rows.orderBy(F.col("timestamp").desc(), F.col("transaction_id").desc()).limit(40)
    earlier = tx.join(last.select("transaction_id"), "transaction_id", "left_anti")
    names = model.feature_names
    got = {r["transaction_id"]: [r[c] for c in names] for r in model.features(last, earlier).select("transaction_id", *names).collect()}
    ready, past = model.prepared(last.drop("is_fraud")), model.prepared(earlier.drop("is_fraud"))
    want = features.engineer(ready, history=past, stats=model.receivers, own=model.own).select("transaction_id", *names).collect()
    assert len(want) == 40
    for r in want:
        assert got[r["transaction_id"]] == pytest.approx([r[c] for c in names], abs=1e-5)


@pytest.mark.parametrize("hours", [1, 4, 24])
def test_blocks_of_time_give_the_sender_windows(spark, tx, tmp_path, hours):
    busy = tx.withColumn("sender_account", F.when(F.col("transaction_id").cast("long") % 2 == 0, "S0").otherwise(F.col("sender_account")))
    folder = tmp_path / "in"
    folder.mkdir()
    stream = jobs.transaction_stream(spark, cut(busy, str(folder), 4), 1)
    done = jobs.run_to_table(jobs.velocity_stream(stream, hours=hours), f"{tmp_path}/o", f"{tmp_path}/c")
    names = ["tx_count_last_1h", "tx_count_last_24h", "total_amount_last_24h", "velocity_1h"]
    got = {r["transaction_id"]: tuple(r[c] for c in names) for r in done.collect()}
    want = {r["transaction_id"]: tuple(r[c] for c in names) for r in features.sender_windows(busy).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_busy_sender_is_dealt_to_many_blocks(tx):
    one = tx.filter("sender_account IS NOT NULL").select(
        F.lit("S0").alias("sender_account"), F.col("timestamp").alias("at"), "transaction_id", features.micros("timestamp").alias("us"), "amount"
    )
    fresh = jobs.dealt_to_blocks(one).filter(F.col("kind") == jobs.FRESH).groupBy("block").count()
    assert fresh.agg(F.max("count")).first()[0] < 30 and fresh.agg(F.sum("count")).first()[0] == 1000


def test_idle_state_goes(spark, tmp_path):
    """After a row of much later, the timers have cleared every older block."""
    schema = "transaction_id string, timestamp timestamp, sender_account string, receiver_account string, amount double"
    first = [(str(k), f"S{k % 5}", 1.0) for k in range(200)]
    early = spark.createDataFrame(first, "transaction_id string, sender_account string, amount double").selectExpr(
        "transaction_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(transaction_id as int)) AS timestamp", "sender_account",
        "'R' AS receiver_account", "amount")
    folder = tmp_path / "in"
    folder.mkdir()
    for k, (df, name) in enumerate([(early, "a"), (spark.sql("SELECT 'x' AS transaction_id, timestamp'2024-03-01 00:00:00' AS timestamp, 'S9' AS sender_account, 'R' AS receiver_account, 1.0D AS amount"), "b"),
                                    (spark.sql("SELECT 'y' AS transaction_id, timestamp'2024-03-01 00:00:01' AS timestamp, 'S9' AS sender_account, 'R' AS receiver_account, 1.0D AS amount"), "c")]):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        part = next(f for f in os.listdir(f"{tmp_path}/{name}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/{name}/{part}", folder / f"{name}.parquet")
        os.utime(folder / f"{name}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    assert schema
    velocity = jobs.velocity_stream(jobs.transaction_stream(spark, str(folder), 1))
    query = velocity.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/o")
    query.awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "held").option("flattenCollectionTypes", True).load(f"{tmp_path}/c")
    assert {r[0] for r in held.select("key.sender_account").distinct().collect()} == {"S9"}


def test_progress_of_all_batches_is_kept(spark, tx, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    cut(tx, str(folder), 14)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        log = jobs.ProgressLog(spark, f"{tmp_path}/progress")
        query = jobs.windows_with_history(jobs.transaction_stream(spark, str(folder), 1), f"{tmp_path}/s", f"{tmp_path}/o", f"{tmp_path}/c")
        query.awaitTermination()
        log.close(query)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert len(query.recentProgress) <= 3
    row = jobs.latency_report(log.table()).first()
    assert row["n_batches"] == 14 and row["n_rows"] == 1000
    ms = [r["ms"] for r in log.table().collect()]
    assert row["mean_ms"] == pytest.approx(np.mean(ms)) and row["p95_ms"] == pytest.approx(np.quantile(ms, 0.95))
