"""Structured Streaming jobs over arriving transactions.

Each micro-batch is written once under its batch id, so a batch repeated after a failure
replaces its own output and never doubles it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from threading import Event

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from txrisk.ml.model import Past, RiskModel
from txrisk.operators import features, quality
from txrisk.operators.registry import put_if_absent
from txrisk.schema import COLUMNS, REQUEST, TRANSACTION, Columns
from txrisk.session import ship
from txrisk.sources.readers import normalise_requests
from txrisk.streaming.state import EVERY, StateTable

HISTORY = "24 hours"


def request_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON request lines from a folder that other jobs write to."""
    raw = ship(spark).readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return normalise_requests(raw)


def transaction_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Typed Parquet transactions as they arrive."""
    return (
        ship(spark).readStream.schema(TRANSACTION).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write_batch(df: DataFrame, out: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def run_batches(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch under its number."""
    return _run(stream, lambda batch, number: _write_batch(batch, out, number), checkpoint)


# ------------------------------------------- T1, T2, T6: batches with state

LATE = "7 days"  # how far behind the newest row a row may come and still find its whole window in the state


def used_schema(cols: Columns) -> T.StructType:
    return T.StructType([
        T.StructField(cols.sender, T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("n", T.LongType()),
    ])


def pairs_schema(cols: Columns) -> T.StructType:
    return T.StructType([
        T.StructField(cols.sender, T.StringType()), T.StructField(cols.receiver, T.StringType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()),
    ])


@dataclass
class StreamState:
    """What a stream remembers: recent rows, what each sender used, and what each pair did."""

    rows: StateTable
    seen: StateTable
    pairs: StateTable
    cols: Columns

    @classmethod
    def at(cls, spark: SparkSession, path: str, schema: T.StructType, cols: Columns = COLUMNS, late: str = LATE, every: int = EVERY) -> "StreamState":
        def recent(df: DataFrame) -> DataFrame:
            newest = df.agg(F.max(cols.time).alias("t")).scalar()
            return df.filter(F.col(cols.time) >= newest - F.expr(f"INTERVAL {HISTORY}") - F.expr(f"INTERVAL {late}"))

        return cls(
            StateTable(spark, f"{path}/rows", schema, recent, every),
            StateTable(spark, f"{path}/seen", used_schema(cols), lambda df: df.groupBy(cols.sender, "kind", "value").agg(F.sum("n").alias("n")), every),
            StateTable(spark, f"{path}/pairs", pairs_schema(cols), lambda df: df.groupBy(cols.sender, cols.receiver).agg(F.sum("n").alias("n"), F.sum("total").alias("total")), every),
            cols,
        )

    def add(self, rows: DataFrame, number: int) -> DataFrame:
        """Store a batch and give it back from its files: its own plan is not run a second time."""
        for table in (self.rows, self.seen, self.pairs):
            table.compact(number)
        self.rows.write(rows, number)
        stored = self.rows.batch(number)
        self.seen.write(features.seen_values(stored, self.cols), number)
        self.pairs.write(features.pair_totals(stored, self.cols), number)
        return stored

    def past(self, stored: DataFrame, number: int) -> Past:
        start = stored.agg((F.min(self.cols.time) - F.expr(f"INTERVAL {HISTORY}")).alias("t")).first()["t"]
        recent = self.rows.before(number).filter(F.col(self.cols.time) >= F.lit(start))
        return Past(recent, self.seen.before(number), self.pairs.before(number), upto_row=True)


def score_stream(
    stream: DataFrame, model: RiskModel, out: str, checkpoint: str, history: DataFrame | None = None, state: str | None = None,
    late: str = LATE, every: int = EVERY,
) -> StreamingQuery:
    """Predictions of every arriving row; rows that cannot be scored become error rows.

    Scores use the training range. With a ``state`` folder the features continue over batches, and a row's pair features
    count the rows up to it: however a stream in time order is cut into batches, its rows score alike. ``history``
    are rows from before the stream; with a state they are its first batch.
    """
    spark, cols = stream.sparkSession, model.cols

    def each(batch: DataFrame, number: int) -> None:
        if state is None:
            _write_batch(model.transform(batch, history), out, number)
            return
        good, bad = model.judged(batch)
        ready = model.prepared(good.withColumnRenamed(cols.label, "_set_aside"))
        memory = StreamState.at(spark, state, ready.schema, cols, late, every)
        if number == 0 and history is not None:
            old = quality.coerce_amounts(quality.trim_text(history))
            memory.add(model.prepared(old.withColumnRenamed(cols.label, "_set_aside")), 0)
        stored = memory.add(ready, number + 1)
        _write_batch(model.predictions(model.completed(stored, memory.past(stored, number + 1)), bad), out, number)

    return _run(stream, each, checkpoint)


def windows_with_history(
    stream: DataFrame, state: str, out: str, checkpoint: str, cols: Columns = COLUMNS, late: str = LATE, every: int = EVERY
) -> StreamingQuery:
    """F2 and F4 of each micro-batch as if the stream had never been cut."""
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        memory = StreamState.at(spark, state, batch.schema, cols, late, every)
        rows = memory.add(batch, number)
        past = memory.past(rows, number)
        senders = rows.select(cols.sender).distinct()
        near = past.recent.join(senders, cols.sender, "left_semi").withColumn("_new", F.lit(False))
        both = rows.withColumn("_new", F.lit(True)).unionByName(near)
        framed = features.sender_windows(both, cols).filter("_new").drop("_new")
        mine = past.seen.join(senders, cols.sender, "left_semi")
        _write_batch(features.novelty(framed, cols, features.traffic(rows, cols), mine), out, number)

    return _run(stream, each, checkpoint)


# ------------------------------------ T3: state per sender and block of time

VELOCITY = T.StructType(
    [
        T.StructField("sender_account", T.StringType()), T.StructField("transaction_id", T.StringType()),
        T.StructField("tx_count_last_1h", T.LongType()), T.StructField("tx_count_last_24h", T.LongType()),
        T.StructField("total_amount_last_24h", T.DoubleType()), T.StructField("velocity_1h", T.DoubleType()),
    ]
)
HOUR = 3_600_000_000
BLOCK_HOURS = 4  # a divisor of 24; a row goes to 24 / BLOCK_HOURS + 1 blocks, each a call of the processor
_FOUND = Row(*VELOCITY.names)
FRESH, HOUR_AGO, DAY_AGO, WHOLE = 0, 1, 2, 3  # kinds of rows a block receives
_DEALT = "sender_account string, block long, kind int, at timestamp, us long, transaction_id string, n long, amount double"
_HELD = T.StructType(
    [
        T.StructField("kind", T.IntegerType()), T.StructField("us", T.LongType()), T.StructField("transaction_id", T.StringType()),
        T.StructField("n", T.LongType()), T.StructField("amount", T.DoubleType()),
    ]
)


def dealt_to_blocks(rows: DataFrame, hours: int = BLOCK_HOURS) -> DataFrame:
    """Each row to the blocks (some hours of a sender) whose windows it can be in.

    Its own block takes it as a row. So do the block a day later, whose windows end inside the row's block, and for its last
    hour the next block. The blocks between only need the block's sum, which every task adds up before anything
    is shuffled.
    """
    width, day = hours * HOUR, 24 // hours

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(block=frame["us"] // width, n=1)
            yield frame.assign(kind=FRESH)
            last = frame[frame["us"] >= (frame["block"] + 1) * width - HOUR]
            yield last.assign(block=last["block"] + 1, kind=HOUR_AGO)
            yield frame.assign(block=frame["block"] + day, kind=DAY_AGO)
            sums = frame.groupby(["sender_account", "block"], as_index=False).agg(
                at=("at", "max"), us=("us", "max"), n=("n", "sum"), amount=("amount", "sum")
            )
            for ahead in range(1, day):
                yield sums.assign(block=sums["block"] + ahead, kind=WHOLE, transaction_id=None)

    def ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in deal(frames):
            yield frame[["sender_account", "block", "kind", "at", "us", "transaction_id", "n", "amount"]]

    return rows.mapInPandas(ordered, _DEALT)


class BlockVelocity(StatefulProcessor):
    """F2 counts and sums of one sender's rows in one block of time.

    The state holds what the block has received: its rows, rows of the hour and the day before, and the sums of the blocks
    between. A timer at the end of the block clears it, once the watermark is past.
    """

    def __init__(self, hours: int = BLOCK_HOURS):
        self.width = hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Most blocks hold a few rows: plain tuples, and as few calls to the state as can be.
        names = _HELD.names
        came = [tuple(row[c] for c in names) for row in rows]
        fresh = any(r[0] == FRESH for r in came)
        before = [tuple(r) for r in self.held.get()] if fresh else []
        self.held.appendList(came)
        if not before:  # else the block has its timer
            self.handle.registerTimer((int(key[1]) + 1) * self.width // 1000)
        if not fresh:
            return
        every = [(*r, False) for r in before] + [(*r, True) for r in came]
        own = sorted((r for r in every if r[0] == FRESH), key=lambda r: (r[1], r[2] is None, r[2] or ""))
        us = np.array([r[1] for r in own], dtype="int64")
        sums, here = np.concatenate([[0.0], np.cumsum([r[4] for r in own])]), np.arange(len(us))

        def since(which: int, back: int) -> tuple[np.ndarray, np.ndarray]:
            """Number and amount of the rows of a kind at or after ``back`` before each row."""
            of = sorted((r for r in every if r[0] == which), key=lambda r: r[1])
            if not of:
                return np.zeros(len(us), dtype="int64"), np.zeros(len(us))
            times, total = np.array([r[1] for r in of], dtype="int64"), np.concatenate([[0.0], np.cumsum([r[4] for r in of])])
            first = np.searchsorted(times, us - back, "left")
            return len(times) - first, total[-1] - total[first]

        hour_n, hour_sum = since(HOUR_AGO, HOUR)
        day_n, day_sum = since(DAY_AGO, 24 * HOUR)
        inside = np.searchsorted(us, us - HOUR, "left")
        whole_n, whole_sum = sum(r[3] for r in every if r[0] == WHOLE), float(sum(r[4] for r in every if r[0] == WHOLE))
        found = zip(
            (here - inside + hour_n).tolist(), (here + day_n + whole_n).tolist(), (sums[here] + day_sum + whole_sum).tolist(),
            (sums[here] - sums[inside] + hour_sum).tolist(),
        )
        for r, values in zip(own, found):
            if r[5]:
                yield _FOUND(key[0], r[2], *values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def velocity_stream(stream: DataFrame, cols: Columns = COLUMNS, late: str = "1 hour", hours: int = BLOCK_HOURS) -> DataFrame:
    """One row per transaction, as soon as it arrives; equals F2 when rows come in time order.

    A sender's rows are spread over tasks by blocks of ``hours``, so a sender with half of all rows has no task of its own. The
    state of a block goes when the watermark, ``late`` behind the newest row, has passed it; rows that come later still
    are dropped. Needs the RocksDB state store.
    """
    narrow = stream.filter(F.col(cols.sender).isNotNull() & F.col(cols.time).isNotNull()).select(
        F.col(cols.sender).alias("sender_account"),
        F.col(cols.time).cast("timestamp").alias("at"),
        F.col(cols.id).alias("transaction_id"),
        features.micros(cols.time).alias("us"),
        F.coalesce(F.col(cols.amount), F.lit(0.0)).alias("amount"),
    )
    return dealt_to_blocks(narrow, hours).withWatermark("at", late).groupBy("sender_account", "block").transformWithState(
        statefulProcessor=BlockVelocity(hours), outputStructType=VELOCITY, outputMode="append", timeMode="eventTime"
    )


# ---------------------------------------------------- T4: event-time counts

def windowed_counts(
    stream: DataFrame, length: str, step: str | None = None, late: str = "1 hour", cols: Columns = COLUMNS
) -> DataFrame:
    """T4: count and amount per sender and event-time window; rows later than ``late`` are dropped."""
    window = F.window(cols.time, length, step) if step else F.window(cols.time, length)
    timed = stream.withWatermark(cols.time, late) if stream.isStreaming else stream
    return timed.groupBy(window.alias("window"), cols.sender).agg(
        F.count("*").alias("tx_count"), F.sum(cols.amount).alias("total_amount")
    )


def flat_counts(counts: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    return counts.select(
        cols.sender, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "tx_count", "total_amount",
    )


# ------------------------------------------------------------- T5: dedup

def distinct_stream(stream: DataFrame, late: str = "24 hours", cols: Columns = COLUMNS) -> DataFrame:
    """T5: the first arrival of each id; state is kept for ``late`` of event time."""
    return stream.withWatermark(cols.time, late).dropDuplicatesWithinWatermark([cols.id])


# ------------------------------------------------------- running to the end

ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # 500 MB for all state stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else a look-up for each row that is put
}


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams begun from now on keep their state in RocksDB files and not as objects in the executors' memory.

    A window that slides by an hour holds a row per sender and hour until the watermark has passed it; from one large batch
    that is the whole result.
    """
    for name, value in ON_DISK.items():
        spark.conf.set(name, value)


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Drain what is there now into Parquet files and return them as a table."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


PROGRESS = "query string, run string, batch long, ms long, n long, at string"


class ProgressLog(StreamingQueryListener):
    """The progress of every batch of every query of the session, one small file each, under ``path``.

    A query keeps only its newest progress entries; this table has them all and outlives the query.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, {}
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if "addBatch" in p.durationMs:  # else no batch was run
            row = {"query": str(p.id), "run": str(p.runId), "batch": p.batchId, "ms": p.durationMs["triggerExecution"], "n": p.numInputRows, "at": p.timestamp}
            put_if_absent(self.spark, f"{self.path}/{p.runId}-{p.batchId:010d}.json", json.dumps(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event()).set()

    def close(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until all entries of an ended query are written, and listen no more."""
        self.ended.setdefault(str(query.runId), Event()).wait(seconds)
        self.spark.streams.removeListener(self)

    def table(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).json(self.path)


def latency_report(progress: DataFrame) -> DataFrame:
    """Batches, rows, mean, median and 95th percentile of batch time, and rows per second, from a progress table."""
    once = progress.dropDuplicates(["query", "batch"])
    return once.agg(
        F.count("*").alias("n_batches"), F.sum("n").alias("n_rows"), F.avg("ms").alias("mean_ms"),
        F.percentile("ms", F.lit(0.5)).alias("median_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"),
        (F.sum("n") / (F.sum("ms") / 1000)).alias("rows_per_second"),
    )
