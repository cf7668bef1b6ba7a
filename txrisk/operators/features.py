"""Behavioural features of transactions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators.ordered import ordered_scan
from txrisk.operators.skew import HOT_ROWS, attach, heavy_codes, key_code
from txrisk.schema import COLUMNS, DEFAULT_LABEL_RATE, Columns
from txrisk.session import materialise

HOUR_US = 3_600_000_000

TIME_FEATURES = [
    "hour", "day_of_week", "day_of_month", "month", "year", "weekend_flag",
    "is_business_hours", "is_night_time", "is_early_morning", "is_late_night",
    "is_month_end", "is_month_start", "hour_sin", "hour_cos", "day_of_week_sin",
    "day_of_week_cos", "month_sin", "month_cos",
]
SENDER_FEATURES = [
    "tx_count_last_1h", "tx_count_last_24h", "total_amount_last_24h", "avg_amount_last_24h",
    "max_amount_last_24h", "velocity_1h", "velocity_24h",
]
RECEIVER_FEATURES = [
    "receiver_tx_count", "receiver_fraud_count", "receiver_fraud_rate",
    "receiver_total_amount", "receiver_avg_amount", "receiver_risk_score",
]
NOVELTY_FEATURES = [
    "new_location_flag", "new_device_flag", "location_frequency", "device_frequency",
    "sender_location_count", "sender_device_count",
]
PAIR_FEATURES = [
    "sender_receiver_frequency", "sender_receiver_total_amount", "sender_receiver_avg_amount",
]
ENGINEERED = TIME_FEATURES + SENDER_FEATURES + RECEIVER_FEATURES + NOVELTY_FEATURES + PAIR_FEATURES


def micros(time_col: str) -> Column:
    return F.unix_micros(F.col(time_col).cast("timestamp"))


# ------------------------------------------------------------------ traffic

DENSE_DAY = 256  # rows per sender and day above which re-reading a moving frame costs more than a sort
MANY_SENDERS = 10_000  # most senders that are told apart by a list


@dataclass(frozen=True)
class Traffic:
    """What the plans need to know about the spread of a table (small jobs over few columns).

    ``busy`` lists the senders, by hash code, that are dense (many rows in a day) or hot (many
    in all); None stands for "too many to list: treat every sender so".
    """

    busiest_hour: int  # most rows of one sender in one hour, or an upper bound of it
    busy: frozenset[int] | None
    hot_senders: dict[int, int]
    hot_receivers: dict[int, int]
    hot_pairs: dict[int, int]
    hot_rows: int = HOT_ROWS


def traffic(
    df: DataFrame, cols: Columns = COLUMNS, hot_rows: int = HOT_ROWS, dense_day: int = DENSE_DAY
) -> Traffic:
    hour = F.floor(F.unix_seconds(F.col(cols.time).cast("timestamp")) / 3600)
    per_hour = df.filter(F.col(cols.sender).isNotNull()).groupBy(cols.sender, hour.alias("_hour")).count()
    per_day = per_hour.groupBy(cols.sender, F.floor(F.col("_hour") / 24).alias("_day")).agg(
        F.sum("count").alias("day"), F.max("count").alias("hour")
    )
    # Only dense senders come back, the busiest first, and no more than can be listed.
    dense = (
        per_day.groupBy(key_code([cols.sender]).alias("code"))
        .agg(F.max("day").alias("day"), F.max("hour").alias("hour"))
        .filter(F.col("day") > dense_day)
        .orderBy(F.col("hour").desc(), "code")
        .limit(MANY_SENDERS + 1)
        .collect()
    )
    heavy = heavy_codes(
        df.filter(F.col(cols.sender).isNotNull()),
        {"sender": [cols.sender], "receiver": [cols.receiver], "pair": [cols.sender, cols.receiver]},
        hot_rows,
    )
    listed = len(dense) <= MANY_SENDERS
    return Traffic(
        busiest_hour=dense[0]["hour"] if dense else dense_day,
        busy=frozenset(heavy["sender"]) | {r["code"] for r in dense} if listed else None,
        hot_senders=heavy["sender"],
        hot_receivers=heavy["receiver"],
        hot_pairs=heavy["pair"],
        hot_rows=hot_rows,
    )


def by_traffic(df: DataFrame, cols: Columns, spread: Traffic) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary senders, rows of busy senders); a side that is known to be empty is None."""
    if spread.busy is None:
        return None, df
    if not spread.busy:
        return df, None
    is_busy = F.col(cols.sender).isNotNull() & key_code([cols.sender]).isin(list(spread.busy))
    return df.filter(~is_busy), df.filter(is_busy)


# ----------------------------------------------------------------- F1: time

def time_features(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """calendar parts, flags and cyclic encodings of the event time."""
    t = F.col(cols.time).cast("timestamp")
    hour, dow, dom, month = F.hour(t), F.weekday(t), F.dayofmonth(t), F.month(t)

    def flag(condition: Column) -> Column:
        return F.coalesce(condition.cast("int"), F.lit(0))

    def cycle(part: Column, period: int) -> Column:
        return part * F.lit(2 * math.pi / period)

    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": dow,
            "day_of_month": dom,
            "month": month,
            "year": F.year(t),
            "weekend_flag": flag(dow >= 5),
            "is_business_hours": flag(hour.between(9, 17)),
            "is_night_time": flag((hour >= 22) | (hour <= 6)),
            "is_early_morning": flag(hour <= 6),
            "is_late_night": flag(hour >= 22),
            "is_month_end": flag(dom >= 28),
            "is_month_start": flag(dom <= 3),
            "hour_sin": F.sin(cycle(hour, 24)),
            "hour_cos": F.cos(cycle(hour, 24)),
            "day_of_week_sin": F.sin(cycle(dow, 7)),
            "day_of_week_cos": F.cos(cycle(dow, 7)),
            "month_sin": F.sin(cycle(month, 12)),
            "month_cos": F.cos(cycle(month, 12)),
        }
    )


# ------------------------------------------------------ F2: sender windows

def sender_windows(
    df: DataFrame, cols: Columns = COLUMNS, spread: Traffic | None = None, plan: str = "auto"
) -> DataFrame:
    """each sender's activity in the preceding 1 h and 24 h.

    The row itself is outside, a row exactly 1 h / 24 h old is inside, and rows of the
    same instant count when their id is smaller. Rows without sender or time get 0.

    Two equal plans. ``frames`` for ordinary senders: moving range frames, one exchange on the
    sender. A moving frame re-reads its rows for every row, so it is quadratic in the traffic
    of a day; ``blocks`` for busy senders is linear and splits a sender over many tasks
    (:func:`_blocked_windows`). ``auto`` gives each sender its plan.
    """
    us = micros(cols.time)
    names = [*df.columns, "_n1", "_n24", "_sum1", "_sum24", "_max24"]
    if plan == "frames":
        windows = _framed_windows(df, cols)
    else:
        spread = spread or traffic(df, cols)
        plain, busy = by_traffic(df, cols, spread) if plan == "auto" else (None, df)
        sides = [] if plain is None else [_framed_windows(plain, cols).select(*names)]
        if busy is not None:
            sides.append(_blocked_windows(busy, cols, spread).select(*names))
        windows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    keyed = F.col(cols.sender).isNotNull() & us.isNotNull()

    def kept(value: Column, kind: str) -> Column:
        return F.when(keyed, F.coalesce(value, F.lit(0))).otherwise(F.lit(0)).cast(kind)

    total = F.col("_sum24")
    return windows.select(
        *df.columns,
        kept(F.col("_n1"), "long").alias("tx_count_last_1h"),
        kept(F.col("_n24"), "long").alias("tx_count_last_24h"),
        kept(total, "double").alias("total_amount_last_24h"),
        kept(F.try_divide(total, F.col("_n24")), "double").alias("avg_amount_last_24h"),
        kept(F.col("_max24"), "double").alias("max_amount_last_24h"),
        kept(F.col("_sum1"), "double").alias("velocity_1h"),
        kept(total / 24, "double").alias("velocity_24h"),
    )


def by_sender(df: DataFrame, cols: Columns) -> DataFrame:
    """Cluster rows by sender once; F2 and F4 windows then need no exchange of their own.

    Rows without a sender would form one hot group; each gets a group of its own
    (its id hash as second key) and their features are zeroed later.
    """
    if "_lone" in df.columns:
        return df
    lone = F.when(F.col(cols.sender).isNull(), F.xxhash64(cols.id))
    return df.withColumns({"_us": micros(cols.time), "_lone": lone}).repartition(cols.sender, "_lone")


def _framed_windows(df: DataFrame, cols: Columns) -> DataFrame:
    base = by_sender(df, cols)
    group = [cols.sender, "_lone"]
    peers = Window.partitionBy(*group, "_us").orderBy(cols.id).rowsBetween(Window.unboundedPreceding, -1)

    def earlier(hours: int):
        return Window.partitionBy(*group).orderBy("_us").rangeBetween(-hours * HOUR_US, -1)

    a, one = F.col(cols.amount), F.lit(1)

    def both(fn, value: Column, hours: int) -> Column:
        return F.coalesce(fn(value).over(earlier(hours)), F.lit(0)) + F.coalesce(
            fn(value).over(peers), F.lit(0)
        )

    return base.withColumns(
        {
            "_n1": both(F.count, one, 1),
            "_n24": both(F.count, one, 24),
            "_sum1": both(F.sum, a, 1),
            "_sum24": both(F.sum, a, 24),
            "_max24": F.greatest(F.max(a).over(earlier(24)), F.max(a).over(peers)),
        }
    )


def _blocked_windows(df: DataFrame, cols: Columns, spread: Traffic) -> DataFrame:
    """F2 by time blocks, linear in the rows.

    The block width divides an hour, so the far end of every window of block b lies
    in block b-n (n blocks = 1 h or 24 h) at the same offset. A window is then
    * near part: rows of block b before the row        -> running total, ascending
    * full blocks b-n+1 .. b-1                         -> frame over block totals
    * far part: rows of block b-n at or after t - W    -> running total, descending,
      over copies of those rows moved n blocks forward.
    Every row is sent to three blocks (itself, +1 h, +24 h); the two copies are narrow records.
    """
    per_hour = max(1, min(64, 2 ** math.ceil(math.log2(max(1, spread.busiest_hour / 50_000)))))
    width = HOUR_US // per_hour
    crowded = spread.busiest_hour / per_hour > spread.hot_rows
    keyed = F.col(cols.sender).isNotNull() & F.col(cols.time).isNotNull()
    # A row without sender or time is a block of its own.
    blocked = df.select(
        F.col(cols.sender).alias("_s"),
        F.when(keyed, micros(cols.time)).alias("_us"),
        F.col(cols.id).alias("_id"),
        F.col(cols.amount).alias("_a"),
        F.struct(*df.columns).alias("_row"),
    ).withColumn("_b", F.when(F.col("_s").isNotNull() & F.col("_us").isNotNull(), F.expr(f"_us div {width}L"))
                 .otherwise(F.xxhash64("_id")))
    moves = F.when(
        F.col("_s").isNotNull() & F.col("_us").isNotNull(), F.array(F.lit(0), F.lit(1), F.lit(24))
    ).otherwise(F.array(F.lit(0)))
    # The row itself travels with its own record only.
    moved = blocked.select("*", F.explode(moves).alias("_kind")).select(
        "_s",
        (F.col("_us") + F.col("_kind").cast("long") * HOUR_US).alias("_us"),
        "_id",
        "_a",
        (F.col("_b") + F.col("_kind").cast("long") * per_hour).alias("_b"),
        "_kind",
        F.when(F.col("_kind") == 0, F.col("_row")).alias("_row"),
    )

    def only(kind: int, value: Column) -> Column:
        return F.when(F.col("_kind") == kind, value)

    a, one = F.col("_a"), F.lit(1).cast("long")
    near = {"near_n": ("sum", only(0, one)), "near_sum": ("sum", only(0, a)), "near_max": ("max", only(0, a))}
    far = {
        "far1_n": ("sum", only(1, one)), "far1_sum": ("sum", only(1, a)),
        "far24_n": ("sum", only(24, one)), "far24_sum": ("sum", only(24, a)),
        "far24_max": ("max", only(24, a)),
    }
    block = ["_s", "_b"]
    # Ascending, a row follows its own kind by id; descending, moved rows of the same
    # instant come first, because a row exactly W old belongs to the window.
    rising = [F.col("_us"), F.col("_id"), F.col("_kind")]
    falling = [F.col("_us").desc(), F.col("_kind").desc(), F.col("_id")]
    if crowded:
        ran = ordered_scan(ordered_scan(moved, block, rising, near), block, falling, far)
        own = ran.filter("_kind = 0").withColumns(
            {  # the scan is inclusive; a row's own value is taken out again
                "near_n": F.col("near_n") - 1,
                "near_sum": F.col("near_sum") - F.coalesce(a, F.lit(0.0)),
            }
        )
        before = ordered_scan_previous_max(moved.filter("_kind = 0 AND _us IS NOT NULL"), block, rising)
        own = own.drop("near_max").join(before, ["_s", "_b", "_us", "_id"], "left")
    else:
        up = Window.partitionBy(*block).orderBy(*rising).rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(*block).orderBy(*falling).rowsBetween(Window.unboundedPreceding, 0)
        fns = {"sum": F.sum, "max": F.max}
        own = moved.select(
            "*",
            *[fns[k](v).over(up).alias(n) for n, (k, v) in near.items()],
            *[fns[k](v).over(down).alias(n) for n, (k, v) in far.items()],
        ).filter("_kind = 0")

    totals = blocked.filter("_s IS NOT NULL AND _us IS NOT NULL").groupBy(*block).agg(
        F.count("*").alias("bn"), F.sum("_a").alias("bs"), F.max("_a").alias("bm")
    )
    def mid(hours: int):
        return Window.partitionBy("_s").orderBy("_b").rangeBetween(-(hours * per_hour - 1), -1)

    middle = totals.select(
        *block,
        F.sum("bn").over(mid(24)).alias("mid24_n"),
        F.sum("bs").over(mid(24)).alias("mid24_sum"),
        F.max("bm").over(mid(24)).alias("mid24_max"),
        *(
            [F.sum("bn").over(mid(1)).alias("mid1_n"), F.sum("bs").over(mid(1)).alias("mid1_sum")]
            if per_hour > 1
            else [F.lit(None).cast("long").alias("mid1_n"), F.lit(None).cast("double").alias("mid1_sum")]
        ),
    )

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    # Rows of one block join one row of totals; the block width bounds them.
    return own.join(middle, block, "left").select(
        "_row.*",
        (zero("near_n") + zero("mid1_n") + zero("far1_n")).alias("_n1"),
        (zero("near_n") + zero("mid24_n") + zero("far24_n")).alias("_n24"),
        (zero("near_sum") + zero("mid1_sum") + zero("far1_sum")).alias("_sum1"),
        (zero("near_sum") + zero("mid24_sum") + zero("far24_sum")).alias("_sum24"),
        F.greatest("near_max", "mid24_max", "far24_max").alias("_max24"),
    )


def ordered_scan_previous_max(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Maximum over the rows strictly before each row of a hot group.

    A running maximum cannot take the row's own value out again, so the ranks are
    shifted: the value at rank r is attached to the row at rank r + 1.
    """
    ran = ordered_scan(df, by, order, {"_r": ("sum", F.lit(1).cast("long")), "_m": ("max", F.col("_a"))})
    ran = ran.select(*by, "_us", "_id", "_r", "_m")
    after = ran.select(*by, (F.col("_r") + 1).alias("_r"), F.col("_m").alias("near_max"))
    return ran.drop("_m").join(after, [*by, "_r"], "left").drop("_r")


# ------------------------------------------------------- F3: receiver risk

def receiver_stats(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """F3 dimension: one row per receiver; reusable as a table of its own."""
    labelled = cols.label in df.columns
    y = F.col(cols.label).cast("double")
    agg = [
        F.count("*").alias("receiver_tx_count"),
        (F.sum(y) if labelled else F.lit(0.0)).alias("receiver_fraud_count"),
        (F.round(F.avg(y), 6) if labelled else F.lit(DEFAULT_LABEL_RATE)).alias("receiver_fraud_rate"),
        F.round(F.sum(cols.amount), 6).alias("receiver_total_amount"),
        F.round(F.avg(cols.amount), 6).alias("receiver_avg_amount"),
    ]
    stats = df.filter(F.col(cols.receiver).isNotNull()).groupBy(cols.receiver).agg(*agg)
    # A scalar subquery over the same aggregate; the plan has no join for it.
    most = stats.agg(F.max("receiver_tx_count")).scalar()
    return stats.withColumn(
        "receiver_risk_score",
        F.col("receiver_fraud_rate") * 0.6 + F.col("receiver_tx_count") / most * 0.4,
    )


def receiver_risk(
    df: DataFrame,
    cols: Columns = COLUMNS,
    spread: Traffic | None = None,
    mode: str = "batch",
    stats: DataFrame | None = None,
    source: DataFrame | None = None,
    own: DataFrame | None = None,
) -> DataFrame:
    """receiver totals, label rate and risk score on every row.

    ``mode="batch"`` counts the row's own label, ``"point_in_time"`` only rows before it
    in (time, id) order. ``stats`` scores with a stored dimension instead of the batch's own, and ``own``
    (:func:`contributions` of the rows it was made of) takes a row's own part off it, so that no row's statistics know
    its label.
    ``source`` is the same table before other features were added: the statistics then
    scan only their few columns.
    """
    source = df if source is None else source
    if mode == "point_in_time":
        return _receiver_point_in_time(df, cols, spread)
    labelled = cols.label in df.columns
    rate = (
        source.agg(F.avg(F.col(cols.label).cast("double"))).scalar()
        if labelled
        else F.lit(DEFAULT_LABEL_RATE)
    )
    joined = attach(
        df,
        stats if stats is not None else receiver_stats(source, cols),
        [cols.receiver],
        spread.hot_receivers if spread else None,
        spread.hot_rows if spread else HOT_ROWS,
    )
    if own is not None:
        joined = _without_own(joined, stats, own, cols)
    fill = {
        c: F.coalesce(F.col(c), rate if ("rate" in c or "score" in c) else F.lit(0))
        for c in RECEIVER_FEATURES
    }
    return joined.select(*df.columns, *[v.alias(c) for c, v in fill.items()])


def contributions(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """What each id adds to its receiver's statistics: (id, receiver, rows, labels, amounts)."""
    y = F.coalesce(F.col(cols.label).cast("double"), F.lit(0.0)) if cols.label in df.columns else F.lit(0.0)
    known = df.filter(F.col(cols.id).isNotNull() & F.col(cols.receiver).isNotNull())
    return known.groupBy(cols.id, cols.receiver).agg(
        F.count("*").alias("own_count"), F.sum(y).alias("own_fraud"), F.sum(cols.amount).alias("own_amount")
    )


def _without_own(joined: DataFrame, stats: DataFrame, own: DataFrame, cols: Columns) -> DataFrame:
    """Receiver statistics less the row's own contribution, where the row was one of those they were made of.

    Only contributions of ids at hand are moved: the semi-join leaves at most one row per scored row. A receiver that has
    no other row has no statistics.
    """
    keys = [cols.id, cols.receiver]
    mine = own.join(joined.select(*keys), keys, "left_semi")
    both = joined.join(mine, keys, "left")
    n = F.col("receiver_tx_count") - F.col("own_count")
    fraud = F.col("receiver_fraud_count") - F.col("own_fraud")
    total = F.round(F.col("receiver_total_amount") - F.coalesce("own_amount", F.lit(0.0)), 6)
    rate = F.round(F.try_divide(fraud, n), 6)
    most = stats.agg(F.max("receiver_tx_count")).scalar()
    less = {
        "receiver_tx_count": n, "receiver_fraud_count": fraud, "receiver_fraud_rate": rate, "receiver_total_amount": total,
        "receiver_avg_amount": F.round(F.try_divide(total, n), 6), "receiver_risk_score": rate * 0.6 + n / most * 0.4,
    }
    known = F.col("own_count").isNull()
    return both.withColumns(
        {c: F.when(known, F.col(c)).when(n > 0, v) for c, v in less.items()}
    ).drop("own_count", "own_fraud", "own_amount")


def _receiver_point_in_time(df: DataFrame, cols: Columns, spread: Traffic | None) -> DataFrame:
    known = df.filter(F.col(cols.receiver).isNotNull())
    y = F.coalesce(F.col(cols.label).cast("double"), F.lit(0.0))
    a = F.coalesce(F.col(cols.amount), F.lit(0.0))
    order = [F.col(cols.time), F.col(cols.id)]
    one = F.lit(1).cast("long")
    if spread and spread.hot_receivers:
        ran = ordered_scan(
            known, [cols.receiver], order, {"_n": ("sum", one), "_f": ("sum", y), "_t": ("sum", a)}
        ).withColumns({"_n": F.col("_n") - 1, "_f": F.col("_f") - y, "_t": F.col("_t") - a})
    else:
        w = Window.partitionBy(cols.receiver).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        ran = known.withColumns(
            {"_n": F.count("*").over(w), "_f": F.sum(y).over(w), "_t": F.sum(a).over(w)}
        )
    most = df.filter(F.col(cols.receiver).isNotNull()).groupBy(cols.receiver).count().agg(F.max("count")).scalar()
    n, f, t = F.col("_n"), F.coalesce("_f", F.lit(0.0)), F.coalesce("_t", F.lit(0.0))
    rate = F.coalesce(F.round(F.try_divide(f, n), 6), F.lit(DEFAULT_LABEL_RATE))
    whole = ran.unionByName(df.filter(F.col(cols.receiver).isNull()), allowMissingColumns=True)
    return whole.select(
        *df.columns,
        F.coalesce(n, F.lit(0)).alias("receiver_tx_count"),
        f.alias("receiver_fraud_count"),
        rate.alias("receiver_fraud_rate"),
        F.round(t, 6).alias("receiver_total_amount"),
        F.coalesce(F.round(F.try_divide(t, n), 6), F.lit(0.0)).alias("receiver_avg_amount"),
        (rate * 0.6 + F.coalesce(n, F.lit(0)) / most * 0.4).alias("receiver_risk_score"),
    )


# ------------------------------------------------------------- F4: novelty

def normalised(name: str) -> Column:
    """Trimmed lower case; a missing value is a value of its own."""
    return F.coalesce(F.lower(F.trim(F.col(name).cast("string"))), F.lit("nan"))


def seen_values(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """What each sender has used so far: (sender, kind, value, n). The state table of F4."""
    kinds = F.array(
        F.struct(F.lit("location").alias("kind"), normalised(cols.location).alias("value")),
        F.struct(F.lit("device").alias("kind"), normalised(cols.device).alias("value")),
    )
    return (
        df.filter(F.col(cols.sender).isNotNull())
        .select(cols.sender, F.inline(kinds))
        .groupBy(cols.sender, "kind", "value")
        .agg(F.count("*").alias("n"))
    )


def novelty(
    df: DataFrame, cols: Columns = COLUMNS, spread: Traffic | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """first-seen flags, running frequencies and running distinct counts per sender.

    The rows of hot senders go through range-partitioned scans, the rest through
    windows that share one exchange on the sender. ``seen`` (:func:`seen_values` of all
    earlier rows) continues the counts of a stream without its history.
    """
    named = df.withColumns({"_loc": normalised(cols.location), "_dev": normalised(cols.device)})
    hot = spread.hot_senders if spread else {}
    named = _with_state(named, cols, seen, hot)
    if hot:
        is_hot = F.coalesce(key_code([cols.sender]).isin(list(hot)), F.lit(False)) & F.col(cols.sender).isNotNull()
        done = _novelty_windows(named.filter(~is_hot), cols).unionByName(
            _novelty_scans(named.filter(is_hot), cols), allowMissingColumns=True
        )
    else:
        done = _novelty_windows(named, cols)
    known = F.col(cols.sender).isNotNull()
    return done.select(
        *df.columns, *[F.when(known, F.col(c)).otherwise(F.lit(0)).alias(c) for c in NOVELTY_FEATURES]
    )


STATE = ["_loc0", "_dev0", "_locs0", "_devs0"]


def _with_state(named: DataFrame, cols: Columns, seen: DataFrame | None, hot: dict[int, int]) -> DataFrame:
    """Earlier counts of the row's location and device, and earlier distinct counts of its sender."""
    if seen is None:
        return named.withColumns({c: F.lit(0).cast("long") for c in STATE})
    out = named
    for kind, value, count, distinct in (("location", "_loc", "_loc0", "_locs0"), ("device", "_dev", "_dev0", "_devs0")):
        part = seen.filter(F.col("kind") == kind)
        per_value = part.groupBy(cols.sender, F.col("value").alias(value)).agg(F.sum("n").alias(count))
        per_sender = per_value.groupBy(cols.sender).agg(F.count("*").alias(distinct))
        out = attach(out, per_value, [cols.sender, value])
        out = attach(out, per_sender, [cols.sender], hot)
    return out.fillna(0, STATE)


def _novelty_order(cols: Columns) -> list[Column]:
    return [F.col(cols.time).asc_nulls_last(), F.col(cols.id)]


def _first(name: str) -> Column:
    return (F.col(name) == 1).cast("long")


def _novelty_windows(named: DataFrame, cols: Columns) -> DataFrame:
    order, group = _novelty_order(cols), [cols.sender, "_lone"]
    per_sender = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def nth(kind: str) -> Column:
        return F.row_number().over(Window.partitionBy(*group, kind).orderBy(*order)).cast("long")

    counted = by_sender(named, cols).withColumns(
        {"location_frequency": nth("_loc") + F.col("_loc0"), "device_frequency": nth("_dev") + F.col("_dev0")}
    )
    return counted.withColumns(
        {
            "new_location_flag": _first("location_frequency"),
            "new_device_flag": _first("device_frequency"),
            "sender_location_count": F.sum(_first("location_frequency")).over(per_sender) + F.col("_locs0"),
            "sender_device_count": F.sum(_first("device_frequency")).over(per_sender) + F.col("_devs0"),
        }
    )


def _novelty_scans(hot: DataFrame, cols: Columns) -> DataFrame:
    """F4 of hot senders: their rows are cut once into time-ordered slabs of a task's size.

    Counts run within a slab. What a slab must add to them comes from one row per (slab, sender,
    value): the value's earlier count, and how many values of the sender first appeared in
    earlier slabs. Nothing but these small tables crosses slabs.
    """
    order = _novelty_order(cols)
    slabs = materialise(
        hot.repartitionByRange(F.col(cols.sender), *order).withColumn("_slab", F.spark_partition_id()), "slabs"
    )
    upto = (Window.unboundedPreceding, 0)
    before = (Window.unboundedPreceding, -1)
    out = slabs
    for kind, base, distinct0, name in (
        ("_loc", "_loc0", "_locs0", "location"), ("_dev", "_dev0", "_devs0", "device"),
    ):
        per_value = slabs.groupBy("_slab", cols.sender, kind).agg(
            F.count("*").alias("_n"), F.max(base).alias("_base")
        )
        earlier = Window.partitionBy(cols.sender, kind).orderBy("_slab").rowsBetween(*before)
        counts = per_value.select("_slab", cols.sender, kind, F.sum("_n").over(earlier).alias("_before"))
        # A value is new in the first slab that holds it, if the state did not know it.
        new = per_value.groupBy(cols.sender, kind).agg(F.min("_slab").alias("_slab"), F.max("_base").alias("_base"))
        new = new.filter("_base = 0").groupBy("_slab", cols.sender).agg(F.count("*").alias("_new"))
        # One row per slab and hot sender: slabs plus senders at most, small enough to broadcast.
        parts = per_value.select("_slab", cols.sender).distinct().join(new, ["_slab", cols.sender], "left")
        past = Window.partitionBy(cols.sender).orderBy("_slab").rowsBetween(*before)
        parts = parts.select("_slab", cols.sender, F.sum("_new").over(past).alias("_known"))
        nth = F.row_number().over(Window.partitionBy("_slab", cols.sender, kind).orderBy(*order))
        frequency = nth + F.coalesce("_before", F.lit(0)) + F.col(base)
        out = out.join(counts, ["_slab", cols.sender, kind], "left").withColumn(f"{name}_frequency", frequency)
        flag = _first(f"{name}_frequency")
        running = F.sum(flag).over(Window.partitionBy("_slab", cols.sender).orderBy(*order).rowsBetween(*upto))
        out = out.join(F.broadcast(parts), ["_slab", cols.sender], "left").withColumns(
            {
                f"new_{name}_flag": flag,
                f"sender_{name}_count": running + F.coalesce("_known", F.lit(0)) + F.col(distinct0),
            }
        ).drop("_before", "_known")
    return out


# ------------------------------------------------------------ F5: pairs

def pair_stats(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    return (
        df.filter(F.col(cols.sender).isNotNull() & F.col(cols.receiver).isNotNull())
        .groupBy(cols.sender, cols.receiver)
        .agg(
            F.count("*").alias("sender_receiver_frequency"),
            F.round(F.sum(cols.amount), 6).alias("sender_receiver_total_amount"),
            F.round(F.avg(cols.amount), 6).alias("sender_receiver_avg_amount"),
        )
    )


def pair_features(
    df: DataFrame,
    cols: Columns = COLUMNS,
    spread: Traffic | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """how often and how much this sender paid this receiver.

    A pair may be hot, so the totals are pre-aggregated and joined back salted,
    not computed in a window that would hold the pair in one task.
    """
    joined = attach(
        df,
        pair_stats(df if source is None else source, cols),
        [cols.sender, cols.receiver],
        spread.hot_pairs if spread else None,
        spread.hot_rows if spread else HOT_ROWS,
    )
    return joined.select(*df.columns, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in PAIR_FEATURES])


def _pair_windows(df: DataFrame, cols: Columns) -> DataFrame:
    """F5 within the sender's own partition, for tables without hot senders."""
    pair = Window.partitionBy(cols.sender, "_lone", cols.receiver)
    known = F.col(cols.sender).isNotNull() & F.col(cols.receiver).isNotNull()
    values = {
        "sender_receiver_frequency": F.count("*").over(pair),
        "sender_receiver_total_amount": F.round(F.sum(cols.amount).over(pair), 6),
        "sender_receiver_avg_amount": F.round(F.avg(cols.amount).over(pair), 6),
    }
    return by_sender(df, cols).withColumns(
        {c: F.when(known, F.coalesce(v, F.lit(0))).otherwise(F.lit(0)) for c, v in values.items()}
    )


# ----------------------------------------------------- F6-F9: whole tables

def numeric_or_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """coerce to double; NULL, NaN and unreadable text become 0."""
    value = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns}
    return df.withColumns(
        {c: F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0)) for c, v in value.items()}
    )


def engineer(
    df: DataFrame,
    cols: Columns = COLUMNS,
    history: DataFrame | None = None,
    receiver_mode: str = "batch",
    spread: Traffic | None = None,
    stats: DataFrame | None = None,
    own: DataFrame | None = None,
) -> DataFrame:
    """all features of ``df``. ``history`` holds earlier rows that windows may see; ``stats`` and ``own`` as in F3."""
    rows = df
    if history is not None:
        rows = df.withColumn("_new", F.lit(True)).unionByName(
            history.withColumn("_new", F.lit(False)), allowMissingColumns=True
        )
    spread = spread or traffic(rows, cols)
    plain, busy = by_traffic(rows, cols, spread)
    per_sender = [*rows.columns, *SENDER_FEATURES, *NOVELTY_FEATURES, *PAIR_FEATURES]
    parts = []
    if plain is not None:  # no hot sender, hence no hot pair: F2, F4 and F5 share one exchange
        shared = sender_windows(novelty(by_sender(plain, cols), cols), cols, plan="frames")
        parts.append(_pair_windows(shared, cols).select(*per_sender))
    if busy is not None:
        spread_out = sender_windows(novelty(busy, cols, spread), cols, spread, plan="blocks")
        parts.append(pair_features(spread_out, cols, spread, source=busy).select(*per_sender))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = receiver_risk(out, cols, spread, receiver_mode, stats, source=rows, own=own)
    out = out.select(*rows.columns, *SENDER_FEATURES, *RECEIVER_FEATURES, *NOVELTY_FEATURES, *PAIR_FEATURES)
    if history is not None:
        out = out.filter("_new").drop("_new")
    return numeric_or_zero(time_features(out, cols), ENGINEERED)


def pair_totals(df: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """What each pair has done so far: (sender, receiver, n, total). The state table of F5."""
    known = df.filter(F.col(cols.sender).isNotNull() & F.col(cols.receiver).isNotNull())
    return known.groupBy(cols.sender, cols.receiver).agg(F.count("*").alias("n"), F.sum(cols.amount).alias("total"))


def _pairs_on(df: DataFrame, cols: Columns, spread: Traffic, pairs: DataFrame, upto_row: bool) -> DataFrame:
    """F5 of ``df`` on top of earlier totals: with all rows of ``df``, or with those up to the row itself."""
    keys, amount = [cols.sender, cols.receiver], F.coalesce(F.col(cols.amount), F.lit(0.0))
    if not upto_row:
        mine = pair_totals(df, cols).select(*keys, F.col("n").alias("_pn"), F.col("total").alias("_pt"))
        here = attach(df, mine, keys, spread.hot_pairs, spread.hot_rows)
    elif spread.hot_pairs:
        known = df.filter(F.col(cols.sender).isNotNull() & F.col(cols.receiver).isNotNull())
        ran = ordered_scan(known, keys, _novelty_order(cols), {"_pn": ("sum", F.lit(1).cast("long")), "_pt": ("sum", amount)})
        rest = df.filter(F.col(cols.sender).isNull() | F.col(cols.receiver).isNull())
        here = ran.unionByName(rest, allowMissingColumns=True)
    else:
        w = Window.partitionBy(*keys).orderBy(*_novelty_order(cols)).rowsBetween(Window.unboundedPreceding, 0)
        here = df.withColumns({"_pn": F.count("*").over(w), "_pt": F.sum(amount).over(w)})
    past = pairs.groupBy(*keys).agg(F.sum("n").alias("_n0"), F.sum("total").alias("_t0"))  # a pair may have a row per batch
    both = attach(here, past, keys, spread.hot_pairs, spread.hot_rows)
    known = F.col(cols.sender).isNotNull() & F.col(cols.receiver).isNotNull()
    n = F.coalesce("_pn", F.lit(0)) + F.coalesce("_n0", F.lit(0))
    total = F.coalesce("_pt", F.lit(0.0)) + F.coalesce("_t0", F.lit(0.0))
    values = {
        "sender_receiver_frequency": n, "sender_receiver_total_amount": F.round(total, 6),
        "sender_receiver_avg_amount": F.round(F.try_divide(total, n), 6),
    }
    return both.select(*df.columns, *[F.when(known, F.coalesce(v, F.lit(0))).otherwise(F.lit(0)).alias(c) for c, v in values.items()])


def engineer_on(
    df: DataFrame, recent: DataFrame, seen: DataFrame, pairs: DataFrame, stats: DataFrame, cols: Columns = COLUMNS,
    own: DataFrame | None = None, upto_row: bool = False,
) -> DataFrame:
    """F7 of ``df`` on top of earlier rows that are known by their sums only.

    ``recent`` holds the earlier rows of the last 24 h (F2), ``seen`` and ``pairs`` what :func:`seen_values` and
    :func:`pair_totals` give for all earlier rows (F4, F5), ``stats`` the receivers (F3). Nothing else of the past is
    read. With ``upto_row`` pairs count rows up to the row itself, so that features do not depend on what else is in ``df``.
    """
    senders = df.filter(F.col(cols.sender).isNotNull()).select(cols.sender).distinct()
    near = recent.join(senders, cols.sender, "left_semi").withColumn("_new", F.lit(False))
    both = df.withColumn("_new", F.lit(True)).unionByName(near, allowMissingColumns=True)
    spread = traffic(both, cols)
    framed = sender_windows(both, cols, spread).filter("_new").drop("_new")
    out = novelty(framed, cols, spread, seen.join(senders, cols.sender, "left_semi"))
    out = _pairs_on(out, cols, spread, pairs.join(senders, cols.sender, "left_semi"), upto_row)
    out = receiver_risk(out, cols, spread, "batch", stats, source=df, own=own)
    out = out.select(*df.columns, *SENDER_FEATURES, *RECEIVER_FEATURES, *NOVELTY_FEATURES, *PAIR_FEATURES)
    return numeric_or_zero(time_features(out, cols), ENGINEERED)


def feature_columns(df: DataFrame, cols: Columns = COLUMNS, skip: Sequence[str] = ()) -> list[str]:
    """F8: numeric columns that are neither keys, label, time nor text."""
    keys = {cols.id, cols.time, cols.sender, cols.receiver, cols.label, *skip}
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys
    ]
