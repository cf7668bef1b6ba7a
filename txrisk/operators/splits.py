"""Splits, balancing and resampling.

A split is a filter on an exact rank boundary (see ``rank_boundaries``): the table
itself is neither sorted nor shuffled, whatever its size or its label rate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.operators.features import micros
from txrisk.operators.ordered import Boundary, hash_key, ordered_scan, rank_boundaries
from txrisk.schema import COLUMNS, EXTENDED_TRANSACTION, SEED, Columns


def label_counts(df: DataFrame, label: str) -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}


def balanced_undersample(
    df: DataFrame, cols: Columns = COLUMNS, seed: int = SEED, minimum: int = 1000
) -> DataFrame:
    """All positives and as many negatives, drawn by smallest seeded hash."""
    n = label_counts(df, cols.label)
    pos, neg = n.get(1, 0), n.get(0, 0)
    if pos < minimum:
        raise ValueError(f"{pos} positives, at least {minimum} are needed")
    if neg < pos:
        raise ValueError(f"{neg} negatives cannot match {pos} positives")
    key, y = hash_key(cols.id, seed), F.col(cols.label)
    cut = rank_boundaries(df.filter(y == 0), key, cols.id, [(None, pos)])[(None, pos)]
    return df.filter((y == 1) | ((y == 0) & cut.covers(key, cols.id)))


def time_split(df: DataFrame, test_share: float, cols: Columns = COLUMNS) -> DataFrame:
    """``split`` = train for the first ⌊n·(1-t)⌋ rows in (time, id) order, test for the rest.

    Rows without a time are last, as test rows.
    """
    if not 0 < test_share < 1:
        raise ValueError("test_share must lie between 0 and 1")
    first = int(df.count() * (1 - test_share))
    cut = rank_boundaries(df, micros(cols.time), cols.id, [(None, first)])[(None, first)]
    return _labelled(df, cut.covers(micros(cols.time), cols.id))


def _labelled(df: DataFrame, in_train: Column) -> DataFrame:
    return df.withColumn("split", F.when(in_train, "train").otherwise("test"))


def sides(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


def split_report(split: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """D3: size, label rate and period of each side."""
    return split.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.avg(F.col(cols.label).cast("double")).alias("label_rate"),
        F.min(cols.time).alias("first_time"),
        F.max(cols.time).alias("last_time"),
    )


def stratified_split(
    df: DataFrame, test_share: float, cols: Columns = COLUMNS, seed: int = SEED
) -> DataFrame:
    """Per label the first ⌊n·(1-t)+½⌋ rows by seeded hash are train, exactly."""
    if not 0 < test_share < 1:
        raise ValueError("test_share must lie between 0 and 1")
    targets = [(y, math.floor(n * (1 - test_share) + 0.5)) for y, n in label_counts(df, cols.label).items()]
    key = hash_key(cols.id, seed)
    cuts = rank_boundaries(df, key, cols.id, targets, stratum=cols.label)
    in_train = F.lit(False)
    for (y, _), cut in cuts.items():
        in_train = in_train | ((F.col(cols.label) == y) & cut.covers(key, cols.id))
    return _labelled(df, in_train)


def drift_report(split: DataFrame, cols: Columns = COLUMNS, limit: float = 0.01) -> DataFrame:
    """Label rate per side, flagged when it is more than 1 % off the whole table's."""
    y = F.col(cols.label).cast("double")
    rate = split.agg(F.avg(y)).scalar()
    return split.groupBy("split").agg(F.count("*").alias("n_rows"), F.avg(y).alias("label_rate")).select(
        "*", (F.abs(F.col("label_rate") - rate) > limit).cast("int").alias("has_drift")
    )


def assign_folds(df: DataFrame, folds: int, cols: Columns = COLUMNS, seed: int = SEED) -> DataFrame:
    """``fold`` 0..k-1, each holding an equal share of every label (sizes differ by at most one)."""
    targets, order = [], []
    for y, n in label_counts(df, cols.label).items():
        for j in range(1, folds):
            targets.append((y, n * j // folds))
            order.append((y, j, n * j // folds))
    key = hash_key(cols.id, seed)
    cuts = rank_boundaries(df, key, cols.id, targets, stratum=cols.label)
    fold: Column = F.lit(folds - 1)
    for y, j, rank in sorted(order, key=lambda t: (str(t[0]), -t[1])):
        fold = F.when((F.col(cols.label) == y) & cuts[(y, rank)].covers(key, cols.id), j - 1).otherwise(fold)
    return df.withColumn("fold", fold)


def with_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """One-based rank within ``by``, by a ranged scan."""
    return ordered_scan(df, by, order, {name: ("sum", F.lit(1).cast("long"))})


def resample(
    df: DataFrame, sizes: dict[int, int], cols: Columns = COLUMNS, seed: int = SEED
) -> DataFrame:
    """Draw with replacement to exact class sizes.

    Draw j of a class takes the row whose rank is a seeded hash of j, so the draws
    are a range of numbers joined to ranked rows: no class passes through one task.
    """
    n = label_counts(df, cols.label)
    ranked = with_rank(df, [cols.label], [F.col(cols.id)], "_rank")
    draws = None
    for y, m in sizes.items():
        pick = F.pmod(hash_key("id", f"{seed}:{y}"), F.lit(n[y])) + 1
        part = df.sparkSession.range(m).select(
            F.lit(y).alias("_y"), F.col("id").alias("draw"), pick.alias("_pick")
        )
        draws = part if draws is None else draws.unionAll(part)
    on = (F.col("_y") == F.col(cols.label)) & (F.col("_pick") == F.col("_rank"))
    return draws.join(ranked, on).drop("_y", "_pick", "_rank")


def assign_metadata(
    df: DataFrame, order: Sequence[Column], label: str = COLUMNS.label, minutes: int = 2
) -> DataFrame:
    """Sequence ids TXN00000000…, times two minutes apart, and a type from the label."""
    ranked = with_rank(df, [], order, "_rank")
    i = F.col("_rank") - 1
    start = 1_704_067_200  # fixed value: 2024-01-01T00:00:00Z
    return ranked.withColumns(
        {
            "sequence_id": F.concat(F.lit("TXN"), F.lpad(i.cast("string"), 8, "0")),
            "sequence_time": F.timestamp_seconds(F.lit(start) + i * (60 * minutes)),
            "fraud_type": F.when(F.col(label) == 1, "synthetic_fraud").otherwise("none"),
        }
    ).drop("_rank")


def canonical_order(df: DataFrame) -> DataFrame:
    """The columns of an extended transaction, in order; absent ones are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in EXTENDED_TRANSACTION.fields
        ]
    )


__all__ = [
    "Boundary", "assign_folds", "assign_metadata", "balanced_undersample", "canonical_order",
    "drift_report", "resample", "sides", "split_report", "stratified_split", "time_split", "with_rank",
]
