"""Heavy keys: find them in one scan, and join to per-key statistics without a hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000  # rows of one key that a single task may hold
TOP_KEYS = 1_000
TRACKED = 10_000
MERGERS = 256


def key_code(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_codes(df: DataFrame, keysets: dict[str, Sequence[str]], hot_rows: int = HOT_ROWS):
    """Hash codes of keys that hold more than ``hot_rows`` rows, per key set.

    A frequent-items sketch per task, merged in two steps (many tasks first, then one row), so no
    keys are shuffled and no task merges more than a few hundred sketches. Where the ``TOP_KEYS`` items of the sketch
    are all heavy there may be more, and keys are counted exactly. No key is left out; there are at most
    rows / ``hot_rows`` of them. The numbers only steer salting and splitting and never change a result.
    """
    def sketched(function: str, value: Column, name: str) -> Column:
        return F.call_function(function, value, F.lit(TRACKED)).alias(name)

    partly = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_part")).agg(
        *[sketched("approx_top_k_accumulate", key_code(keys), name) for name, keys in keysets.items()]
    )
    # Grouped, though into one group: a partial merge without a key fails on an empty partition.
    merged = partly.groupBy(F.pmod("_part", F.lit(1)).alias("_all")).agg(
        *[sketched("approx_top_k_combine", F.col(name), name) for name in keysets]
    )
    row = merged.select(
        *[F.call_function("approx_top_k_estimate", F.col(n), F.lit(TOP_KEYS)).alias(n) for n in keysets]
    ).first()
    if row is None:  # no rows at all
        return {name: {} for name in keysets}
    found = {}
    for name, keys in keysets.items():
        heavy = {item["item"]: item["count"] for item in (row[name] or []) if item["count"] > hot_rows}
        if len(heavy) >= TOP_KEYS:
            counted = df.groupBy(key_code(keys).alias("code")).count().filter(F.col("count") > hot_rows)
            heavy = {r["code"]: r["count"] for r in counted.toLocalIterator()}
        found[name] = heavy
    return found


def attach(
    facts: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    hot: dict[int, int] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join of ``facts`` to one-row-per-key ``stats``.

    Rows of the keys in ``hot`` are spread over salts (from a hash of the row, so
    a retried task places them alike) and only those keys' stats rows are copied
    per salt. All other keys join plainly, and Spark picks broadcast or sort-merge
    from the size of ``stats``. A null key never matches; as a hot code it is
    salted too and so does not pile up in one task.
    """
    if not hot:
        return facts.join(stats, list(keys), "left")
    salts = min(1024, 1 + max(hot.values()) // hot_rows)
    is_hot = key_code(keys).isin(list(hot))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.lit(salts)).cast("int")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = facts.withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)))
    right = stats.withColumn("_salt", F.explode(copies))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
