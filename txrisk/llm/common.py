"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.session import materialise, ship

T = TypeVar("T")
SALTS = 64  # cells over which the rows of one key are spread

__all__ = ["SALTS", "batches_of", "fresh", "materialise", "salt_of", "spread_join", "table", "with_group_facts", "worker_slot"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


_SLOT: dict[Hashable, Any] = {}


def worker_slot(key: Hashable, make: Callable[[], T]) -> T:
    """What is costly to make, kept in a worker process until an operator asks for something else.

    Workers live through many stages; with one slot the memory of one operator is free for the next, and what others
    have freed goes back to the system.
    """
    if key not in _SLOT:
        _SLOT.clear()
        give_back()
        _SLOT[key] = make()
    return _SLOT[key]


def give_back() -> None:
    """Return freed memory of this process to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send at most ``rows`` rows at once to Python; for rows that may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def salt_of(*columns: Column, salts: int = SALTS) -> Column:
    """A cell number from the row's own values, so a retried task deals alike."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def with_group_facts(
    rows: DataFrame, keys: Sequence[str], salt: Column, partial: dict[str, Column], merged: dict[str, Column],
    keep: Column | None = None,
) -> DataFrame:
    """Left-join facts about each key to all of its rows, without one task per key.

    ``partial`` aggregates the rows of a (key, salt) cell, ``merged`` aggregates those to facts of the key.
    A key of any size has at most ``SALTS`` cells, so the second step is small for every key, and the join
    back runs on (key, salt). ``keep`` filters keys by their facts before the join; rows of other keys get
    nulls. Null keys match nothing.
    """
    cell = fresh(rows, "_cell")
    salted = rows.withColumn(cell, salt).repartition(*keys, cell)  # one exchange for the cells and for the join back
    cells = salted.groupBy(*keys, cell).agg(*[c.alias(n) for n, c in partial.items()])
    whole = Window.partitionBy(*keys)  # the cells of a key
    facts = cells.select(*keys, cell, *[c.over(whole).alias(n) for n, c in merged.items()])
    if keep is not None:
        facts = facts.filter(keep)
    return salted.join(facts, [*keys, cell], "left").drop(cell)


def spread_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], salt: Column, how: str = "inner") -> DataFrame:
    """Join rows to a table of one row per key, without one task per key.

    The keys at hand take their facts once per (key, salt) cell, at most ``SALTS`` for a key of any size, and rows join on
    the cell. With ``how="left"`` other rows get nulls; null keys match nothing and are spread too.
    """
    cell = fresh(rows, "_cell")
    salted = rows.withColumn(cell, salt).repartition(*keys, cell)
    placed = salted.select(*keys, cell).distinct().join(facts, list(keys))
    return salted.join(placed, [*keys, cell], how).drop(cell)
