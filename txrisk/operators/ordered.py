"""Running totals and exact rank boundaries over tables of any size and any skew."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.session import materialise

_MERGE = {"sum": F.sum, "max": F.max}


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    running: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add inclusive running ``sum``/``max`` columns per ``by`` group in ``order``.

    The table is range-partitioned on (by, order) into slabs, so a group of any
    size, even one that is the whole table, spans as many slabs as it needs.
    The slab number is fixed by writing the slabs once. Each slab runs its own
    totals; a slab's first group may continue from earlier slabs, and the value it
    carries in is the only thing that crosses slabs: at most one row per slab, a
    bound that makes the broadcast safe.

    ``order`` must be total within a group.
    """
    groups = [F.col(c) for c in by]
    valued = df.select("*", *[value.alias(f"_in_{name}") for name, (_, value) in running.items()])
    slabs = materialise(
        valued.repartitionByRange(*groups, *order).withColumn("_slab", F.spark_partition_id()),
        "slabs",
    )
    inside = Window.partitionBy("_slab", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    totals = slabs.groupBy("_slab", *by).agg(
        *[_MERGE[kind](f"_in_{name}").alias(f"_tot_{name}") for name, (kind, _) in running.items()]
    )
    carried = totals.select(
        F.col("_slab").alias("_slab_in"),
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.row_number().over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("_nth"),
        *[
            _MERGE[kind](f"_tot_{name}").over(before).alias(f"_carry_{name}")
            for name, (kind, _) in running.items()
        ],
    ).filter("_nth > 1").drop("_nth")
    local = slabs.select(
        "*",
        *[
            _MERGE[kind](f"_in_{name}").over(inside).alias(f"_run_{name}")
            for name, (kind, _) in running.items()
        ],
    )
    match = F.col("_slab") == F.col("_slab_in")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = local.join(F.broadcast(carried), match, "left")

    def combined(name: str, kind: str) -> Column:
        run, carry = F.col(f"_run_{name}"), F.col(f"_carry_{name}")
        if kind == "max":
            return F.greatest(run, carry)  # greatest skips NULL
        return F.coalesce(run + carry, run, carry)

    return joined.select(
        *[F.col(c) for c in df.columns],
        *[combined(name, kind).alias(name) for name, (kind, _) in running.items()],
    )


@dataclass(frozen=True)
class Boundary:
    """The last row, in (key, id) order, of the first ``rank`` rows."""

    key: int | None
    id: object | None

    def covers(self, key: Column, id_col: str) -> Column:
        if self.key is None:
            return F.lit(False)
        return (key < self.key) | ((key == self.key) & (F.col(id_col) <= F.lit(self.id)))


def rank_boundaries(
    df: DataFrame,
    key: Column,
    id_col: str,
    targets: Sequence[tuple[object, int]],
    stratum: str | None = None,
    bound: int = 200_000,
    buckets: int = 1024,
) -> dict[tuple[object, int], Boundary]:
    """Exact row at each (stratum, rank) of the (key, id) order, without a sort of the table.

    ``key`` is a bigint, NULL keys are out of the order. Each pass counts rows per
    bucket of the interval that still holds the rank and keeps one bucket, so a pass
    is one scan with a partial aggregate of at most ``buckets`` rows per target. When
    an interval holds at most ``bound`` rows these are ranked by a window over them;
    an interval of one key value with more rows than that (ties) goes through
    :func:`ordered_scan`. A split is then a plain filter on the boundary.
    """
    base = df.select(
        key.cast("long").alias("_key"),
        F.col(id_col).alias("_id"),
        (F.col(stratum) if stratum else F.lit(0)).alias("_stratum"),
    ).filter("_key IS NOT NULL")
    ends = {
        r["_stratum"]: (r["lo"], r["hi"], r["n"])
        for r in base.groupBy("_stratum")
        .agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.count("*").alias("n"))
        .collect()
    }
    found: dict[tuple[object, int], Boundary] = {}
    open_: dict[tuple[object, int], tuple[int, int, int, int]] = {}
    for s, rank in set(targets):
        lo, hi, n = ends.get(s if stratum else 0, (0, 0, 0))
        if rank < 1 or n == 0:
            found[(s, rank)] = Boundary(None, None)
        else:
            open_[(s, rank)] = (lo, hi, min(rank, n), n)

    def member(interval: tuple[object, int, int]) -> Column:
        s, lo, hi = interval
        same = F.col("_stratum").eqNullSafe(F.lit(s if stratum else 0))
        return same & F.col("_key").between(lo, hi)

    def numbered(intervals: list[tuple[object, int, int]]) -> DataFrame:
        which = F.lit(None).cast("int")
        for i, interval in enumerate(intervals):
            which = F.when(member(interval), i).otherwise(which)
        return base.withColumn("_part", which).filter("_part IS NOT NULL")

    while True:
        wide = {t: v for t, v in open_.items() if v[3] > bound and v[1] > v[0]}
        if not wide:
            break
        intervals = sorted({(t[0], v[0], v[1]) for t, v in wide.items()}, key=str)
        step = {i: max(1, -(-(hi - lo + 1) // buckets)) for i, (_, lo, hi) in enumerate(intervals)}
        slot = F.lit(None).cast("long")
        for i, (_, lo, _hi) in enumerate(intervals):
            slot = F.when(F.col("_part") == i, F.expr(f"(_key - {lo}L) div {step[i]}L")).otherwise(slot)
        counts: dict[int, dict[int, int]] = {}
        for r in numbered(intervals).groupBy("_part", slot.alias("_slot")).count().collect():
            counts.setdefault(r["_part"], {})[r["_slot"]] = r["count"]
        for t, (lo, hi, left, _n) in wide.items():
            i = intervals.index((t[0], lo, hi))
            for b in sorted(counts[i]):
                if left <= counts[i][b]:
                    low = lo + b * step[i]
                    open_[t] = (low, min(hi, low + step[i] - 1), left, counts[i][b])
                    break
                left -= counts[i][b]

    def pick(rows: DataFrame, intervals: list[tuple[object, int, int]], chosen) -> None:
        wanted = F.lit(False)
        for t, (lo, hi, left, _n) in chosen.items():
            i = intervals.index((t[0], lo, hi))
            wanted = wanted | ((F.col("_part") == i) & (F.col("_rank") == left))
        at = {(r["_part"], r["_rank"]): r for r in rows.filter(wanted).collect()}
        for t, (lo, hi, left, _n) in chosen.items():
            r = at[(intervals.index((t[0], lo, hi)), left)]
            found[t] = Boundary(r["_key"], r["_id"])

    for tied in (False, True):
        chosen = {t: v for t, v in open_.items() if (v[3] > bound) == tied}
        if not chosen:
            continue
        intervals = sorted({(t[0], v[0], v[1]) for t, v in chosen.items()}, key=str)
        rows = numbered(intervals)
        if tied:
            ranked = ordered_scan(
                rows, ["_part"], [F.col("_key"), F.col("_id")], {"_rank": ("sum", F.lit(1))}
            )
        else:
            ranked = rows.withColumn(
                "_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_key", "_id"))
            )
        pick(ranked, intervals, chosen)
    return found


def hash_key(id_col: str, salt: object) -> Column:
    """A seeded, engine-independent order: the first 60 bits of an MD5 as a bigint."""
    digest = F.md5(F.concat_ws(":", F.lit(str(salt)), F.col(id_col)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
