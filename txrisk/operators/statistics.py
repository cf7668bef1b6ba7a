"""Exact medians, percentiles and modes with bounded memory per task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_ROWS = 1_000_000  # distinct values of a bracket that one task sorts
ACCURACY = 10_000
SLACK = 2.0 / ACCURACY


def _clean(name: str):
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def quantiles(
    df: DataFrame, wanted: dict[str, Sequence[float]], bound: int = EXACT_ROWS
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles per numeric column; ``None`` for a column without values.

    All ranks of all columns are sought together. One aggregate of sketches brackets every rank, one aggregate counts the
    values below and inside every bracket, and one job looks at the values inside, usually 1/2500 of them, counted
    by value. Brackets that miss their rank are widened, those that hold more than about ``bound`` distinct values
    narrowed, before that last job, in which each rank has a task of its own.
    """
    names = [c for c in wanted if len(wanted[c])]
    spots = [(c, float(q)) for c in names for q in wanted[c]]
    out: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in wanted}
    if not spots:
        return out
    shares = {c: sorted({min(1.0, max(0.0, q + e)) for q in map(float, wanted[c]) for e in (-SLACK, SLACK)}) for c in names}
    row = df.agg(*[F.struct(
        F.count(_clean(c)).alias("n"), F.min(_clean(c)).alias("min"), F.max(_clean(c)).alias("max"),
        F.percentile_approx(_clean(c), shares[c], ACCURACY).alias("at"),
    ).alias(f"s{i}") for i, c in enumerate(names)]).first()
    open_: dict[tuple[str, float], _Bracket] = {}
    for c, s in zip(names, row):
        at = dict(zip(shares[c], s["at"] or []))
        for q in map(float, wanted[c]):
            if s["n"]:
                lo, hi = (at[min(1.0, max(0.0, q + e))] for e in (-SLACK, SLACK))
                b = _Bracket(c, math.floor(q * (s["n"] - 1)), math.ceil(q * (s["n"] - 1)), s["min"], s["max"], s["n"], s["min"], s["max"])
                if s["n"] > min(ACCURACY, bound):  # of fewer values all are looked at
                    b.lo, b.hi, b.inside = lo, hi, 0
                open_[c, q] = b
    _settle(df, [b for b in open_.values() if not b.inside], bound, max(s["n"] for s in row))
    values = _values_at(df, list(open_.values()))
    for c in names:
        for i, q in enumerate(map(float, wanted[c])):
            if (c, q) in open_:
                b = open_[c, q]
                low, high = values[b]
                n = next(s["n"] for name, s in zip(names, row) if name == c)
                out[c][i] = low + (high - low) * (q * (n - 1) - b.first) if high != low else low
    return out


@dataclass(eq=False)
class _Bracket:
    """Values lo..hi of a column that are to hold the zero-based ranks first..last."""

    column: str
    first: int
    last: int
    lo: float
    hi: float
    inside: int
    least: float
    most: float
    below: int = 0
    slack: float = SLACK

    def shares(self) -> list[float]:
        """Where in the bracket the ranks are, with room for the error of a sketch."""
        return [max(0.0, (self.first - self.below) / self.inside - self.slack), min(1.0, (self.last - self.below + 1) / self.inside + self.slack)]

    def holds(self) -> Column:
        return _clean(self.column).between(F.lit(self.lo), F.lit(self.hi))


def _settle(df: DataFrame, brackets: list[_Bracket], bound: int, rows: int) -> None:
    """Count all brackets, and widen or narrow until each holds its ranks and few values.

    Distinct values only matter where more than ``bound`` are inside. Counting them costs more than all the rest, so on a table of
    many ``rows`` this is an aggregate of its own, of the brackets that turned out large.
    """
    todo, at_once = brackets, bound < rows <= EXACT_ROWS
    while todo:
        distinct = {b: F.approx_count_distinct(F.when(b.holds(), _clean(b.column))).alias(f"distinct{i}") for i, b in enumerate(todo)} if at_once else {}
        counts = df.agg(*[e.alias(f"{what}{i}") for i, b in enumerate(todo) for what, e in (
            ("below", F.count_if(_clean(b.column) < F.lit(b.lo))), ("inside", F.count_if(b.holds())))], *distinct.values()).first()
        again, large = [], []
        for i, b in enumerate(todo):
            before, b.below, b.inside = b.inside, counts[f"below{i}"], counts[f"inside{i}"]
            if not b.below <= b.first <= b.last < b.below + b.inside:  # the sketch was off
                b.lo, b.hi, b.inside, b.slack = b.least, b.most, 0, 4 * b.slack
                again.append(b)
            elif b.inside > bound and b.lo < b.hi and b.inside != before:
                large.append(b)
        if at_once:
            again += [b for b in large if counts[f"distinct{todo.index(b)}"] > bound]
        elif large:  # many values inside, but perhaps few distinct ones
            distinct = df.agg(*[F.approx_count_distinct(F.when(b.holds(), _clean(b.column))).alias(f"d{i}") for i, b in enumerate(large)]).first()
            again += [b for i, b in enumerate(large) if distinct[i] > bound]
        narrow = [b for b in again if b.inside]
        if narrow:
            row = df.agg(*[F.percentile_approx(F.when(b.holds(), _clean(b.column)), b.shares(), ACCURACY).alias(f"b{i}") for i, b in enumerate(narrow)]).first()
            for b, (lo, hi) in zip(narrow, row):
                b.lo, b.hi = lo, hi
        todo = again


def _values_at(df: DataFrame, brackets: list[_Bracket]) -> dict[_Bracket, tuple[float, float]]:
    """The values at the two ranks of each bracket."""
    found = {b: (b.lo, b.hi) for b in brackets if b.lo == b.hi}
    rest = [b for b in brackets if b.lo < b.hi]
    if not rest:
        return found
    held = F.array(*[F.when(b.holds(), F.struct(F.lit(i).alias("of"), _clean(b.column).alias("v"))) for i, b in enumerate(rest)])
    counts = df.select(F.explode(F.filter(held, lambda e: e.isNotNull())).alias("e")).groupBy("e.of", "e.v").count()
    ranks = df.sparkSession.createDataFrame([(i, b.first - b.below, b.last - b.below) for i, b in enumerate(rest)], "of int, first long, last long")
    running = Window.partitionBy("of").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("count").over(running)).join(F.broadcast(ranks), "of")
    rows = placed.groupBy("of").agg(
        F.min(F.when(F.col("upto") > F.col("first"), F.col("v"))).alias("low"), F.min(F.when(F.col("upto") > F.col("last"), F.col("v"))).alias("high")
    ).collect()  # one row per rank
    return found | {rest[r["of"]]: (r["low"], r["high"]) for r in rows}


def value_counts(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    """(column, value, count) over all ``columns``, cast to one type; nulls are left out.

    The expand is map-side and is folded by the partial aggregate before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("_pair"))
        .select("_pair.column", "_pair.value")
        .filter("value IS NOT NULL")
        .groupBy("column", "value")
        .count()
    )


def modes(df: DataFrame, columns: Sequence[str], as_type: str = "string") -> dict[str, tuple[object, int]]:
    """Per column: (most frequent value, number of distinct values); ties go to the smallest value."""
    if not columns:
        return {}
    best = F.min(F.struct((-F.col("count")).alias("rank"), F.col("value")))
    rows = (
        value_counts(df, columns, as_type)
        .groupBy("column")
        .agg(best.alias("best"), F.count("*").alias("distinct"))
        .collect()
    )
    return {r["column"]: (r["best"]["value"], r["distinct"]) for r in rows}
