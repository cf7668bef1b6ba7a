"""Synthetic minority oversampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators.neighbours import nearest
from txrisk.operators.ordered import hash_key
from txrisk.operators.splits import label_counts, with_rank
from txrisk.schema import COLUMNS, SEED

SHARES = 1_000_000


def smote(
    df: DataFrame,
    columns: Sequence[str],
    wanted: int,
    label: str = COLUMNS.label,
    id_col: str = COLUMNS.id,
    k: int = 5,
    seed: int = SEED,
) -> DataFrame:
    """Synthetic positives that bring the class to ``wanted`` rows: (draw, columns..., label).

    Draw j takes a minority row and one of its k nearest minority neighbours by seeded hashes of j, and lies
    between them at a hashed share of the way. Neighbours are exact for any number of rows. Rows of which a column
    is null, infinite or not a number have no place and raise.
    """
    columns = list(columns)
    values = [F.col(c).cast("double") for c in columns]
    minority = df.filter(F.col(label) == 1).select(F.col(id_col).alias("_id"), F.array(*values).alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    n, bad = minority.agg(F.count(F.lit(1)), F.count_if(odd)).first()
    if n < 2:
        raise ValueError("oversampling needs at least two minority rows")
    if bad:
        raise ValueError(f"{bad} minority rows have values that are no finite numbers")
    k = min(k, n - 1)
    known = nearest(with_rank(minority, [], [F.col("_id")], "_rank"), k)
    rolled = lambda what, upto: F.pmod(hash_key("id", f"{seed}:{what}"), F.lit(upto))
    draws = df.sparkSession.range(max(0, wanted - n)).select(
        F.col("id").alias("draw"), (rolled("row", n) + 1).alias("_rank"),
        (rolled("near", k) + 1).cast("int").alias("_pick"), (rolled("share", SHARES) / SHARES).alias("_u"),
    )
    joined = draws.join(known, "_rank").select("draw", "_u", "x", F.element_at("near", F.col("_pick"))["x"].alias("_to"))
    return joined.select(
        "draw",
        *[(F.col("x")[i] + F.col("_u") * (F.col("_to")[i] - F.col("x")[i])).alias(c) for i, c in enumerate(columns)],
        F.lit(1).alias(label),
    )


def balanced_set(
    df: DataFrame, columns: Sequence[str], label: str = COLUMNS.label, id_col: str = COLUMNS.id, k: int = 5, seed: int = SEED
) -> DataFrame:
    """D7, the whole set: every row of ``df`` (its id, columns as doubles, label) and the synthetic positives that bring
    their class level with the other; these have no id but a ``draw``, which is null for given rows."""
    counts = label_counts(df, label)
    made = smote(df, columns, counts.get(0, 0), label, id_col, k, seed)
    given = df.select(
        F.col(id_col), F.lit(None).cast("long").alias("draw"), *[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("int").alias(label)
    )
    return given.unionByName(made.withColumn(id_col, F.lit(None).cast(df.schema[id_col].dataType)))


def decode(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Interpolated label codes back to categories: clipped to the known codes, then cut to an integer."""
    code = F.least(F.greatest(F.col(column), F.lit(0.0)), F.lit(float(len(known) - 1))).cast("int")
    return df.withColumn(column, F.element_at(F.array(*[F.lit(v) for v in known]), code + 1))
