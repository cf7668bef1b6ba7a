"""Seeded permutations of the ranks 0..n-1 that are computed place by place, and rows by their rank.

A balanced Feistel network permutes the numbers below the least power of four that is not less than n; a result of n or
more is put through again until it is below n (cycle walking). So any place of the permutation is known without the
others: no table of n numbers, no sort, no shuffle. The round function multiplies modulo a prime below 2**31, which
64-bit integers hold exactly, so SQL gives the same numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.ordered import hash_key

ROUNDS = 6
# A prime and two multipliers of the round function.
PRIME, FIRST, SECOND = 2_147_483_647, 1_597_334_677, 1_103_515_245
PICKED_SHARE = 16  # buckets of a ranking per picked rank


def half_bits(n: int) -> int:
    """Half the bits of the network for n ranks."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def round_keys(key: object) -> list[int]:
    """28 bits of an MD5 for each round."""
    return [int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:7], 16) for i in range(ROUNDS)]


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + key) * FIRST % PRIME
    x = (x ^ (x >> 15)) * SECOND % PRIME
    return x ^ (x >> 13)


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for key in keys:
        left, right = right, left ^ (_mixed(right, key) & mask)
    return left << half | right


def permuted(places: np.ndarray, n: int, key: object) -> np.ndarray:
    """The ranks at ``places`` (0..n-1) of the permutation named by ``key``; n below 2**62."""
    half, keys = half_bits(n), round_keys(key)
    out = np.asarray(places, np.int64).copy()
    left = np.arange(len(out))
    while len(left):
        out[left] = _network(out[left], half, keys)
        left = left[out[left] >= n]
    return out


def permuted_column(place: Column, n: int, key: object) -> Column:
    """:func:`permuted` over a column of places."""

    @F.arrow_udf("bigint")
    def at(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(permuted(column.to_numpy(), n, key))

    return at(place.cast("long"))


def rows_at(df: DataFrame, id_col: str, seed: int, picks: DataFrame, wanted: int) -> DataFrame:
    """``picks`` (rank 0..n-1, and more) with the id of the row at that rank, in the order of a seeded hash of the id.

    The table is neither sorted nor written: rows are counted by ranges of the hash, narrow enough that most ranges hold
    no picked rank, and only the rows of the others are ranked, each range for itself. ``picks`` has at most
    ``wanted`` rows, a number from settings, so both joins broadcast it.
    """
    bits = max(8, min(24, (PICKED_SHARE * wanted).bit_length()))
    key = hash_key(id_col, seed)
    keyed = df.select(F.col(id_col).alias("_id"), key.alias("_hash")).withColumn("_range", F.shiftright("_hash", 60 - bits).cast("int"))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # At most 2**bits rows: by blocks of 256 ranges, then within each.
    block = F.shiftright("_range", 8)
    in_block = Window.partitionBy("_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(block.alias("_block")).agg(F.sum("n").alias("_all"))
    whole = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_block", "_all", F.coalesce(F.sum("_all").over(whole), F.lit(0)).alias("_start"))
    known = counts.withColumn("_block", block).join(F.broadcast(starts.drop("_all")), "_block").select(
        "_block", "_range", "n", (F.col("_start") + F.coalesce(F.sum("n").over(in_block), F.lit(0))).alias("_before")
    )
    # A rank finds its block first, among the few blocks, and then only meets the ranges of that block.
    placed = picks.join(F.broadcast(starts), (F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("_all")))
    hit = known.join(F.broadcast(placed.drop("_start", "_all")), "_block")
    hit = hit.filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("n")))
    hit = hit.withColumn("_nth", F.col("rank") - F.col("_before") + 1).drop("n", "_before", "_block")
    rows = keyed.join(F.broadcast(hit.select("_range").distinct()), "_range")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", "_id"))
    return rows.withColumn("_nth", nth.cast("long")).join(F.broadcast(hit), ["_range", "_nth"]).drop("_range", "_nth", "_hash")
