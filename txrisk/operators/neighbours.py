"""Exact nearest neighbours of every row among all rows, without comparing all with all.

A join by metric partitions. Equal points are one point first. Some points become pivots, every point belongs to the cell
of its nearest pivot, and cells are cut into blocks by the distance to the pivot, so that a block has a bounded number
of points whatever the cell. Neighbours inside the own block give each point a distance that its k-th neighbour cannot
exceed. By the triangle inequality a point then asks only those blocks that may hold a nearer one: those whose ring around
their pivot meets the point's ball, on the near side of the plane between the two pivots. What a block answers are at most
k points per question, and the k nearest of all answers are the result.

Pivots, cells and blocks decide how much is compared and never what comes out: neighbours are ordered by (squared distance,
rank), and every bound leaves room for rounding. In data of high dimension without structure no bound rules much out; the
work then grows, the memory of a task does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.ordered import hash_key, ordered_scan
from txrisk.operators.skew import attach, heavy_codes
from txrisk.session import materialise, small_batches

BLOCK = 1024  # points of a block
MAX_PIVOTS = 4096
PAIRS = 1 << 17  # exact distances that are in memory at once
BLOCKS_AT_ONCE = 4  # blocks in one Arrow batch

_BLOCKS_SQL = (
    "cell int, block bigint, n int, lo double, hi double, heads binary, points binary, members binary, far binary, "
    "near_at binary, near_d binary"
)
_ASK_SQL = "cell int, from_cell int, from_block bigint, lo double, hi double, heads binary, points binary, far binary"
_FOUND_SQL = "head bigint, d double, other bigint, x array<double>, members array<bigint>"
_FOUND = pa.schema([("head", pa.int64()), ("d", pa.float64()), ("other", pa.int64()), ("x", pa.list_(pa.float64())), ("members", pa.list_(pa.int64()))])


# ------------------------------------------------------------------ kernels

def squared_to(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``q`` to all rows of ``x``, quick and up to :func:`slack`."""
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0)


def slack(reach: float, dims: int) -> float:
    """Bound on the rounding error of :func:`squared_to` for vectors of length ``reach`` at most."""
    return 64 * (dims + 8) * np.finfo(float).eps * reach * reach


def closest(
    q: np.ndarray, x: np.ndarray, order: np.ndarray, limit: np.ndarray, k: int, own: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``q`` its k nearest rows of ``x`` within squared distance ``limit``: (row of q, row of x, squared distance).

    Sorted by row of q, distance and ``order``, the ranks of ``x``. With ``own``, row i of ``q`` is row i of ``x``
    and not its own neighbour. A quick matrix product chooses candidates, differences give the exact distances.
    """
    if not len(q) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    centre = x.mean(0)
    a, b = q - centre, x - centre
    near = squared_to(a, b)
    error = slack(max(np.sqrt((a * a).sum(1).max()), np.sqrt((b * b).sum(1).max())), q.shape[1])
    if own:
        np.fill_diagonal(near, np.inf)
    top = np.minimum(limit + error, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * error if near.shape[1] > k else np.inf)
    row, at = np.nonzero(near <= top[:, None])
    if own:
        row, at = row[row != at], at[row != at]
    exact = np.empty(len(row))
    for s in range(0, len(row), PAIRS):
        part = slice(s, s + PAIRS)
        exact[part] = ((q[row[part]] - x[at[part]]) ** 2).sum(1)
    ranked = np.lexsort((order[at], exact, row))
    row, at, exact = row[ranked], at[ranked], exact[ranked]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    good = (place < k) & (exact <= limit[row])
    return row[good], at[good], exact[good]


def _vectors(raw: pa.Scalar, dims: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, dims)


def _numbers(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.int64)


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _found(head: np.ndarray, d: np.ndarray, other: np.ndarray, x: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
    """Answers as a batch; ``members`` are padded by -1."""
    dims, known = x.shape[1], members >= 0
    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dims, pa.array(np.ascontiguousarray(x).ravel()))
    of = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(known.sum(1))]).astype(np.int32), pa.array(members[known]))
    return pa.RecordBatch.from_arrays([pa.array(head), pa.array(d), pa.array(other), lists, of], schema=_FOUND)


# ----------------------------------------------------------------- the join

def distinct_points(points: DataFrame, k: int) -> DataFrame:
    """(head, x, members): each different vector with its k + 1 least ranks; a vector of any number of rows.

    The rank filter is a group limit, so every task keeps k + 1 rows of a vector before they are shuffled.
    """
    nth = F.row_number().over(Window.partitionBy("x").orderBy("_rank"))
    first = points.select("x", "_rank", nth.alias("_nth")).filter(F.col("_nth") <= k + 1)
    groups = first.groupBy("x").agg(F.sort_array(F.collect_list("_rank")).alias("members"))
    return materialise(groups.select(F.col("members")[0].alias("head"), "x", "members"), "points")


def cells_of(points: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """``points`` with cell, distance to its pivot, and block (by rank of that distance within the cell)."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<cell:int,dist:double>")
    def nearest_pivot(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        centre = known.mean(0)
        for column in columns:
            x = column.flatten().to_numpy().reshape(len(column), known.shape[1])
            cell = np.empty(len(x), np.int32)
            for s in range(0, len(x), BLOCK):
                cell[s : s + BLOCK] = squared_to(x[s : s + BLOCK] - centre, known - centre).argmin(1)
            dist = np.sqrt(((x - known[cell]) ** 2).sum(1))
            yield pa.StructArray.from_arrays([pa.array(cell), pa.array(dist)], ["cell", "dist"])

    placed = points.select("*", nearest_pivot("x").alias("_to")).select(*points.columns, "_to.cell", "_to.dist")
    ranked = ordered_scan(placed, ["cell"], [F.col("dist"), F.col("head")], {"_nth": ("sum", F.lit(1).cast("long"))})
    return ranked.withColumn("block", F.floor((F.col("_nth") - 1) / block)).drop("_nth")


def blocks_of(placed: DataFrame, k: int, dims: int) -> DataFrame:
    """One row per block: its points as one matrix, and the k nearest within the block for each of them."""

    def gather(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("head").to_numpy(), table.column("dist").to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        heads, dist = table.column("head").to_numpy(), table.column("dist").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        members = np.full((len(heads), k + 1), -1, np.int64)
        for i, m in enumerate(table.column("members").to_pylist()):
            members[i, : len(m)] = m
        row, at, d = closest(x, x, heads, np.full(len(x), np.inf), k, own=True)
        near_at, near_d = np.full((len(heads), k), -1, np.int64), np.full((len(heads), k), np.inf)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        near_at[row, place], near_d[row, place] = at, d
        out = {
            "cell": table.column("cell")[0].as_py(), "block": table.column("block")[0].as_py(), "n": len(heads), "lo": dist[0], "hi": dist[-1],
            "heads": heads.tobytes(), "points": x.tobytes(), "members": members.tobytes(), "far": near_d[:, -1].tobytes(),
            "near_at": near_at.tobytes(), "near_d": near_d.tobytes(),
        }
        types = {"cell": pa.int32(), "block": pa.int64(), "n": pa.int32(), "lo": pa.float64(), "hi": pa.float64()}
        return pa.table({c: pa.array([v], types.get(c, pa.binary())) for c, v in out.items()})

    grouped = placed.select("cell", "block", "head", "x", "members", "dist").groupBy("cell", "block")
    return materialise(grouped.applyInArrow(gather, _BLOCKS_SQL), "blocks")


def questions(blocks: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """For each block and each cell that may hold nearer points: the points that ask, and the ring of the cell they ask."""
    spark, dims = blocks.sparkSession, pivots.shape[1]
    stats = {r["cell"]: r for r in blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    n, lo, hi = (np.array([stats[j][c] if j in stats else e for j in range(len(pivots))], float) for c, e in (("n", 0), ("lo", np.inf), ("hi", -np.inf)))
    shared = spark.sparkContext.broadcast((pivots, n, lo, hi))
    schema = pa.schema([
        ("cell", pa.int32()), ("from_cell", pa.int32()), ("from_block", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()),
        ("heads", pa.binary()), ("points", pa.binary()), ("far", pa.binary()),
    ])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, n, lo, hi = shared.value
        centre, full = pivots.mean(0), n > 0
        around = pivots - centre
        between = np.sqrt(squared_to(around, around))
        error = slack(float((np.sqrt((around * around).sum(1)) + np.where(full, hi, 0)).max()), dims)
        room = np.sqrt(error)
        for batch in batches:
            for r in range(batch.num_rows):
                own, block = batch.column("cell")[r].as_py(), batch.column("block")[r].as_py()
                heads, x = _numbers(batch.column("heads")[r]), _vectors(batch.column("points")[r], dims)
                far = np.sqrt(np.frombuffer(batch.column("far")[r].as_buffer(), np.float64))
                square = squared_to(x - centre, around)
                dist = np.sqrt(square)
                # All points of cell j lie within between + hi of the own pivot: with k + 1 of them, so does the k-th neighbour.
                reach = np.where(full, between[own] + hi, np.inf)
                by = np.argsort(reach)
                enough = by[min(int(np.searchsorted(np.cumsum(n[by]), k + 1)), len(by) - 1)]
                if n.sum() > k:
                    far = np.minimum(far, dist[:, own] + reach[enough] + 3 * room)
                wide = far[:, None] + 2 * room
                yes = full & (dist - wide <= hi) & (dist + wide >= lo)
                apart = np.where(between[own] > 0, between[own], np.inf)
                yes &= ~(square - square[:, [own]] - 4 * error > 2 * (apart + room) * wide) | (np.arange(len(full)) == own)
                for j in np.flatnonzero(yes.any(0)):
                    who = np.flatnonzero(yes[:, j])
                    yield _batch({
                        "cell": [j], "from_cell": [own], "from_block": [block], "lo": [(dist[who, j] - wide[who, 0]).min()],
                        "hi": [(dist[who, j] + wide[who, 0]).max()], "heads": [heads[who].tobytes()],
                        "points": [np.ascontiguousarray(x[who]).tobytes()], "far": [(far[who] ** 2 * (1 + 1e-12)).tobytes()],
                    }, schema)

    return blocks.select("cell", "block", "heads", "points", "far").mapInArrow(ask, _ASK_SQL)


def answers(asked: DataFrame, blocks: DataFrame, k: int, dims: int) -> DataFrame:
    """(head, d, other, x, members): for each question the points of the asked blocks that may be among the k nearest.

    Questions meet the short rows (cell, block, ring) first and the points only by (cell, block).
    """
    rings = blocks.select("cell", "block", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    meets = (F.col("_lo") <= F.col("hi")) & (F.col("_hi") >= F.col("lo"))
    other = ~((F.col("from_cell") == F.col("cell")) & (F.col("from_block") == F.col("block")))
    pairs = asked.join(rings, "cell").filter(meets & other).select("cell", "block", "heads", "points", "far")
    held = blocks.select("cell", "block", F.col("heads").alias("b_heads"), F.col("points").alias("b_points"), F.col("members").alias("b_members"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                head, q = _numbers(batch.column("heads")[r]), _vectors(batch.column("points")[r], dims)
                limit = np.frombuffer(batch.column("far")[r].as_buffer(), np.float64)
                order, x = _numbers(batch.column("b_heads")[r]), _vectors(batch.column("b_points")[r], dims)
                row, at, d = closest(q, x, order, limit, k)
                if len(row):
                    members = _numbers(batch.column("b_members")[r]).reshape(len(order), k + 1)
                    yield _found(head[row], d, order[at], x[at], members[at])

    return pairs.join(held, ["cell", "block"]).select("heads", "points", "far", "b_heads", "b_points", "b_members").mapInArrow(answer, _FOUND_SQL)


def inside(blocks: DataFrame, k: int, dims: int) -> DataFrame:
    """The neighbours within blocks, as answers."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                heads, x = _numbers(batch.column("heads")[r]), _vectors(batch.column("points")[r], dims)
                at = _numbers(batch.column("near_at")[r]).reshape(-1, k)
                d = np.frombuffer(batch.column("near_d")[r].as_buffer(), np.float64).reshape(-1, k)
                members = _numbers(batch.column("members")[r]).reshape(len(heads), k + 1)
                row, place = np.nonzero(at >= 0)
                to = at[row, place]
                if len(row):
                    yield _found(heads[row], d[row, place], heads[to], x[to], members[to])

    return blocks.select("heads", "points", "members", "near_at", "near_d").mapInArrow(unpack, _FOUND_SQL)


def nearest(points: DataFrame, k: int, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(_rank, x, near): the k nearest other rows of every row, as structs (d, rank, x) in order of (d, rank).

    ``points`` has a distinct ``_rank`` and a vector ``x`` of finite doubles per row, all of one length; ``d`` is the
    squared distance. Rows with the same vector are neighbours at distance 0; with fewer than k other rows all are
    listed. Any number of rows may share a vector.
    """
    points = points.select("_rank", "x")
    distinct = distinct_points(points, k)
    n, dims = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return points.withColumn("near", F.lit(None).cast("array<struct<d:double,rank:bigint,x:array<double>>>"))
    wanted = max(1, min(max_pivots, n // block))
    by_hash = distinct.orderBy(hash_key("head", "pivot"), "head").limit(wanted)
    pivots = np.array([r["x"] for r in by_hash.select("x").collect()])  # at most max_pivots rows
    blocks = blocks_of(cells_of(distinct, pivots, block), k, dims)
    with small_batches(points.sparkSession, BLOCKS_AT_ONCE):
        found = materialise(inside(blocks, k, dims).unionByName(answers(questions(blocks, pivots, k), blocks, k, dims)), "answers")
    nth = F.row_number().over(Window.partitionBy("head").orderBy("d", "other"))
    best = found.select("*", nth.alias("_nth")).filter(F.col("_nth") <= k)
    listed = best.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("d", "other", "x", "members"))).alias("others"))
    known = distinct.join(listed, "head", "left").select("x", "members", "others")
    rows = attach(points, known, ["x"], heavy_codes(points, {"x": ["x"]})["x"])
    entry = lambda d, rank, x: F.struct(d.alias("d"), rank.alias("rank"), x.alias("x"))
    same = F.transform(F.filter("members", lambda m: m != F.col("_rank")), lambda m: entry(F.lit(0.0), m, F.col("x")))
    away = F.flatten(F.transform(
        F.coalesce("others", F.array().cast("array<struct<d:double,other:bigint,x:array<double>,members:array<bigint>>>")),
        lambda e: F.transform(e["members"], lambda m: entry(e["d"], m, e["x"])),
    ))
    return rows.select("_rank", "x", F.slice(F.array_sort(F.concat(same, away)), 1, k).alias("near"))
