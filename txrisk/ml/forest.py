"""Deep isolation forest (M3-M5, M9): random deep features, isolation trees, anomaly scores.

Rows stay in Spark; Python sees Arrow batches. A row crosses to Python once: scaling, the
deep map and all trees run in one pandas UDF over broadcast weights and nodes, whose
sizes depend on the settings only (layers × hidden², trees × 511 nodes), not on the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.ml.scaling import impute_clip, medians, moments, normalise_scores
from txrisk.operators.ordered import hash_key
from txrisk.operators.permute import permuted, permuted_column, rows_at
from txrisk.operators.splits import with_rank
from txrisk.operators.statistics import quantiles
from txrisk.schema import COLUMNS, CONTAMINATION, SEED, component_seed
from txrisk.session import materialise


@dataclass(frozen=True)
class ForestSettings:
    layers: int = 3
    hidden: int = 128
    activation: str = "tanh"
    trees: int = 100
    sample: int = 256
    contamination: float = CONTAMINATION
    seed: int = SEED


# -------------------------------------------------------- M3: deep features

def layer_weights(n_in: int, s: ForestSettings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Untrained Xavier-uniform layers, drawn in a fixed order from the seed."""
    draw = np.random.RandomState(s.seed).uniform
    out = []
    for width in [n_in] + [s.hidden] * (s.layers - 1):
        reach = math.sqrt(6.0 / (width + s.hidden))
        out.append((draw(-reach, reach, (width, s.hidden)), draw(-reach, reach, s.hidden)))
    return out


ACTIVATIONS = {
    "tanh": np.tanh,
    "relu": lambda x: np.maximum(x, 0),
    "sigmoid": lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500))),
}


CHUNK = 1024  # rows whose features stay in a core's cache


def matrix(rows: pa.StructArray) -> np.ndarray:
    """Rows of a struct of doubles as a matrix; a missing value is NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in rows.flatten()]).astype(float, copy=False)


def deep_map(x: np.ndarray, weights, activation: str) -> np.ndarray:
    squash = ACTIVATIONS[activation]
    for w, b in weights:
        x = squash(x @ w + b)
    return x


def deep_features(df: DataFrame, columns: Sequence[str], out: str, s: ForestSettings = ForestSettings()) -> DataFrame:
    """M3: ``out`` = array of ``hidden`` deep features of (scaled) ``columns``."""
    shared = df.sparkSession.sparkContext.broadcast(layer_weights(len(columns), s))
    activation, hidden = s.activation, s.hidden

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def mapped(rows: pa.Array) -> pa.Array:
        x, deep = matrix(rows), np.empty((len(rows), hidden))
        for at in range(0, len(x), CHUNK):
            deep[at : at + CHUNK] = deep_map(x[at : at + CHUNK], shared.value, activation)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * hidden), pa.array(deep.ravel()))

    return df.withColumn(out, mapped(F.struct(*[F.col(c).cast("double") for c in columns])))


# ------------------------------------------------------ M4: isolation trees

EULER = 0.5772156649015329
NODE = T.StructType(
    [
        T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()), T.StructField("cut", T.DoubleType()),
        T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
        T.StructField("length", T.DoubleType()),
    ]
)


def expected_path(n: float) -> float:
    """c(n): mean path length of an unsuccessful search among n points (Liu, Ting and Zhou, 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, seed: int) -> list[tuple]:
    """Rows (node, feature, cut, left, right, length) of one tree over at most ``sample`` points."""
    rng = np.random.RandomState(seed)
    limit = math.ceil(math.log2(max(2, len(x))))
    nodes: list[tuple] = []
    waiting = [(np.arange(len(x)), 0, 0)]
    free = 1
    while waiting:
        rows, depth, node = waiting.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(splittable):
            nodes.append((node, -1, 0.0, node, node, depth + expected_path(len(rows))))
            continue
        f = int(rng.choice(splittable))
        cut = float(rng.uniform(low[f], high[f]))
        if cut >= high[f]:  # neighbouring numbers: rounding would leave the right side empty
            cut = float(low[f])
        goes_left = x[rows, f] <= cut
        nodes.append((node, f, cut, free, free + 1, 0.0))
        waiting += [(rows[goes_left], depth + 1, free), (rows[~goes_left], depth + 1, free + 1)]
        free += 2
    return nodes


def tree_samples(df: DataFrame, id_col: str, s: ForestSettings, ids: DataFrame | None = None) -> DataFrame:
    """``tree`` on a bounded sample: exactly min(sample, n) distinct rows for each tree, by one rule for every n.

    Rows are ranked by a seeded hash of their id, and each tree takes the first places of its own permutation of the
    ranks. The places are known without the table; it is filtered, never sorted or multiplied. ``ids``, where given, holds the
    ids of ``df`` and is cheaper to read: the rows are counted and ranked there.
    """
    ids = df if ids is None else ids
    n = ids.count()
    each = min(s.sample, n)
    ranks = [(tree, int(r)) for tree in range(s.trees) for r in permuted(np.arange(each), n, f"{s.seed}:tree-{tree}")]
    picks = df.sparkSession.createDataFrame(pd.DataFrame(ranks, columns=["tree", "rank"]), "tree int, rank long")
    drawn = rows_at(ids, id_col, s.seed, picks, len(ranks)).withColumnRenamed("_id", id_col)
    return df.join(F.broadcast(drawn.drop("rank")), id_col)  # at most trees x sample rows


def fit_trees(df: DataFrame, columns: Sequence[str], id_col: str, s: ForestSettings, ids: DataFrame | None = None) -> DataFrame:
    """M4: node rows of all trees; each tree is grown by its own task from its own sample.

    Only sampled rows get deep features.
    """
    seed = s.seed

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = np.vstack(pdf.sort_values("_id")["_vector"].to_numpy())
        nodes = grow_tree(points, component_seed(f"tree-{tree}", seed))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "length"])
        out.insert(0, "tree", tree)
        return out

    sampled = deep_features(tree_samples(df, id_col, s, ids), columns, "_vector", s)
    return sampled.select("tree", F.col(id_col).alias("_id"), "_vector").groupBy("tree").applyInPandas(grow, NODE)


def pack_nodes(rows) -> dict[int, dict[str, np.ndarray]]:
    """Arrays per tree, indexed by node number."""
    frame = pd.DataFrame([r.asDict() for r in rows])
    return {
        int(tree): {c: part.sort_values("node")[c].to_numpy() for c in ("feature", "cut", "left", "right", "length")}
        for tree, part in frame.groupby("tree")
    }


@dataclass(frozen=True)
class Levels:
    """All trees side by side, level by level: place i of a level leads to 2i (left) and 2i + 1 of the next.

    What lies below a leaf repeats it, so every row goes down to the last level. There are trees x 2**level places.
    """

    features: list[np.ndarray]
    cuts: list[np.ndarray]
    lengths: np.ndarray  # of the last level's places
    trees: int


def levels(trees: dict[int, dict[str, np.ndarray]]) -> Levels:
    parts = list(trees.values())
    most = max(len(t["feature"]) for t in parts)
    whole = {c: np.stack([np.resize(t[c], most) for t in parts]) for c in ("feature", "cut", "left", "right", "length")}
    at, features, cuts = np.zeros((len(parts), 1), dtype=int), [], []
    while True:
        here = {c: np.take_along_axis(v, at, 1) for c, v in whole.items()}
        if (here["feature"] < 0).all():
            return Levels(features, cuts, here["length"].ravel(), len(parts))
        features.append(np.maximum(here["feature"], 0).ravel().astype(np.int64))
        cuts.append(here["cut"].ravel())
        at = np.stack([here["left"], here["right"]], 2).reshape(len(parts), -1)


def mean_path(x: np.ndarray, trees: Levels) -> np.ndarray:
    """Mean length of each row's paths; all trees go down a level at once."""
    flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    place = np.repeat(np.arange(trees.trees)[:, None], len(x), 1)
    for feature, cut in zip(trees.features, trees.cuts):
        value = feature.take(place)
        value += first
        right = ~(flat.take(value) <= cut.take(place))
        place <<= 1
        place += right
    return trees.lengths.take(place).sum(0) / trees.trees


# ------------------------------------------------------------- M5: scoring

@dataclass
class DeepForest:
    """A fitted detector: everything it holds is bounded by its settings."""

    columns: list[str]
    fills: dict[str, float]
    scale: dict[str, tuple[float, float]]
    trees: dict[int, dict[str, np.ndarray]]
    sample: int
    offset: float = 0.0
    ends: tuple[float, float] = (0.0, 1.0)
    settings: ForestSettings = field(default_factory=ForestSettings)

    def raw_score(self, df: DataFrame, out: str = "raw_score", columns: Column | None = None) -> DataFrame:
        """M5: -2^(-E[h]/c(ψ)) - offset; lower means more isolated."""
        of = self.scorer(df.sparkSession)

        @F.arrow_udf(T.DoubleType())
        def score(rows: pa.Array) -> pa.Array:
            return pa.array(of(matrix(rows)))

        ready = F.struct(*[F.col(c).cast("double") for c in self.columns]) if columns is None else columns
        return df.withColumn(out, score(ready))

    def scorer(self, spark: SparkSession):
        """The raw score of a matrix of prepared rows, for use inside tasks."""
        s = self.settings
        shared = spark.sparkContext.broadcast(
            (
                np.array([self.scale[c][0] for c in self.columns]),
                np.array([self.scale[c][1] for c in self.columns]),
                layer_weights(len(self.columns), s),
                levels(self.trees),
            )
        )
        normal, offset, activation = expected_path(self.sample) or 1.0, self.offset, s.activation

        def score(rows: np.ndarray) -> np.ndarray:
            mean, deviation, weights, trees = shared.value
            lengths = np.empty(len(rows))
            for at in range(0, len(rows), CHUNK):
                x = deep_map((rows[at : at + CHUNK] - mean) / deviation, weights, activation)
                lengths[at : at + CHUNK] = mean_path(x, trees)
            return -np.power(2.0, -lengths / normal) - offset

        return score

    def prepare(self, df: DataFrame) -> DataFrame:
        return impute_clip(df, self.columns, self.fills)

    def transform(self, df: DataFrame, out: str = "anomaly_score", scale: str = "fitted") -> DataFrame:
        """Scores in [0, 1]; ``scale="batch"`` uses the batch's own range, which depends on its rows."""
        scored = self.raw_score(self.prepare(df), "_raw")
        ends = self.ends if scale == "fitted" else None
        return normalise_scores(scored, "_raw", out, ends, self.settings.contamination).drop("_raw")


def fit_forest(
    df: DataFrame, columns: Sequence[str], id_col: str = COLUMNS.id, settings: ForestSettings = ForestSettings()
) -> DeepForest:
    """M4 with M1-M3 before it and the training range (M6) and offset after it."""
    columns = list(columns)
    fills = medians(df, columns)
    ready = impute_clip(df.select(id_col, *columns), columns, fills)
    scale = moments(ready, columns)
    scaled = ready.withColumns({c: (F.col(c) - m) / d for c, (m, d) in scale.items()})
    nodes = fit_trees(scaled, columns, id_col, settings)
    trees = pack_nodes(nodes.collect())  # trees × (2·sample - 1) rows at most
    rows = ready.limit(settings.sample).count()
    forest = DeepForest(columns, fills, scale, trees, min(settings.sample, rows), settings=settings)
    # Scored once; range and offset read the written column, not the trees again.
    scored = materialise(forest.raw_score(ready).select("raw_score"), "raw-scores")
    lo, hi = scored.agg(F.min("raw_score"), F.max("raw_score")).first()
    forest.offset = quantiles(scored, {"raw_score": [settings.contamination]})["raw_score"][0]
    forest.ends = (lo - forest.offset, hi - forest.offset)
    return forest


# -------------------------------------------- M9: permutation importance

def permutation_importance(
    forest: DeepForest, df: DataFrame, id_col: str = COLUMNS.id, rows: int | None = None
) -> DataFrame:
    """M9: change of the mean score when one feature is shuffled, normalised to sum 1.

    Works on all rows, or on ``rows`` of them where the caller names a number. Rows are ranked once over range partitions;
    the row at rank r borrows values from the row at rank P(r) of a seeded permutation. That is one join of the table with
    itself by rank, and the features are tried one after the other inside a batch, which gives back sums only.
    """
    columns, s = forest.columns, forest.settings
    head = forest.prepare(df.select(id_col, *columns))
    if rows is not None:
        head = head.orderBy(hash_key(id_col, s.seed), id_col).limit(rows)
    ranked = materialise(with_rank(head, [], [F.col(id_col)], "_rank").select((F.col("_rank") - 1).alias("_rank"), F.array(*columns).alias("x")), "ranked")
    n = ranked.count()
    lender = permuted_column(F.col("_rank"), n, f"{s.seed}:importance")
    pairs = ranked.select(lender.alias("_lender"), "x").join(ranked.select(F.col("_rank").alias("_lender"), F.col("x").alias("y")), "_lender")
    score, (lo, hi) = forest.scorer(df.sparkSession), forest.ends

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, len(columns)) for c in "xy")
            if not len(x):
                continue
            whole, total = score(x), []
            for f in range(-1, len(columns)):
                raw = whole
                if f >= 0:
                    # A row that borrows its own value keeps its score.
                    other = np.flatnonzero(x[:, f] != y[:, f])
                    tried, raw = x[other], whole.copy()
                    tried[:, f] = y[other, f]
                    raw[other] = score(tried)
                total.append(float(np.clip((hi - raw) / (hi - lo), 0, 1).sum()) if hi > lo else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(columns)), pa.int32()), pa.array(total, pa.float64())], ["f", "total"])

    means = {r["f"]: r["total"] / n for r in pairs.select("x", "y").mapInArrow(sums, "f int, total double").groupBy("f").agg(F.sum("total").alias("total")).collect()}
    change = [abs(means.get(f, 0.0) - means.get(-1, 0.0)) for f in range(len(columns))]
    whole = sum(change)
    out = [(c, v / whole if whole > 0 else 0.0) for c, v in zip(columns, change)]
    return df.sparkSession.createDataFrame(out, "feature string, importance double")
