"""Exact neighbours, seeded permutations, samples by rank, importance and many quantiles at once."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.ml import forest, oversample
from txrisk.operators import neighbours, permute
from txrisk.operators.statistics import quantiles
from txrisk.plans.oracles import permutation_sql


def brute(x, k):
    """Squared distances and indices of the k nearest others, by (distance, index)."""
    d_out, i_out = np.empty((len(x), k)), np.empty((len(x), k), int)
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        near = near[np.lexsort((near, d[near]))][:k]
        d_out[i], i_out[i] = d[near], near
    return d_out, i_out


def spark_points(spark, x):
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "_rank long, x array<double>").repartition(5)


def found(df):
    rows = df.select("_rank", F.transform("near", lambda e: e["rank"]).alias("r"), F.transform("near", lambda e: e["d"]).alias("d")).toPandas()
    rows = rows.sort_values("_rank")
    return np.vstack(rows["d"].to_numpy()), np.vstack(rows["r"].to_numpy())


def shapes():
    rng = np.random.default_rng(4)
    n = 1_500
    yield "plane", rng.normal(size=(n, 2)), 64
    yield "ten dimensions", rng.normal(size=(n, 10)), 128
    yield "forty dimensions", rng.normal(size=(n, 40)), 200
    yield "forty of low rank, far from the origin", rng.normal(size=(n, 4)) @ rng.normal(size=(4, 40)) + 1e6, 100
    lattice = rng.integers(0, 9, size=(700, 3)).astype(float)
    yield "lattice with ties and one point 500 times", np.vstack([lattice, np.tile([[1.0, 2.0, 3.0]], (500, 1)), rng.normal(size=(300, 3)) * 50]), 32
    yield "unequal scales", rng.normal(size=(n, 3)) * [1e6, 1.0, 1e-3], 64
    yield "one point only", np.ones((40, 2)), 8
    yield "fewer points than a block", rng.normal(size=(9, 2)), 1024


@pytest.mark.parametrize("name,x,block", list(shapes()), ids=[s[0] for s in shapes()])
def test_neighbours_are_those_of_brute_force(spark, name, x, block):
    want_d, want_i = brute(x, 5)
    d, i = found(neighbours.nearest(spark_points(spark, x), 5, block))
    assert np.allclose(d, want_d, rtol=1e-12, atol=0) and (i == want_i).all()


def test_most_blocks_are_never_asked_in_low_dimensions(spark):
    x = np.random.default_rng(1).random((20_000, 2))
    points = neighbours.distinct_points(spark_points(spark, x), 5)
    pivots = x[:: len(x) // 40]
    blocks = neighbours.blocks_of(neighbours.cells_of(points, pivots, 500), 5, 2)
    n = blocks.count()
    asked = neighbours.questions(blocks, pivots, 5)
    assert asked.count() < n * 15  # of 41 cells
    points_asked = asked.select(F.sum(F.octet_length("heads") / 8)).first()[0]
    assert points_asked < 2 * len(x)  # a point asks its own cell and seldom another


def test_fewer_rows_than_neighbours_and_none(spark):
    few = neighbours.nearest(spark_points(spark, np.array([[0.0], [1.0], [3.0]])), 2).orderBy("_rank").collect()
    assert [[e["rank"] for e in r["near"]] for r in few] == [[1, 2], [0, 2], [1, 0]]
    assert neighbours.nearest(spark_points(spark, np.zeros((0, 2))).filter("false"), 2).count() == 0


def test_whole_balanced_set(spark):
    rows = [(f"r{i}", float(i), float(i % 7), int(i < 12)) for i in range(100)]
    df = spark.createDataFrame(rows, "transaction_id string, a double, b double, is_fraud int")
    whole = oversample.balanced_set(df, ["a", "b"])
    assert {r["is_fraud"]: r["count"] for r in whole.groupBy("is_fraud").count().collect()} == {0: 88, 1: 88}
    assert whole.filter("draw IS NULL").count() == 100 and whole.filter("transaction_id IS NULL").count() == 76
    with pytest.raises(ValueError, match="no finite"):
        oversample.smote(df.withColumn("b", F.when(F.col("a") != 3, F.col("b"))), ["a", "b"], 50)


# -------------------------------------------------------------- permutations

@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 100, 4096, 4097, 50_000])
def test_every_rank_comes_once(n):
    for key in ("a", "b"):
        assert (np.sort(permute.permuted(np.arange(n), n, key)) == np.arange(n)).all()


def test_places_are_known_alone_and_keys_differ():
    n = 10_000_019
    some = permute.permuted(np.arange(1000), n, "x")
    assert len(set(some)) == 1000 and some.max() < n and permute.permuted(np.array([77]), n, "x")[0] == some[77]
    assert (permute.permuted(np.arange(1000), n, "y") != some).mean() > 0.99
    # places spread evenly: thirds of the range hold a third each
    assert np.allclose(np.histogram(some, 3, (0, n))[0] / 1000, 1 / 3, atol=0.06)


def test_permutation_in_sql():
    n, key = 1000, "42:tree-3"
    sql = permutation_sql(f"SELECT {n} AS n, '{key}' AS key, range AS place FROM range({n})")
    got = np.array(duckdb.sql(f"WITH RECURSIVE {sql} SELECT place, rank FROM permuted ORDER BY place").fetchall())
    assert (got[:, 1] == permute.permuted(np.arange(n), n, key)).all()


@pytest.mark.parametrize("n", [100, 3_000])
def test_tree_samples_are_the_permuted_ranks(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))
    s = forest.ForestSettings(trees=5, sample=128)
    order = sorted(map(str, range(n)), key=lambda i: (int(hashlib.md5(f"{s.seed}:{i}".encode()).hexdigest()[:15], 16), i))
    want = {(t, order[r]) for t in range(5) for r in permute.permuted(np.arange(min(128, n)), n, f"{s.seed}:tree-{t}")}
    got = [(r["tree"], r["id"]) for r in forest.tree_samples(df, "id", s).collect()]
    assert len(got) == len(want) == 5 * min(128, n) and set(got) == want


def test_importance_finds_the_feature_that_matters(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), float(a) * (20 if i < 15 else 1), float(b), 1.0) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))]
    df = spark.createDataFrame(rows, "transaction_id string, a double, b double, same double")
    detector = forest.fit_forest(df, ["a", "b", "same"], settings=forest.ForestSettings(hidden=8, trees=20, sample=64))
    share = {r["feature"]: r["importance"] for r in forest.permutation_importance(detector, df).collect()}
    again = {r["feature"]: r["importance"] for r in forest.permutation_importance(detector, df.repartition(7)).collect()}
    assert share == pytest.approx(again) and sum(share.values()) == pytest.approx(1)
    assert share["same"] == pytest.approx(0, abs=1e-9) and share["a"] > 0


# ----------------------------------------------------------------- quantiles

def test_forty_columns_take_few_jobs(spark):
    rng = np.random.default_rng(8)
    data = {f"c{i}": rng.normal(size=30_000).round(i % 5) for i in range(38)}
    data |= {"flat": np.full(30_000, 2.5), "two": (np.arange(30_000) < 15_000) * 1e9}
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(4).cache()
    df.count()
    wanted = {c: [0.25, 0.5, 0.999] for c in data}
    spark.sparkContext.setJobGroup("quantiles", "quantiles")
    got = quantiles(df, wanted, bound=2_000)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles")
    spark.sparkContext.setJobGroup("", "")
    for c, v in data.items():
        assert got[c] == pytest.approx(list(np.quantile(v, wanted[c])), abs=1e-12), c
    assert len(jobs) <= 8, len(jobs)
