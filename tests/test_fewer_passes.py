"""Work that is done once: what is read again is written, and what need not be asked is not asked."""

import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from txrisk.ml import boosting, forest, model as models, scaling
from txrisk.operators import permute, statistics
from txrisk.plans import catalog
from txrisk.sources import tables
from txrisk.streaming import jobs

SMALL = forest.ForestSettings(hidden=8, trees=5, sample=32)


def walked(x, tree):
    node = 0
    while tree["feature"][node] >= 0:
        node = tree["left"][node] if x[tree["feature"][node]] <= tree["cut"][node] else tree["right"][node]
    return tree["length"][node]


def test_levels_lead_to_the_leaves_of_a_walk():
    draw = np.random.default_rng(3)
    x, trees = draw.normal(size=(300, 6)), {}
    for number, size in enumerate((1, 2, 20, 64)):
        nodes = sorted(forest.grow_tree(x[draw.choice(300, size, False)], number))
        columns = np.array(nodes).T
        trees[number] = {c: v.astype(int) if c in ("feature", "left", "right") else v for c, v in zip(("feature", "cut", "left", "right", "length"), columns[1:])}
    x[0, 2] = np.nan
    want = [sum(walked(row, t) for t in trees.values()) / len(trees) for row in x]
    assert forest.mean_path(x, forest.levels(trees)) == pytest.approx(want, abs=1e-12)


def test_neighbouring_numbers_are_cut_apart():
    x = np.array([[1.0], [np.nextafter(1.0, 2)]] * 8)
    for seed in range(20):
        lengths = [n for n in forest.grow_tree(x, seed) if n[1] < 0]
        assert len(lengths) == 2


def test_a_row_that_borrows_its_own_value_is_not_scored_again(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    class Counted(forest.DeepForest):
        def scorer(self, spark):
            def score(rows):
                seen.add(len(rows))
                return -rows.sum(1)
            return score

    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("a"), F.lit(1.0).alias("same"), (F.col("id") % 2).cast("double").alias("b"))
    counted = Counted(["a", "same", "b"], {"a": 0.0, "same": 0.0, "b": 0.0}, {}, {}, 8, ends=(-101.0, 0.0))
    rows = {r["feature"]: r["importance"] for r in forest.permutation_importance(counted, df, "id").collect()}
    assert rows["same"] == 0
    assert 100 <= seen.value < 100 + 100 + 100  # once as they are, most with another "a", about half with another "b"


def test_ranks_meet_the_ranges_of_their_block_only(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    picks = spark.createDataFrame([(t, r) for t in range(5) for r in range(t, 3000, 97)], "tree int, rank long")
    found = permute.rows_at(df, "id", 7, picks, picks.count())
    order = [r["id"] for r in df.orderBy(permute.hash_key("id", 7), "id").collect()]
    got = {(r["tree"], r["rank"]): r["_id"] for r in found.collect()}
    assert got == {(r["tree"], r["rank"]): order[r["rank"]] for r in picks.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"NestedLoopJoin[^\n]*_before", plan)


def test_trees_sample_by_a_table_of_ids(spark):
    ids = spark.range(400).select(F.col("id").cast("string").alias("id"))
    df = ids.withColumn("v", F.col("id").cast("double"))
    of = lambda out: {(r["tree"], r["id"]) for r in out.collect()}
    assert of(forest.tree_samples(df, "id", SMALL, ids)) == of(forest.tree_samples(df, "id", SMALL))


def test_the_fit_reads_its_rows_once(spark, sf, monkeypatch):
    read, write = {}, models.materialise

    def noted(df, label="table"):
        read[label] = df.inputFiles()
        return write(df, label)

    monkeypatch.setattr(models, "materialise", noted)
    models.RiskModel.fit(tables.transactions(spark, sf), rounds=2, forest=SMALL)
    for label in ("features", "receivers", "own"):
        assert read[label] and all("/ready-" in f for f in read[label])


def test_moments_of_many_columns(spark):
    x = np.random.default_rng(5).normal(size=(200, 19)) * np.arange(1, 20)
    x[3, 4] = np.nan
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"c{i} double" for i in range(19)))
    found = scaling.moments(df, df.columns)
    assert list(found) == df.columns
    assert np.array(list(found.values())) == pytest.approx(np.array([np.nanmean(x, 0), np.nanstd(x, 0)]).T)


def test_distinct_values_are_counted_in_large_brackets_only(spark, monkeypatch):
    calls, count = [], F.approx_count_distinct
    monkeypatch.setattr(statistics.F, "approx_count_distinct", lambda *a: calls.append(1) or count(*a))
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_011).cast("double").alias("v"))
    want = np.quantile(np.arange(30_000) * 7919 % 30_011, 0.5)
    assert statistics.quantiles(df, {"v": [0.5]})["v"][0] == want and not calls
    assert statistics.quantiles(df, {"v": [0.5]}, bound=5)["v"][0] == want and calls
    calls.clear()
    monkeypatch.setattr(statistics, "EXACT_ROWS", 10)  # now a table of many rows
    tied = df.withColumn("w", F.floor(F.col("v") / 10_000))
    assert statistics.quantiles(tied, {"v": [0.5], "w": [0.4]}, bound=2_000) == {"v": [want], "w": [np.quantile(np.arange(30_000) * 7919 % 30_011 // 10_000, 0.4)]}
    assert len(calls) <= 1


@pytest.mark.parametrize("query,fits", [("m11", "fit_boosting"), ("m15", "cross_validate")])
def test_boosting_reads_written_features(spark, sf, monkeypatch, query, fits):
    read = []
    monkeypatch.setattr(catalog, "_TABLES", {})
    monkeypatch.setattr(catalog, "feature_table", tables.transactions)
    monkeypatch.setattr(catalog, "fitted", lambda spark, d: SimpleNamespace(feature_names=["amount"]))
    monkeypatch.setattr(boosting, fits, lambda df, *a, **k: read.extend(df.inputFiles()))
    monkeypatch.setattr(boosting, "predict", lambda model, df: df.withColumn("fraud_probability", F.lit(0.5)))
    getattr(catalog, query)(spark, sf)
    assert read and all("/feature-table-" in f for f in read)


class Held:
    def __init__(self):
        self.rows, self.calls = [], []

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows

    def registerTimer(self, at):
        self.calls.append("timer")


def test_a_block_asks_its_state_as_little_as_it_can():
    held, block = Held(), jobs.BlockVelocity(12)
    block.init(held)
    row = Row("sender_account", "block", "kind", "at", "us", "transaction_id", "n", "amount")
    key, hour = ("S", 1), jobs.HOUR

    def given(*rows):
        held.calls = []
        return list(block.handleInputRows(key, iter([row("S", 1, *r) for r in rows]), None))

    assert given((jobs.WHOLE, None, 12 * hour - 1, None, 3, 30.0)) == [] and held.calls == ["append", "timer"]
    assert given((jobs.HOUR_AGO, None, 12 * hour - 5, "h", 1, 5.0), (jobs.DAY_AGO, None, -12 * hour, "d", 1, 7.0)) == []
    out = given((jobs.FRESH, None, 12 * hour, "b", 1, 2.0), (jobs.FRESH, None, 12 * hour, "a", 1, 1.0))
    assert held.calls == ["get", "append"]
    assert [tuple(r) for r in out] == [("S", "a", 1, 4, 37.0, 5.0), ("S", "b", 2, 5, 38.0, 6.0)]


def test_windows_keep_their_state_on_disk(spark, sf, tmp_path, monkeypatch):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = {k: spark.conf.get(k, None) for k in jobs.ON_DISK}
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    monkeypatch.setattr(catalog, "_folders", lambda spark, kind: (f"{tmp_path}/s", f"{tmp_path}/o", f"{tmp_path}/c"))
    try:
        got = {(r["sender_account"], r["window_start"]): r["tx_count"] for r in catalog._counts("24 hours", "1 hour")(spark, sf).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = jobs.flat_counts(jobs.windowed_counts(tables.transactions(spark, sf), "24 hours", "1 hour"))
    whole = {(r["sender_account"], int(r["at"])): r["tx_count"] for r in want.select("*", F.unix_seconds("window_start").alias("at")).collect()}
    assert got and all(whole[k] == n for k, n in got.items())
    files = [p.name for p in (tmp_path / "c" / "state").rglob("*") if p.is_file()]
    assert any(f.endswith(".zip") for f in files) and not any(f.endswith(".delta") for f in files)
