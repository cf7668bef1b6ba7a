"""Best prefixes of boosting, facts of a fit, leave-one-out statistics, and the registry's commits."""

import json
import threading

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from txrisk.ml import boosting, forest
from txrisk.ml.model import RiskModel
from txrisk.operators import features, metrics, registry
from txrisk.plans import evaluation
from txrisk.sources import tables

SMALL = forest.ForestSettings(hidden=8, trees=5, sample=32)


@pytest.fixture(scope="module")
def tx(spark, sf):
    return tables.transactions(spark, sf)


@pytest.fixture(scope="module")
def model(tx):
    return RiskModel.fit(tx, rounds=4, forest=SMALL)


def test_prefix_follows_a_loss_that_rises_and_falls_again():
    curve = [5, 4, 3, 3.5, 3.6, 2.9, 3.0, 3.1, 3.2, 3.3, 1.0]
    assert boosting.best_prefix(curve, 3) == (6, True)  # past the rise, but not to the last fall
    assert boosting.best_prefix(curve, 2) == (3, True)
    assert boosting.best_prefix(curve, 100) == (11, False)
    assert boosting.best_prefix([2, 2, 2, 2], 3) == (1, True) and boosting.best_prefix([3, 2], 5) == (2, False)


@pytest.fixture(scope="module")
def noisy(spark):
    """A rule with much noise: boosting learns it and then the noise."""
    pick = lambda s: F.rand(s)
    df = spark.range(1200).select(F.col("id"), pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("e"), (pick(4) < 0.4).alias("held"))
    return df.withColumn("is_fraud", ((F.col("a") > 0.5).cast("double") * 0.5 + 0.25 > F.col("e")).cast("int")).cache()


def test_boosting_keeps_the_best_prefix(noisy):
    run = boosting.boost(noisy, ["a", "b"], validation="held", rounds=40, patience=8)
    kept = run.model.stages[-1]
    assert run.best_round == kept.getNumTrees == run.curve.index(min(run.curve[: run.best_round + 8])) + 1
    assert run.best_round < len(run.curve)
    # the same trees as a fit that ends there
    data = boosting._assemble(["a", "b"]).transform(boosting.with_weight(noisy, run.ratio)).filter("not held")
    again = GBTClassifier(featuresCol="_features", labelCol="is_fraud", weightCol="weight", maxIter=run.best_round, seed=boosting.SEED, **boosting.BOOSTING).fit(data)
    assert kept.toDebugString.splitlines()[1:] == again.toDebugString.splitlines()[1:]


def test_facts_of_the_fit(tx, model):
    f = model.training
    assert f["n_train_samples"] + f["n_val_samples"] == 1000 and f["n_features"] == len(model.feature_names)
    assert 1 <= f["best_iteration"] <= f["rounds_looked_at"] == 4 and f["scale_pos_weight"] == pytest.approx(964 / 36)
    assert f["train_auc"] > 0.8 and 0 <= f["val_f1"] <= 1
    assert model.check(tx)["valid"] and model.check(tx.drop("is_fraud"))["valid"]
    assert model.check(tx.withColumn("amount", F.col("amount").cast("string")))["mismatched"] == {"amount": ("double", "string")}
    with pytest.raises(ValueError, match="missing required"):
        model.transform(tx.drop("amount"))


def test_infinite_amounts_and_holes_are_scored(tx, model):
    odd = tx.withColumn("amount", F.when(F.col("transaction_id") == "7", F.lit(float("inf"))).otherwise(F.col("amount")))
    assert model.features(odd).filter(F.abs("amount") == float("inf")).count() == 0


def test_statistics_of_a_fitted_row_leave_it_out(spark, tx, model):
    """The receiver features of a row that was in the fit are those that the other rows alone give."""
    names = features.RECEIVER_FEATURES
    got = {r["transaction_id"]: [r[c] for c in names] for r in model.features(tx).select("transaction_id", *names).collect()}
    clean = model.prepared(tx)
    for i in ("3", "500", "999"):
        others = features.receiver_stats(clean.filter(F.col("transaction_id") != i))
        row = clean.filter(F.col("transaction_id") == i).drop("is_fraud")
        want = features.receiver_risk(row, stats=others).select(*names).first()
        exact = dict(zip(names, got[i]))
        for c in names:
            if c == "receiver_risk_score":  # scaled by the busiest receiver of the fit
                continue
            assert exact[c] == pytest.approx(want[c], abs=1e-5), c


def test_flipping_a_label_does_not_move_the_features(tx, model):
    flipped = tx.withColumn("is_fraud", 1 - F.col("is_fraud"))
    cols = model.cols
    other = RiskModel(model.prep, model.bounds, model.feature_names, model.forest, model.classifier, model.thresholds,
                      features.receiver_stats(model.prepared(tx.withColumn("is_fraud", F.when(F.col("transaction_id") == "500", 1 - F.col("is_fraud")).otherwise(F.col("is_fraud"))))),
                      cols=cols, own=features.contributions(model.prepared(tx.withColumn("is_fraud", F.when(F.col("transaction_id") == "500", 1 - F.col("is_fraud")).otherwise(F.col("is_fraud"))))),
                      fills=model.fills, ends=model.ends, schema=model.schema)
    one = tx.filter("transaction_id = '500'")
    a, b = (m.transform(one, history=tx.filter("transaction_id <> '500'")).first() for m in (model, other))
    assert a["fraud_probability"] == b["fraud_probability"]
    c = model.transform(flipped.filter("transaction_id = '500'"), history=tx.filter("transaction_id <> '500'")).first()
    assert a["fraud_probability"] == c["fraud_probability"]


def test_time_split_finds_positives(spark):
    """E9 by its default must rank future positives above chance by far."""
    big = tables.transactions(spark, "/root/testdata/sf0.01")
    model, scored = evaluation.time_split_evaluation(big, rounds=20, forest=SMALL)
    assert metrics.areas(metrics.curve(scored)).first()["roc_auc"] > 0.8


def test_published_versions_are_whole_and_numbered(spark, tx, model, tmp_path):
    root = f"{tmp_path}/registry"
    assert registry.registry_table(spark, root).count() == 0
    first = model.publish(spark, root)
    second = model.publish(spark, root)
    assert (first["version"], second["version"]) == ("v1", "v2") and first["size_bytes"] > 1000
    rows = registry.registry_table(spark, root)
    newest = registry.latest(rows).first()
    assert newest["version"] == "v2" and json.loads(newest["statistics"])["n_features"] == len(model.feature_names)
    again = RiskModel.load(spark, newest["path"])
    assert again.training == model.training and again.schema == model.schema
    score = lambda m: {r["transaction_id"]: r["fraud_probability"] for r in m.transform(tx.limit(50)).collect()}
    assert score(again) == score(model)


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    root, got = f"{tmp_path}/registry", []

    def write(k):
        def save(path):
            spark.range(k + 1).write.parquet(path)

        got.append(registry.publish(spark, root, "m", save)["version"])

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [f"v{k}" for k in range(1, 7)]
    assert registry.list_versions(registry.registry_table(spark, root)).first()["n_versions"] == 6


def test_put_if_absent_takes_the_first(spark, tmp_path):
    assert registry.put_if_absent(spark, f"{tmp_path}/v/1.json", "{}")
    assert not registry.put_if_absent(spark, f"{tmp_path}/v/1.json", "other")
    assert (tmp_path / "v" / "1.json").read_text() == "{}" and not list((tmp_path / "v").glob("*.tmp"))
