"""Forest, classifier, end-to-end model, oversampling and streams."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.ml import boosting, forest, oversample
from txrisk.ml.model import RiskModel
from txrisk.operators import features, quality
from txrisk.operators.preprocess import Preprocessor
from txrisk.plans import evaluation
from txrisk.sources import tables
from txrisk.streaming import jobs

SMALL = forest.ForestSettings(hidden=16, trees=20, sample=64)


@pytest.fixture(scope="module")
def tx(spark, sf):
    return tables.transactions(spark, sf)


@pytest.fixture(scope="module")
def model(tx):
    return RiskModel.fit(tx, rounds=5, forest=SMALL)


# ------------------------------------------------------------------- forest

def test_layers_are_reproducible():
    a, b = forest.layer_weights(5, SMALL), forest.layer_weights(5, SMALL)
    assert [w.shape for w, _ in a] == [(5, 16), (16, 16), (16, 16)]
    assert all(np.array_equal(x[0], y[0]) and np.array_equal(x[1], y[1]) for x, y in zip(a, b))


@pytest.mark.parametrize("activation,low,high", [("tanh", -1, 1), ("relu", 0, np.inf), ("sigmoid", 0, 1)])
def test_deep_map_ranges(activation, low, high):
    x = np.random.default_rng(0).normal(size=(50, 5)) * 100
    out = forest.deep_map(x, forest.layer_weights(5, SMALL), activation)
    assert out.shape == (50, 16) and (out >= low).all() and (out <= high).all()


def test_expected_path_lengths():
    assert forest.expected_path(1) == 0 and forest.expected_path(2) == 1
    assert forest.expected_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_trees_sample_exactly(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), F.rand(1).alias("v"))
    few = forest.ForestSettings(trees=4, sample=50)
    assert {r["count"] for r in forest.tree_samples(df, "id", few).groupBy("tree").count().collect()} == {50}
    many = forest.ForestSettings(trees=20, sample=64)
    assert {r["count"] for r in forest.tree_samples(df, "id", many).groupBy("tree").count().collect()} == {64}
    tiny = forest.ForestSettings(trees=3, sample=1000)
    assert {r["count"] for r in forest.tree_samples(df, "id", tiny).groupBy("tree").count().collect()} == {500}


def test_outliers_score_highest(spark):
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(size=(600, 3)), rng.normal(size=(12, 3)) * 0.2 + 9])
    df = spark.createDataFrame([(str(i), *map(float, p)) for i, p in enumerate(points)], "transaction_id string, a double, b double, c double")
    detector = forest.fit_forest(df, ["a", "b", "c"], settings=forest.ForestSettings(trees=50, sample=128))
    scored = detector.transform(df)
    score = {int(r["transaction_id"]): r["anomaly_score"] for r in scored.collect()}
    assert all(0 <= s <= 1 for s in score.values())
    assert np.mean([score[i] for i in range(600, 612)]) > np.mean([score[i] for i in range(600)]) + 0.3
    alone = detector.transform(df.limit(1)).first()
    assert alone["anomaly_score"] == pytest.approx(score[int(alone["transaction_id"])])
    share = forest.permutation_importance(detector, df, rows=100).agg(F.sum("importance"), F.count("*")).first()
    assert share[0] == pytest.approx(1.0) and share[1] == 3


def test_equal_scores_take_the_contamination(spark):
    from txrisk.ml.scaling import normalise_scores

    df = spark.createDataFrame([(1.0,), (1.0,)], "s double")
    assert {r["o"] for r in normalise_scores(df, "s", "o").collect()} == {0.04}


# --------------------------------------------------------------- end to end

def test_scores_are_complete_and_keyed(tx, model):
    out = model.transform(tx)
    assert quality.output_violations(out).first().asDict() == {
        "n_rows": 1000, "bad_probability": 0, "bad_level": 0, "bad_prediction": 0}
    assert out.select("transaction_id").distinct().count() == 1000


def test_scores_do_not_depend_on_order(tx, model):
    a = {r["transaction_id"]: r["fraud_probability"] for r in model.transform(tx).collect()}
    b = {r["transaction_id"]: r["fraud_probability"] for r in model.transform(tx.orderBy(F.rand(3)).repartition(5)).collect()}
    assert a == pytest.approx(b)


def test_model_separates_the_labels(tx, model):
    from txrisk.operators import metrics

    scored = evaluation.scored_by(model, tx)
    assert metrics.areas(metrics.curve(scored)).first()["roc_auc"] > 0.8
    levels = evaluation.evaluate(model, scored).collect()
    assert sum(r["n_rows"] for r in levels) == 1000


def test_saved_model_scores_alike(spark, tx, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    again = RiskModel.load(spark, str(tmp_path / "m"))
    a = {r["transaction_id"]: r["fraud_probability"] for r in model.transform(tx).collect()}
    b = {r["transaction_id"]: r["fraud_probability"] for r in again.transform(tx).collect()}
    assert a == b and again.thresholds == model.thresholds


def test_bad_rows_become_error_rows(spark, tx, model):
    n = F.col("transaction_id").cast("long")
    broken = tx.withColumn("amount", F.when(n % 10 != 0, F.col("amount")))
    rows = model.transform(broken).groupBy("has_error", "error_type").count().collect()
    assert {(r["has_error"], r["error_type"]): r["count"] for r in rows} == {(False, None): 900, (True, "AmountError"): 100}


def test_fit_without_label_raises(tx):
    with pytest.raises(ValueError, match="missing required columns"):
        RiskModel.fit(tx.drop("is_fraud"))


def test_one_transaction(spark, tx, model):
    body = '{"transaction_id":"z","timestamp":"2024-01-31 10:00:00","sender_account":"S1","receiver_account":"R1","amount":12.5}'
    row = model.score_one(spark, body, history=tx).first()
    assert row["transaction_id"] == "z" and not row["has_error"] and 0 <= row["fraud_probability"] <= 1


def test_importance_covers_all_features(tx, model):
    rows = boosting.feature_importance(model.classifier, tx).collect()
    assert len(rows) == len(model.feature_names) + 1 and sum(r["gain"] for r in rows) == pytest.approx(1.0)


# -------------------------------------------------------------- oversampling

def test_synthetic_rows_lie_between_minority_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", float(a), float(b), int(i < 30)) for i, (a, b) in enumerate(rng.random((200, 2)))]
    df = spark.createDataFrame(rows, "transaction_id string, a double, b double, is_fraud int")
    out = oversample.smote(df, ["a", "b"], 170)
    made = np.array([(r["a"], r["b"]) for r in out.collect()])
    base = np.array([r[1:3] for r in rows[:30]])
    assert len(made) == 140
    assert (made >= base.min(0) - 1e-9).all() and (made <= base.max(0) + 1e-9).all()
    # each point lies on a segment between two minority rows
    for m in made[:40]:
        cross = [abs((q[0] - p[0]) * (m[1] - p[1]) - (q[1] - p[1]) * (m[0] - p[0])) for p in base for q in base if (p != q).any()]
        assert min(cross) < 1e-9
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, oversample.smote(df.repartition(5), ["a", "b"], 170).collect()))


def test_oversampling_needs_two_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 0)], "transaction_id string, a double, is_fraud int")
    with pytest.raises(ValueError):
        oversample.smote(df, ["a"], 5)


# ------------------------------------------------------------------- streams

@pytest.fixture(scope="module")
def folder(spark, tx, tmp_path_factory):
    """The table as three files in time order."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    for low, high in ((1, 10), (11, 20), (21, 31)):
        tx.filter(F.dayofmonth("timestamp").between(low, high)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read by modification time
    return path


def by_id(df, names):
    return {r["transaction_id"]: tuple(r[c] for c in names) for r in df.collect()}


def test_micro_batches_equal_the_whole_table(spark, tx, folder, tmp_path):
    stream = jobs.transaction_stream(spark, folder, 1)
    query = jobs.windows_with_history(stream, f"{tmp_path}/s", f"{tmp_path}/o", f"{tmp_path}/c")
    query.awaitTermination()
    names = features.SENDER_FEATURES + features.NOVELTY_FEATURES
    got = by_id(spark.read.parquet(f"{tmp_path}/o"), names)
    want = by_id(features.novelty(features.sender_windows(tx)), names)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_state_per_sender_equals_the_windows(spark, tx, folder, tmp_path):
    done = jobs.run_to_table(jobs.velocity_stream(jobs.transaction_stream(spark, folder, 1)), f"{tmp_path}/o", f"{tmp_path}/c")
    names = ["tx_count_last_1h", "tx_count_last_24h", "total_amount_last_24h", "velocity_1h"]
    got, want = by_id(done, names), by_id(features.sender_windows(tx), names)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_event_time_counts_equal_the_batch(spark, tx, folder, tmp_path):
    stream = jobs.transaction_stream(spark, folder, 1)
    done = jobs.run_to_table(jobs.flat_counts(jobs.windowed_counts(stream, "1 hour")), f"{tmp_path}/o", f"{tmp_path}/c")
    whole = {tuple(r)[:4] for r in jobs.flat_counts(jobs.windowed_counts(tx, "1 hour")).collect()}
    got = {tuple(r)[:4] for r in done.collect()}
    assert got <= whole and len(whole) - len(got) <= 5  # only windows the watermark has not passed


def test_stream_dedup(spark, tx, tmp_path):
    for _ in range(2):
        tx.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.distinct_stream(jobs.transaction_stream(spark, f"{tmp_path}/in"), "60 days")
    assert jobs.run_to_table(stream, f"{tmp_path}/o", f"{tmp_path}/c").count() == 1000


def test_requests_are_scored_from_json(spark, model, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"transaction_id":"a","timestamp":"2024-01-05 10:00:00","sender_account":"S1","receiver_account":"R1","amount":"9.5"}\n'
        '{"transaction_id":"b","timestamp":"2024-01-05 10:00:00","sender_account":"S1","receiver_account":"R1","amount":"much"}\n')
    stream = jobs.request_stream(spark, f"{tmp_path}/in")
    jobs.score_stream(stream, model, f"{tmp_path}/o", f"{tmp_path}/c").awaitTermination()
    rows = {r["transaction_id"]: r for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert not rows["a"]["has_error"] and rows["b"]["error_type"] == "AmountError"


def test_scores_never_read_labels(tx, model):
    """The same scores with labels, without them and with all of them flipped."""

    def scores(df):
        return {r["transaction_id"]: r["fraud_probability"] for r in model.transform(df).collect()}

    known = scores(tx)
    assert known == scores(tx.drop("is_fraud")) == scores(tx.withColumn("is_fraud", 1 - F.col("is_fraud")))


def test_codes_for_many_categories(spark):
    many = spark.range(1500).select(
        F.lit("2024-01-01 00:00:00").alias("timestamp"), F.col("id").cast("double").alias("amount"),
        F.format_string("place%05d", "id").alias("location"),
    )
    prep = Preprocessor("timestamp", ["amount"], ["location"]).fit(many)
    codes = prep.transform(many).agg(F.min("location"), F.max("location"), F.countDistinct("location")).first()
    assert tuple(codes) == (0, 1499, 1500)
    unseen = prep.transform(many.limit(1).withColumn("location", F.lit("elsewhere"))).first()
    assert unseen["location"] == -1
