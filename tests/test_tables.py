"""Sources, sinks, validation, cleaning, preprocessing and splits."""

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from txrisk.operators import preprocess, quality, registry, splits
from txrisk.operators.preprocess import Preprocessor, PreprocessorModel
from txrisk.schema import EXTENDED_TRANSACTION, REGISTRY, TRANSACTION, component_seed
from txrisk.sources import readers, tables, writers


@pytest.fixture(scope="module")
def labelled(spark):
    """1,000 hourly rows, 100 positives."""
    start = datetime(2023, 1, 1)
    rows = [(f"T{i:06d}", start + timedelta(hours=i), f"A{i % 50:04d}", f"B{i % 40:04d}", 10.0 + i % 90, "payment",
             "retail", "US", "web", int(i % 10 == 3)) for i in range(1000)]
    return spark.createDataFrame(rows, TRANSACTION)


# ----------------------------------------------------------- sources, sinks

def test_csv_with_bad_cells(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "transaction_id,timestamp,sender_account,receiver_account,amount,is_fraud\n"
        "a,2024-01-01 10:00:00.123,S,R,1.5,0\nb,01/02/2024 10:00:00,S,R,oops,1\nc,never,S,R,2,\n")
    rows = {r["transaction_id"]: r for r in readers.read_csv(spark, str(tmp_path / "in.csv")).collect()}
    assert rows["a"]["timestamp"] == datetime(2024, 1, 1, 10, 0, 0, 123000)
    assert rows["b"]["timestamp"] == datetime(2024, 1, 2, 10) and rows["b"]["amount"] is None
    assert rows["c"]["timestamp"] is None and rows["c"]["is_fraud"] is None


def test_csv_without_required_column(spark, tmp_path):
    (tmp_path / "in.csv").write_text("transaction_id,amount\na,1\n")
    with pytest.raises(ValueError, match="missing required columns"):
        readers.read_csv(spark, str(tmp_path / "in.csv"))


def test_json_in_three_shapes(spark, tmp_path):
    one = {"transaction_id": "x", "amount": 5, "sender_account": "S"}
    for i, body in enumerate(([one, one], {"transactions": [one]}, one)):
        (tmp_path / f"{i}.json").write_text(json.dumps(body, indent=1))
    assert readers.read_json(spark, str(tmp_path)).count() == 4
    assert readers.one_transaction(spark, json.dumps(one)).first()["amount"] == "5"


def test_request_defaults(spark):
    raw = readers.one_transaction(spark, '{"sender_account": "", "amount": ""}')
    first, again = (readers.normalise_requests(raw).first() for _ in range(2))
    assert first["transaction_id"] == again["transaction_id"] and first["transaction_id"].startswith("tx_")
    assert (first["sender_account"], first["receiver_account"], first["transaction_type"], first["merchant_category"],
            first["location"], first["device_used"], first["amount"]) == (
        "sender_unknown", "receiver_unknown", "payment", "retail", "unknown", "mobile", 0.0)
    assert first["timestamp"] is not None


def test_first_rows_are_fixed(labelled):
    assert [r[0] for r in readers.first_rows(labelled.repartition(5), 3).select("transaction_id").collect()] == [
        "T000000", "T000001", "T000002"]


def test_load_evaluation_checks_labels(spark, labelled, tmp_path):
    labelled.write.parquet(str(tmp_path / "ok"))
    assert readers.load_evaluation(spark, str(tmp_path / "ok")).count() == 1000
    labelled.withColumn("is_fraud", F.lit(2)).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="only 0 and 1"):
        readers.load_evaluation(spark, str(tmp_path / "bad"))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", float("nan")), ("c", float("inf"))], "transaction_id string, p double")
    writers.write_json(df, str(tmp_path / "j"))
    rows = {r["transaction_id"]: r["p"] for r in spark.read.json(str(tmp_path / "j" / "rows")).collect()}
    assert rows == {"a": 0.5, "b": None, "c": None}
    meta = spark.read.json(str(tmp_path / "j" / "metadata")).first()
    assert meta["count"] == 3 and meta["format_version"] == "1.0"
    writers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    writers.write_report({"scores": df}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "scores" / "json")).count() == 3
    writers.write_evaluation(df.limit(1), {"seed": 42}, str(tmp_path / "e"))
    assert json.loads(spark.read.text(str(tmp_path / "e" / "settings")).first()[0]) == {"seed": 42}
    assert writers.project(df, ["p", "absent", "transaction_id"]).columns == ["p", "transaction_id"]


# ------------------------------------------------------------------ quality

def test_schema_checks(labelled):
    with pytest.raises(ValueError):
        quality.require_columns(labelled, ["nope"])
    with pytest.raises(ValueError):
        quality.bound_rows(labelled, min_rows=1001)
    with pytest.raises(ValueError):
        quality.bound_rows(labelled, 1, 10)
    assert quality.bound_rows(labelled, 1, 1000).count() == labelled.count()
    report = quality.compare_schema(labelled.drop("location").withColumn("amount", F.lit("x")).withColumn("z", F.lit(1)), TRANSACTION)
    assert report == {"valid": False, "missing": ["location"], "extra": ["z"], "mismatched": {"amount": ("double", "string")}}
    assert quality.align_columns(labelled, ["amount", "new"], "mean").first()["new"] == 0.5
    assert quality.completeness(labelled, ["amount", "new"])["missing"] == ["new"]


def test_trim_keeps_null(spark):
    rows = quality.trim_text(spark.createDataFrame([(" a ",), ("  ",), (None,)], "s string")).collect()
    assert [r["s"] for r in rows] == ["a", None, None]


def test_empty_columns_and_rows(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "s string, t string")
    assert quality.drop_empty_columns(df).columns == ["s"] and quality.drop_empty_rows(df).count() == 1


def test_dedupe_keeps_the_earliest_and_is_limited_before_the_shuffle(spark):
    rows = [("same", datetime(2024, 1, 1, 0, i), None, None, float(i), None, None, None, None, 0) for i in range(30)]
    kept = quality.dedupe_by_id(spark.createDataFrame(rows, TRANSACTION).repartition(3))
    assert kept.count() == 1 and kept.first()["amount"] == 0.0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fills_and_clipping(spark):
    df = spark.createDataFrame([(float(i), "x") for i in range(100)] + [(1e6, None), (None, "y")], "v double, s string")
    clean = quality.resolve_quality(df)
    assert clean.filter("v IS NULL OR s IS NULL").count() == 0
    assert set(quality.null_fills(df)) == {"v", "s"} and quality.null_fills(df.na.drop()) == {}
    assert clean.agg(F.max("v")).first()[0] < 1e6
    few = spark.createDataFrame([(float(i % 3),) for i in range(100)] + [(1e6,)], "v double")
    assert quality.outlier_bounds(few) == {}


def test_distinct_limit_is_exact(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"), F.col("id").alias("all"))
    assert quality.varied_columns(df, ["ten", "eleven", "all"]) == ["eleven", "all"]


def test_fingerprint_ignores_order_and_partitions(labelled):
    a = quality.fingerprint(labelled).first()
    assert a == quality.fingerprint(labelled.repartition(7).orderBy(F.rand(2))).first()
    assert a != quality.fingerprint(labelled.withColumn("amount", F.col("amount") + 1)).first()


# ------------------------------------------------------------ preprocessing

def test_timestamp_formats(spark):
    texts = ["2024-01-02T03:04:05.678", "2024-01-02T03:04:05", "2024-01-02 03:04:05.6", "2024-01-02 03:04:05",
             "01/02/2024 03:04:05", "25/01/2024 03:04:05", "junk", None]
    rows = preprocess.parse_times(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert [r["t"] for r in rows] == [
        datetime(2024, 1, 2, 3, 4, 5, 678000), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 600000),
        datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 25, 3, 4, 5), None, None]
    with pytest.raises(ValueError):
        preprocess.require_parsed(spark.createDataFrame([("junk",)], "t string"), "t")


def test_codes_through_both_paths(spark, monkeypatch):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "s string")
    small = sorted(map(tuple, preprocess.code_table(df, "s").collect()))
    monkeypatch.setattr(preprocess, "SMALL_TABLE", 1)
    assert sorted(map(tuple, preprocess.code_table(df, "s").collect())) == small == [("MISSING", 0), ("a", 1), ("b", 2), ("c", 3)]
    new = spark.createDataFrame([("z",), ("a",)], "s string")
    assert sorted(r["s"] for r in preprocess.label_encode(new, "s", preprocess.code_table(df, "s")).collect()) == [-1, 1]


def test_log_amounts_shift_only_when_needed(spark):
    plain = spark.createDataFrame([(10.0,), (1000.0,)], "amount double")
    p = preprocess.amount_params(plain, ["amount"])
    assert p["amount"]["epsilon"] == 0.01 and not p["amount"]["shift"]
    rows = preprocess.log_amounts(plain, p).collect()
    assert rows[0]["amount"] == pytest.approx(math.log1p(10.0)) and rows[0]["amount_original"] == pytest.approx(9.99)
    shifted = spark.createDataFrame([(10.0,), (0.0,), (None,)], "amount double")
    rows = preprocess.log_amounts(shifted, preprocess.amount_params(shifted, ["amount"])).collect()
    assert sorted(r["amount_original"] for r in rows) == pytest.approx([0.0, 5.0, 10.0])


def test_imputation_strategies(spark):
    schema = "a double, b double, c string, d timestamp, e string, f double"
    t = datetime(2024, 1, 1, 0, 0, 0, 5)
    df = spark.createDataFrame(
        [(1.0, 1.0, "x", t, None, None), (3.0, 5.0, "x", t, None, None), (None, None, None, None, None, None),
         (4.0, 0.0, "y", datetime(2025, 1, 1), None, None)], schema)
    params = preprocess.imputation(df, {"b": "mean"})
    row = preprocess.impute(df, params).filter("c = 'x' AND a = 3.0 AND b = 2.0").first()
    assert row["d"] == t and row["e"] == "UNKNOWN" and row["f"] == 0.0
    assert preprocess.impute(df, preprocess.imputation(df, {"a": "drop"})).count() == 3


def test_preprocessor_saves_and_loads(labelled, tmp_path):
    model = Preprocessor(amountCols=["amount"], categoryCols=["location", "device_used"]).fit(labelled)
    model.write().overwrite().save(str(tmp_path / "p"))
    again = PreprocessorModel.load(str(tmp_path / "p"))
    assert sorted(model.transform(labelled).collect()) == sorted(again.transform(labelled).collect())
    unseen = labelled.limit(1).withColumn("location", F.lit("Mars"))
    assert again.transform(unseen).first()["location"] == -1


# ------------------------------------------------------------------- splits

def test_balanced_sample(labelled):
    out = splits.balanced_undersample(labelled, minimum=100)
    assert splits.label_counts(out, "is_fraud") == {0: 100, 1: 100}
    assert out.select("transaction_id").distinct().count() == 200
    again = splits.balanced_undersample(labelled.repartition(6), minimum=100)
    assert sorted(out.collect()) == sorted(again.collect())
    assert sorted(splits.balanced_undersample(labelled, seed=1, minimum=1).collect()) != sorted(out.collect())


def test_balanced_sample_needs_enough_rows(labelled):
    with pytest.raises(ValueError, match="positives"):
        splits.balanced_undersample(labelled)
    with pytest.raises(ValueError, match="negatives"):
        splits.balanced_undersample(labelled.filter("is_fraud = 1 OR amount < 12"), minimum=1)


def test_time_split_puts_the_past_first(labelled):
    train, test = splits.sides(splits.time_split(labelled, 0.2))
    assert (train.count(), test.count()) == (800, 200)
    assert train.agg(F.max("timestamp")).first()[0] < test.agg(F.min("timestamp")).first()[0]
    assert quality.overlap(train, test).first()[0] == 0


@pytest.mark.parametrize("share", [0, 1, -0.5, 1.5])
def test_split_shares_are_checked(labelled, share):
    with pytest.raises(ValueError):
        splits.time_split(labelled, share)
    with pytest.raises(ValueError):
        splits.stratified_split(labelled, share)


def test_stratified_split_keeps_the_rate(labelled):
    split = splits.stratified_split(labelled, 0.25)
    train, test = splits.sides(split)
    assert splits.label_counts(train, "is_fraud") == {0: 675, 1: 75} and test.count() == 250
    assert all(r["has_drift"] == 0 for r in splits.drift_report(split).collect())


def test_folds_partition_the_table(labelled):
    counts = splits.assign_folds(labelled, 7).groupBy("fold", "is_fraud").count().collect()
    assert sum(r["count"] for r in counts) == 1000 and {r["fold"] for r in counts} == set(range(7))
    for y, n in ((0, 900), (1, 100)):
        assert {r["count"] for r in counts if r["is_fraud"] == y} <= {n // 7, n // 7 + 1}


def test_resample_sizes(labelled):
    out = splits.resample(labelled, {0: 150, 1: 250})
    assert splits.label_counts(out, "is_fraud") == {0: 150, 1: 250}


def test_metadata_and_column_order(labelled):
    out = splits.assign_metadata(labelled, [F.col("timestamp"), F.col("transaction_id")])
    row = out.filter("transaction_id = 'T000003'").first()
    assert row["sequence_id"] == "TXN00000003" and row["sequence_time"] == datetime(2024, 1, 1, 0, 6)
    assert row["fraud_type"] == "synthetic_fraud"
    assert splits.canonical_order(labelled).columns == EXTENDED_TRANSACTION.names


# ------------------------------------------------------------------ registry

def test_registry_queries(spark):
    rows = [("m", f"v{i}", datetime(2024, 1, 1 + i), 10 * i, "p") for i in range(1, 6)] + [("n", "v1", datetime(2024, 1, 1), 5, "p")]
    reg = spark.createDataFrame(rows, REGISTRY)
    assert {r["name"]: r["version"] for r in registry.latest(reg).collect()} == {"m": "v5", "n": "v1"}
    assert registry.keep_latest(reg, 2).count() == 3 and registry.superseded(reg, 2).count() == 3
    assert registry.info(reg, "m").first()["version"] == "v5" and registry.info(reg, "m", "v2").first()["size_bytes"] == 20
    assert registry.storage(reg).first()["total_bytes"] == 155


def test_component_seeds_differ():
    assert component_seed("a") != component_seed("b") and component_seed("a") == component_seed("a")
    assert 0 <= component_seed("a", 7) < 2**31 - 1


def test_views_keep_every_row(spark, sf):
    n = tables.table(spark, sf, "events").count()
    assert tables.transactions(spark, sf).count() == tables.scored(spark, sf).count() == n
    assert tables.dirty_transactions(spark, sf).count() > n
    assert tables.orders_as_wide_amounts(spark, sf).count() == tables.table(spark, sf, "lineitem").count()


# ------------------------------------------------------- checks and encodings

def test_type_issues_are_reported(labelled):
    odd = labelled.withColumns({"amount": F.col("amount").cast("string"), "timestamp": F.col("timestamp").cast("string")})
    issues = {r["column"]: r["type_issue"] for r in quality.null_report(odd, ["amount", "timestamp", "location"]).collect()}
    assert issues == {"amount": "amount_not_numeric", "timestamp": "time_not_timestamp", "location": "none"}
    assert {r["type_issue"] for r in quality.null_report(labelled, ["amount", "timestamp"]).collect()} == {"none"}


def test_vectors_for_more_categories_than_columns(spark):
    from pyspark.ml.functions import vector_to_array

    many = spark.range(3_000).select(F.format_string("c%04d", F.col("id") % 1500).alias("c"))
    codes = preprocess.code_table(many, "c")
    extra = many.limit(1).withColumn("c", F.lit("unseen"))
    out = preprocess.one_hot_vector(many.unionByName(extra), "c", codes, "v").select("c", vector_to_array("v").alias("v"))
    rows = out.select("c", F.size("v").alias("width"), F.array_position("v", F.lit(1.0)).alias("at"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("ones"))
    for r in rows.collect():
        assert r["width"] == 1500
        assert (r["ones"], r["at"]) == ((0.0, 0) if r["c"] == "unseen" else (1.0, int(r["c"][1:]) + 1))
    with pytest.raises(ValueError, match="too many for columns"):
        preprocess.categories(many, "c")
