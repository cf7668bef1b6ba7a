"""Kernels against brute force, with every size limit forced low so that each path runs."""

import dataclasses
import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import features
from txrisk.operators.ordered import hash_key, ordered_scan, rank_boundaries
from txrisk.operators.skew import attach, heavy_codes
from txrisk.operators.statistics import modes, quantiles
from txrisk.schema import TRANSACTION

BASE = datetime(2024, 1, 1)


def tied_rows(n=400, seed=0, senders=4):
    """Few senders, one with a third of all rows, many equal times, exact 1 h and 24 h gaps, nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.35
        sender = "S0" if hot else rng.choice([f"S{j}" for j in range(1, senders)] + [None])
        time = None if rng.random() < 0.02 else BASE + timedelta(minutes=rng.choice([0, 15, 30, 45, 60]) + 60 * rng.randrange(60))
        rows.append(
            (f"t{i:04d}", time, sender, rng.choice(["R1", "R2", "R3", None]), float(rng.randrange(1, 500)),
             "pay", "shop", rng.choice([" A", "a", "B", "C", None]), rng.choice(["m", "M ", "w"]), rng.randrange(2))
        )
    return rows


@pytest.fixture(scope="module")
def tied(spark):
    return spark.createDataFrame(tied_rows(), TRANSACTION)


def expected_windows(rows):
    out = {r[0]: (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0) for r in rows}
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups[r[2]].append(r)
    for group in groups.values():
        past = deque()
        for r in sorted(group, key=lambda r: (r[1], r[0])):
            while past and past[0][0] < r[1] - timedelta(hours=24):
                past.popleft()
            day = [a for _, a in past]
            hour = [a for t, a in past if t >= r[1] - timedelta(hours=1)]
            out[r[0]] = (len(hour), len(day), sum(day), sum(day) / len(day) if day else 0.0,
                         max(day, default=0.0), float(sum(hour)), sum(day) / 24)
            past.append((r[1], r[4]))
    return out


def windows(df, **settings):
    names = features.SENDER_FEATURES
    return {r["transaction_id"]: tuple(r[c] for c in names) for r in features.sender_windows(df, **settings).collect()}


@pytest.mark.parametrize("plan", ["frames", "blocks", "narrow blocks", "crowded", "mixed"])
def test_sender_windows_equal_a_deque(tied, many_slabs, plan):
    spread = features.traffic(tied)
    mixed = features.traffic(tied, dense_day=45)
    assert spread.busy == frozenset() and len(mixed.busy) == 1
    settings = {
        "frames": {"plan": "frames"},
        "blocks": {"spread": spread, "plan": "blocks"},
        "narrow blocks": {"spread": dataclasses.replace(spread, busiest_hour=400_000), "plan": "blocks"},
        "crowded": {"spread": dataclasses.replace(spread, busiest_hour=400_000, hot_rows=3), "plan": "blocks"},
        "mixed": {"spread": mixed},
    }[plan]
    got, want = windows(tied, **settings), expected_windows(tied_rows())
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-6), key


def expected_novelty(rows):
    seen = defaultdict(lambda: (defaultdict(int), defaultdict(int)))
    out = {}
    far = datetime.max
    for r in sorted(rows, key=lambda r: (r[1] or far, r[0])):
        if r[2] is None:
            out[r[0]] = (0,) * 6
            continue
        place, device = (("nan" if v is None else v.strip().lower()) for v in (r[7], r[8]))
        places, devices = seen[r[2]]
        places[place] += 1
        devices[device] += 1
        out[r[0]] = (int(places[place] == 1), int(devices[device] == 1), places[place], devices[device],
                     len(places), len(devices))
    return out


@pytest.fixture()
def many_slabs(spark):
    """Keeps range partitions apart, so that even a small group spans several slabs."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def with_hot_senders(tied):
    spread = features.traffic(tied)
    hot = heavy_codes(tied, {"s": ["sender_account"]}, 50)["s"]
    assert hot
    return dataclasses.replace(spread, hot_senders=hot)


@pytest.mark.parametrize("hot", [False, True])
def test_novelty_equals_counters(tied, many_slabs, hot):
    spread = with_hot_senders(tied) if hot else features.traffic(tied)
    rows = features.novelty(tied, spread=spread).collect()
    got = {r["transaction_id"]: tuple(r[c] for c in features.NOVELTY_FEATURES) for r in rows}
    assert got == expected_novelty(tied_rows())


@pytest.mark.parametrize("hot", [False, True])
def test_novelty_continues_from_state(tied, many_slabs, hot):
    spread = with_hot_senders(tied) if hot else None
    cut = BASE + timedelta(hours=30)
    timed = tied.filter("timestamp IS NOT NULL")
    early, late = timed.filter(F.col("timestamp") < cut), timed.filter(F.col("timestamp") >= cut)
    whole = {r["transaction_id"]: r for r in features.novelty(timed).collect()}
    for r in features.novelty(late, spread=spread, seen=features.seen_values(early)).collect():
        for c in features.NOVELTY_FEATURES:
            assert r[c] == whole[r["transaction_id"]][c]


def test_features_do_not_depend_on_order_or_partitions(tied):
    names = ["transaction_id", *features.ENGINEERED]
    one = features.engineer(tied.coalesce(1)).select(names).collect()
    many = features.engineer(tied.orderBy(F.rand(1)).repartition(7)).select(names).collect()
    a, b = sorted(one), sorted(many)
    for x, y in zip(a, b):
        assert list(x)[1:] == pytest.approx(list(y)[1:], abs=1e-6)


@pytest.mark.parametrize("busy", ["some", "all", "hot"])
def test_features_do_not_depend_on_the_plan(tied, many_slabs, busy):
    spread = features.traffic(tied, hot_rows=60, dense_day=45) if busy == "hot" else features.traffic(tied, dense_day=45)
    if busy == "all":
        spread = dataclasses.replace(spread, busy=None)
    if busy == "hot":
        assert spread.hot_senders and spread.hot_receivers
    names = ["transaction_id", *features.ENGINEERED]
    plain = sorted(features.engineer(tied).select(names).collect())
    other = sorted(features.engineer(tied, spread=spread).select(names).collect())
    for x, y in zip(plain, other):
        assert list(x)[1:] == pytest.approx(list(y)[1:], abs=1e-6)
    assert len(plain) == len(other) == 400


def test_history_gives_a_batch_its_past(tied):
    timed = tied.filter("timestamp IS NOT NULL")
    cut = BASE + timedelta(hours=30)
    whole = {r["transaction_id"]: r for r in features.engineer(timed).collect()}
    new = features.engineer(timed.filter(F.col("timestamp") >= cut), history=timed.filter(F.col("timestamp") < cut))
    rows = new.collect()
    assert len(rows) == timed.filter(F.col("timestamp") >= cut).count()
    for r in rows:
        for c in features.SENDER_FEATURES + features.NOVELTY_FEATURES:
            assert r[c] == pytest.approx(whole[r["transaction_id"]][c])


def test_point_in_time_receiver_risk_with_and_without_hot_receivers(tied):
    spread = features.traffic(tied)
    hot = dataclasses.replace(spread, hot_receivers=heavy_codes(tied, {"r": ["receiver_account"]}, 20)["r"])
    timed = tied.filter("timestamp IS NOT NULL")
    names = ["transaction_id", *features.RECEIVER_FEATURES]
    plain = sorted(features.receiver_risk(timed, spread=spread, mode="point_in_time").select(names).collect())
    split = sorted(features.receiver_risk(timed, spread=hot, mode="point_in_time").select(names).collect())
    for a, b in zip(plain, split):
        assert list(a)[1:] == pytest.approx(list(b)[1:], abs=1e-6)
    assert len(plain) == len(split) == timed.count()


# ----------------------------------------------------------- ordered scans

def test_ordered_scan_over_one_hot_group(spark, many_slabs):
    rng = np.random.default_rng(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.integers(5)}", int(i), float(rng.integers(100))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(5)
    out = ordered_scan(df, ["g"], [F.col("i").desc()], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("sum", F.lit(1))})
    want, state = {}, defaultdict(lambda: [0.0, -1.0, 0])
    for g, i, v in sorted(rows, key=lambda r: -r[1]):
        s = state[g]
        s[0], s[1], s[2] = s[0] + v, max(s[1], v), s[2] + 1
        want[i] = tuple(s)
    assert {r["i"]: (r["s"], r["m"], r["n"]) for r in out.collect()} == want


def test_ordered_scan_of_one_group_is_a_rank(spark, many_slabs):
    df = spark.range(5000).withColumn("g", F.lit("one"))
    out = ordered_scan(df, ["g"], [F.col("id")], {"n": ("sum", F.lit(1))})
    assert out.filter("n <> id + 1").count() == 0 and out.count() == 5000


def test_ordered_scan_treats_null_as_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, i int")
    out = ordered_scan(df, ["g"], [F.col("i")], {"n": ("sum", F.lit(1))})
    assert sorted(r["n"] for r in out.collect()) == [1, 1, 2]


@pytest.mark.parametrize("bound,buckets", [(10**6, 1024), (20, 8), (1, 4)])
def test_rank_boundaries_are_exact(spark, bound, buckets):
    rng = random.Random(5)
    rows = [(f"r{i:03d}", rng.choice([7, 7, 7, 7, rng.randrange(-10**12, 10**12)]), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, k long, y int")
    targets = [(y, r) for y in (0, 1) for r in (0, 1, 40, 75, 150, 151)]
    cuts = rank_boundaries(df, F.col("k"), "id", targets, stratum="y", bound=bound, buckets=buckets)
    for (y, rank), cut in cuts.items():
        order = sorted((k, i) for i, k, s in rows if s == y)
        got = {r["id"] for r in df.filter((F.col("y") == y) & cut.covers(F.col("k"), "id")).collect()}
        assert got == {i for _, i in order[: min(rank, 150)]}


def test_hash_key_is_a_fixed_order(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r[0] for r in df.select(hash_key("id", 42)).collect()] == [
        int(__import__("hashlib").md5(f"42:{v}".encode()).hexdigest()[:15], 16) for v in "ab"
    ]


# ------------------------------------------------------- statistics, joins

@pytest.mark.parametrize("bound", [10**6, 50])
def test_quantiles_equal_numpy(spark, bound):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.normal(size=700), np.full(300, 1.5), [1e300, -1e300]])
    b = rng.integers(0, 3, size=len(a)).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    qs = [0.0, 0.04, 0.5, 0.9, 0.99, 1.0]
    got = quantiles(df, {"a": qs, "b": qs, "c": [0.5]}, bound=bound)
    assert got["a"] == pytest.approx(list(np.quantile(a, qs)))
    assert got["b"] == pytest.approx(list(np.quantile(b, qs)))
    assert got["c"] == [None]


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1), ("a", 2), (None, None)], "s string, n int")
    assert modes(df, ["s"]) == {"s": ("a", 2)}
    assert modes(df, ["n"], "double") == {"n": (1.0, 2)}


def test_salted_attach_equals_a_plain_join(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", None if i % 11 == 0 else i) for i in range(500)] + [(None, 1)] * 40
    facts = spark.createDataFrame(rows, "k string, v int")
    stats = facts.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    hot = heavy_codes(facts, {"k": ["k"]}, 30)["k"]
    assert len(hot) >= 2  # the hot key and the null key
    plain = sorted(map(tuple, attach(facts, stats, ["k"]).collect()), key=str)
    salted = sorted(map(tuple, attach(facts, stats, ["k"], hot, 30).collect()), key=str)
    assert plain == salted and len(plain) == len(rows)


def test_empty_tables_have_no_heavy_keys_and_no_features(spark, many_slabs):
    empty = spark.createDataFrame([], TRANSACTION)
    assert heavy_codes(empty, {"k": ["sender_account"]}) == {"k": {}}
    assert features.engineer(empty).count() == 0


def test_no_heavy_key_is_left_out_when_the_list_is_full(spark, monkeypatch):
    from txrisk.operators import skew

    rows = [(f"k{i % 9}",) for i in range(900)] + [(f"rare{i}",) for i in range(50)]
    facts = spark.createDataFrame(rows, "k string")
    monkeypatch.setattr(skew, "TOP_KEYS", 4)
    heavy = skew.heavy_codes(facts, {"k": ["k"]}, hot_rows=60)["k"]
    assert len(heavy) == 9 and set(heavy.values()) == {100}
