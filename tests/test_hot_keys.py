"""As-of joins and chains of keys that are cut into hours, against the uncut ones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brisk.operators import asof, rules

T0 = datetime(2024, 3, 30, 20)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    at = lambda: T0 + timedelta(minutes=rng.choice([rng.randrange(60 * 60), 60 * rng.randrange(60)]))
    left = spark.createDataFrame([(key(), at(), i) for i in range(1500)], "k string, t timestamp_ntz, id int")
    right = spark.createDataFrame([(key(), at(), f"v{i}", i % 3) for i in range(300)], "k string, s timestamp_ntz, v string, tie int").dropDuplicates(["k", "s", "tie"])
    return left, right


@pytest.mark.parametrize("tolerance", [None, 30])
@pytest.mark.parametrize("hot", [0, 100, 500])
def test_asof_of_hot_keys(spark, sides, hot, tolerance):
    left, right = sides
    reach = None if tolerance is None else F.make_dt_interval(mins=F.lit(tolerance))
    got, want = (sorted(map(tuple, asof.asof_backward(left, right, ["k"], "t", "s", ["v"], reach, "tie", hot=h).select("id", "s", "v").collect()), key=repr) for h in (hot, None))
    assert got == want and len(got) == 1500 and len({x for _, _, x in got}) > 50


def test_asof_of_hot_keys_by_day(spark):
    left = spark.createDataFrame([("a", datetime(2024, 1, d).date()) for d in range(1, 20)], "k string, d date")
    right = spark.createDataFrame([("a", datetime(2024, 1, d).date(), d) for d in (3, 9)], "k string, e date, v int")
    got = {r["d"].day: r["v"] for r in asof.asof_backward(left, right, ["k"], "d", "e", ["v"], hot=2).collect()}
    assert got == {d: 9 if d >= 9 else 3 if d >= 3 else None for d in range(1, 20)}


def test_a_hot_key_is_dealt_over_tasks(spark, sides):
    left, right = sides
    out = asof.asof_backward(left, right.where("false"), ["k"], "t", "s", ["v"], hot=10).where("k = 'hot'")
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    assert asof.hot_keys(left, ["k"], 400).select("k").collect()[0]["k"] == "hot"


@pytest.mark.parametrize("minutes", [10, 45, 150])
@pytest.mark.parametrize("hot", [0, 700])
def test_chains_of_hot_keys(spark, minutes, hot):
    rng = random.Random(minutes)
    rows = [(f"e{i:05}", "hot" if rng.random() < 0.6 else f"u{i % 5}", T0 + timedelta(minutes=rng.randrange(60 * 40)), *rng.choice([("device", "connect", "x", False), ("file", "x", "secret", False), ("email", "x", "x", True), ("other", "x", "x", False)])) for i in range(2000)]
    events = spark.createDataFrame(rows, "event_id string, user string, timestamp timestamp, event_type string, action string, object string, is_external boolean")
    got, want = (sorted(tuple(r["evidence_event_ids"]) for r in rules.chain_alerts(rules.normalise(events), "secret", minutes, ("user",), hot=h).collect()) for h in (hot, None))
    assert got == want and len(got) > 50
