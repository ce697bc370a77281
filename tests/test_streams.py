"""Streams over many batches, with events in any order, against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brisk.operators import drift, rules
from brisk.streaming import activity

T0 = datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Streams batches of rows, one file each in the order given, and gives what came out and the progress of each batch."""
    activity.use_rocksdb(spark)

    def run(schema, batches, online, mode="append"):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03}"))
        import os

        for i in range(len(batches)):
            for name in os.listdir(tmp_path / f"in/{i:03}"):
                os.utime(tmp_path / f"in/{i:03}" / name, (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        got = []
        q = online(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: got.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return got, [p for p in q.recentProgress if p["stateOperators"]]

    return run


def test_days_are_whole_however_files_come(feed):
    rows = [(i % 3, T0 + timedelta(days=i % 20, hours=i % 24), 1.0, "view") for i in range(200)]
    batches = [[r for r in rows if r[1].day == d] for d in range(20, 0, -1)]  # newest first
    got, _ = feed("user_id long, ts timestamp, value double, event_type string", batches, lambda s: activity.daily_counts(s, late="21 days"), "update")
    last = {}
    for n, day, user, kind, k, _ in got:
        last[day, user, kind] = k
    assert sum(last.values()) == 200 and len({d for d, _, _ in last}) == 20


def test_page_hinkley_over_shuffled_batches(spark, feed):
    rng = random.Random(3)
    rows = [(f"s{i % 3}", T0 + timedelta(hours=i), float(i // 40 * 5 + i % 2) if i % 11 else None) for i in range(240)]
    schema = "series string, t timestamp, v double"
    want = sorted((r["series"], r["observations_at_detection"], r["drift_time"]) for r in drift.page_hinkley(spark.createDataFrame(rows, schema), "series", "t", "v", threshold=5.0, min_instances=5).collect())
    # up to 30 hours late
    mixed = [r for _, r in sorted((i + rng.uniform(0, 30), r) for i, r in enumerate(rows))]
    batches = [mixed[i : i + 25] for i in range(0, len(mixed), 25)] + [[("end", T0 + timedelta(hours=240 + 40), 0.0)]]
    got, progress = feed(schema, batches, lambda s: activity.page_hinkley(s, "series", "t", "v", threshold=5.0, min_instances=5, late="31 hours"))
    assert want and sorted((s, n, t) for _, s, t, n, _ in got) == want
    assert len({b for b, *_ in got}) > 2  # detections come while the stream goes on
    assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in progress)


def test_a_series_that_is_forgotten_starts_anew(feed):
    rows = [[("a", T0 + timedelta(hours=h), 100.0 * (h > 5))] for h in [*range(8), 60, 61, 62, 63, 64]] + [[("end", T0 + timedelta(days=20), 0.0)]]
    got, progress = feed("series string, t timestamp, v double", rows, lambda s: activity.page_hinkley(s, "series", "t", "v", threshold=60.0, min_instances=3, late="1 hour", forget="1 day"))
    assert [(s, n) for _, s, _, n, _ in got] == [("a", 7)]  # the values after the pause are all alike
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3  # the end itself


def test_chains_over_shuffled_batches(spark, feed):
    rng = random.Random(8)
    events = []
    for i in range(600):
        kind = rng.choice(["device", "file", "email", "other"])
        events.append((f"e{i:04}", f"u{i % 4}", f"h{rng.randrange(2)}", T0 + timedelta(minutes=i * 3 + rng.randrange(3)), kind))
    schema = "event_id string, user string, host string, timestamp timestamp, kind string"
    flagged = lambda df: df.withColumns({"is_connect": F.col("kind") == "device", "is_sensitive": F.col("kind") == "file", "is_outside": F.col("kind") == "email"})
    raw = spark.createDataFrame(events, schema).select(
        "event_id", "user", "host", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("kind").alias("event_type"), F.when(F.col("kind") == "device", "connect").otherwise("x").alias("action"),
        F.when(F.col("kind") == "file", "secret").otherwise("x").alias("object"), (F.col("kind") == "email").alias("is_external"),
    )
    want = sorted(tuple(r["evidence_event_ids"]) for r in rules.correlate(raw, "secret", 45).where("rule_id = 'UEBA-CORR-001'").collect())
    mixed = [e for _, e in sorted((i + rng.uniform(0, 60), e) for i, e in enumerate(events))]
    batches = [mixed[i : i + 50] for i in range(0, len(mixed), 50)] + [[("end", None, None, T0 + timedelta(days=9), "other")]]
    got, progress = feed(schema, batches, lambda s: activity.chains(flagged(s), 45, late="200 minutes"))
    assert len(want) > 10 and sorted(tuple(r[-1]) for r in got) == want
    assert len({r[0] for r in got}) > 3
    most, end = max(p["stateOperators"][0]["numRowsTotal"] for p in progress), progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert end <= 3 < most  # idle keys have no state


class Calls:
    """A state of one bucket that counts what is asked of it."""

    def __init__(self):
        self.n, self.rows, self.timers = 0, {}, []

    def getListState(self, name, schema):  # noqa: N802
        def asked(work):
            def call(*args):
                self.n += 1
                return work(*args)

            return call

        rows = self.rows.setdefault(name, [])
        put = lambda x: rows.__setitem__(slice(None), x)
        work = {"exists": lambda: bool(rows), "get": lambda: list(rows), "put": put, "appendList": rows.extend, "clear": rows.clear}
        return type("List", (), {k: staticmethod(asked(v)) for k, v in work.items()})

    def listTimers(self):  # noqa: N802
        return self.timers

    def deleteTimer(self, t):  # noqa: N802
        self.n += 1

    def registerTimer(self, t):  # noqa: N802
        self.n += 1
        self.timers = [t]


def test_calls_to_the_state_store_do_not_follow_the_number_of_keys():
    step = lambda known, rows: ((known or 0) + len(rows), None, [(t, (known or 0) + i + 1) for i, (t,) in enumerate(rows)])
    for keys in (1, 500):
        state = Calls()
        # micros is the only field
        processor = activity.InOrder("user string", "at long", lambda known, rows: step(known, [r[:1] for r in rows]), ["user", "t", "n"])
        processor.init(state)
        mark = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": staticmethod(lambda: ms)})
        events = [{"user": f"u{k}", "micros": m, "at": m} for k in range(keys) for m in (3000, 1000, 9000)]
        assert list(processor.handleInputRows((1,), iter(events), mark(0))) == [] and len(state.rows["waiting"]) == 3 * keys
        got = [tuple(r) for r in processor.handleExpiredTimer((1,), mark(5), None)]
        assert sorted(got) == sorted((f"u{k}", t, n) for k in range(keys) for t, n in ((1000, 1), (3000, 2)))
        assert len(state.rows["waiting"]) == keys and state.n < 20
