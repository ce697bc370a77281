"""The same operators over streams: daily counters, Page-Hinkley and the chain rule, online.

The stateful ones put the events of a key in order: an event is held back in state until the
watermark has passed it, since until then an older one may come; a timer wakes its key then, whether
or not it has had events since. Keys share their state's calls: a group of the stream is one of BUCKETS
buckets of keys, so a batch costs a call a bucket, not some calls to the state store a key. So the result is that of the batch operators, however events are dealt
over batches, as long as none is more than `late` behind the newest; what is later is dropped by Spark,
which counts it (numRowsDroppedByWatermark). State goes when nothing can come of it any more. The last
events of a stream that ends are given out when a later event, of any key, moves the watermark past them.

Queries that use these need the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.drift import PageHinkley


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def daily_counts(events: DataFrame, time: str = "ts", late: str = "1 day", by: tuple[str, ...] = ("user_id", "event_type")) -> DataFrame:
    """Events a day and key, with a watermark: days that are `late` behind are final."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.to_date("w.start").alias("day"), *by, "n", "total")
    )


#: From what is known of a key and its next events in order: what is known then, up to when that matters
#: (microseconds; None: for ever), and what comes of it.
Step = Callable[[object, list[tuple]], tuple[object, int | None, list[tuple]]]


#: Buckets of keys.
BUCKETS = 1024


class InOrder(StatefulProcessor):
    """Gives `step` the rows of a key in order of `micros` (microseconds) and the other fields, once they are
    behind the watermark, for all keys of a bucket. State: the rows that are not, and what step knows of
    each key, as JSON with its end."""

    def __init__(self, keys: str, fields: str, step: Step, names: list[str]):
        self.keys, self.fields, self.step, self.names = keys, fields, step, names
        self.n = len(keys.split(", "))

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"{self.keys}, micros long, {self.fields}")
        self.known = handle.getListState("known", f"{self.keys}, known string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r[c] for c in self.columns()) for r in rows]
        yield from self._advance(new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues)

    def columns(self) -> list[str]:
        return [f.split()[0] for f in f"{self.keys}, micros long, {self.fields}".split(", ")]

    def _advance(self, new: list[tuple], timerValues) -> Iterator[Row]:
        n, mark = self.n, timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rest = [r for r in held if r[n] > mark]
        late = [r for r in new if r[n] > mark]
        ready: dict[tuple, list[tuple]] = {}
        for r in (*held, *new):
            if r[n] <= mark:
                ready.setdefault(r[:n], []).append(r[n:])
        before = {tuple(r[:n]): tuple(r[n:]) for r in self.known.get()} if self.known.exists() else {}
        known, out = dict(before), []
        for key, rows in ready.items():
            what, until, made = self.step(json.loads(known[key][0]) if key in known else None, sorted(rows))
            known[key] = json.dumps(what), until
            out += [(*key, *r) for r in made]
        waits = {r[:n] for r in (*rest, *late)}
        known = {k: v for k, v in known.items() if k in waits or v[1] is None or v[1] > mark}
        if len(rest) == len(held):
            if late:
                self.waiting.appendList(late)
        elif rest or late:
            self.waiting.put(rest + late)
        else:
            self.waiting.clear()
        if known != before:
            self.known.put([(*k, *v) for k, v in known.items()]) if known else self.known.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [-(-min(r[n] for r in (*rest, *late)) // 1000)] if waits else []
        ends += [-(-v[1] // 1000) for k, v in known.items() if v[1] is not None and k not in waits]
        if ends:
            self.handle.registerTimer(min(ends))
        for r in out:
            yield Row(**dict(zip(self.names, r, strict=True)))


def in_order(events: DataFrame, keys: list[str], time: str, late: str, fields: dict[str, Column], types: dict[str, str], step: Step, out: str) -> DataFrame:
    """Runs `step` over the events of each key in order of time; out: the columns that it makes, after the keys."""
    rows = events.withWatermark(time, late).select(*keys, F.unix_micros(time).alias("micros"), *(c.alias(n) for n, c in fields.items()), F.col(time).alias("moment"))
    types_of_keys = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types_of_keys}, {out}"
    names = [c.strip().split()[0] for c in schema.split(", ")]
    processor = InOrder(types_of_keys, ", ".join(f"{n} {types[n]}" for n in fields), step, names)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithState(processor, schema, "append", "EventTime")


def page_hinkley(series: DataFrame, key: str, time: str, value: str, delta: float = 0.005, threshold: float = 20.0, min_instances: int = 30, late: str = "1 day", forget: str | None = None) -> DataFrame:
    """Detections as they happen. What is known of a series is five numbers; with `forget`, a series
    without values for so long starts anew."""
    idle = None if forget is None else int(pd.Timedelta(forget).value // 1000)

    def step(known: list | None, rows: list[tuple]) -> tuple[list, int | None, list[tuple]]:
        monitor, n, out = PageHinkley(delta, threshold, min_instances), 0, []
        last = None
        if known is not None:
            n, last, *inner = known
            monitor.state = tuple(inner)
        for t, v in rows:
            if idle is not None and last is not None and t - last >= idle:
                monitor, n = PageHinkley(delta, threshold, min_instances), 0
            n, last = n + 1, t
            if monitor.update(v):
                out.append((t, n, v))
        return [n, last, *monitor.state], None if idle is None else last + idle, out

    rows = series.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("series", F.col(key).cast("string"))
    got = in_order(rows, ["series"], time, late, {"v": F.col(value).cast("double")}, {"v": "double"}, step, "t long, observations_at_detection long, value double")
    return got.select("series", F.timestamp_micros("t").alias("drift_time"), "observations_at_detection", "value")


def chains(events: DataFrame, minutes: int = 60, late: str = "1 day") -> DataFrame:
    """The device, file, e-mail chain on normalised events with flags is_connect, is_sensitive and
    is_outside, by user and host. Known of a key are the latest connect and the armed file, for as long
    as they reach."""
    reach = minutes * 60_000_000

    def step(known: list | None, rows: list[tuple]) -> tuple[list, int | None, list[tuple]]:
        usb, arm = known or (None, None)  # (time, id); (time, id, id of the connect)
        out = []
        for t, event, connect, sensitive, outside in rows:
            if connect:
                usb = (t, event)
            elif sensitive and usb and t - usb[0] <= reach:
                arm = (t, event, usb[1])
            elif outside and arm and t - arm[0] <= reach:
                out.append((t, [arm[2], arm[1], event]))
                arm = None
        return [usb, arm], max((x[0] for x in (usb, arm) if x), default=rows[-1][0] - reach) + reach, out

    flags = ("is_connect", "is_sensitive", "is_outside")
    fields = {"event_id": F.col("event_id").cast("string")} | {f: F.coalesce(F.col(f), F.lit(False)) for f in flags}
    got = in_order(events, ["user", "host"], "timestamp", late, fields, {"event_id": "string"} | dict.fromkeys(flags, "boolean"), step, "t long, evidence_event_ids array<string>")
    return got.select("user", "host", F.timestamp_micros("t").alias("alert_timestamp"), "evidence_event_ids")
