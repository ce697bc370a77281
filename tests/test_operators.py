"""Operators on small inputs, against plain Python where a rule is easier said there."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from brisk.functions.columns import arctan_scale, contains_any, external_count, off_hours, recipients
from brisk.models import detectors
from brisk.operators import daily, drift, metrics, panel, rules, scaling, truth
from brisk.operators.asof import asof_backward
from brisk.operators.selection import correlation_filter
from brisk.plans.experiments import expanding_folds
from brisk.sources import alerts, logs

T0 = datetime(2024, 1, 1)


def test_columns(spark):
    df = spark.createDataFrame([("; a@int.com ;B@EXT.com;noat;x@y@int.com", "http://A.B?c/x", datetime(2024, 1, 5, 7)), (None, None, datetime(2024, 1, 6, 12))], "to string, url string, ts timestamp_ntz")
    got = df.select(
        F.size(recipients([F.col("to")])).alias("n"), external_count(recipients([F.col("to")]), ["int.com"]).alias("x"), external_count(recipients([F.col("to")]), []).alias("none"),
        contains_any(F.col("url"), ["a.b?c"]).alias("hit"), contains_any(None, ["a"]).alias("no"), off_hours(F.col("ts"), 7, 18).alias("off"),
    ).collect()
    assert [tuple(r) for r in got] == [(4, 3, 0, True, False, False), (0, 0, 0, False, False, True)]


def test_arctan(spark):
    one = spark.range(1).select(arctan_scale(F.lit(3.0), F.lit(1.0), F.lit(5.0)).alias("a"), arctan_scale(F.lit(3.0), F.lit(2.0), F.lit(2.0)).alias("b")).first()
    assert tuple(one) == (0.5, 0.5)


def test_asof_ties_nulls_tolerance(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 70, 2), ("b", 5, 3), (None, 10, 4)], "k string, m int, id int").withColumn("t", F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins="m"))
    right = spark.createDataFrame([("a", 10, "x", 1), ("a", 10, "y", 2), ("a", 9, "z", 3), ("b", 6, "w", 4), (None, 1, "n", 5)], "k string, m int, v string, tie int").withColumn("s", F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins="m"))
    got = {r["id"]: r["v"] for r in asof_backward(left, right.drop("m"), ["k"], "t", "s", ["v"], F.make_dt_interval(mins=F.lit(59)), tie="tie").collect()}
    assert got == {1: "y", 2: None, 3: None, 4: None}


def test_daily_edges(spark):
    terms = daily.Terms(7, 18, sensitive=("secret",), domains=("int.com",))
    at = lambda m: T0 + timedelta(minutes=m)
    dev = spark.createDataFrame([("u", at(0), "p", "Connect"), ("u", at(60), "p", "Disconnect")], "user string, timestamp timestamp_ntz, pc string, activity string")
    files = spark.createDataFrame([("u", at(m), p, n) for m, p, n in ((0, "p", "secret.txt"), (60, "p", "a"), (-1, "p", "a"), (5, "q", "a"))], "user string, timestamp timestamp_ntz, pc string, filename string").withColumn("day", F.to_date("timestamp"))
    got = daily.usb_file_days(dev, files, terms).collect()
    assert [(r["usb_connected_file_events"], r["usb_connected_sensitive_file_events"]) for r in got] == [(1, 1)]
    mail = spark.createDataFrame([("u", at(60), "q", "x@e.com"), ("u", at(65), "q", "x@e.com"), ("u", at(66), "q", "x@e.com"), ("u", at(20), "q", "x@int.com")], "user string, timestamp timestamp_ntz, pc string, to string").withColumn("day", F.to_date("timestamp"))
    got = daily.email_after_file_days(files, mail, terms).collect()
    assert [(r["external_email_after_file_events"], r["external_email_after_sensitive_file_events"]) for r in got] == [(2, 0)]
    logon = spark.createDataFrame([("u", T0, None, "Logon"), ("u", T0, "a", "Logoff"), ("u", T0 + timedelta(1), "b", "Logon"), ("u", T0 + timedelta(2), "a", "Logon")], "user string, timestamp timestamp_ntz, pc string, activity string").withColumn("day", F.to_date("timestamp"))
    got = {r["day"].day: (r["logon_unique_pcs"], r["logon_new_pc_count"]) for r in daily.logon_days(logon, terms).collect()}
    assert got == {1: (2, 0), 2: (1, 1), 3: (1, 0)}


def test_baselines_are_causal(spark):
    rng = random.Random(3)
    rows = [("u", date(2024, 1, 1) + timedelta(i), rng.randint(0, 9)) for i in range(20)]
    short, full = (panel.rolling_baselines(spark.createDataFrame(rows[:n], "user string, day date, x int"), 5, 3).orderBy("day").collect() for n in (12, 20))
    assert short == full[:12]
    assert full[0]["baseline_x"] is None and full[1]["baseline_std_x"] is None and full[2]["z_x"] is None
    past = [r[2] for r in rows[5:10]]
    assert full[10]["baseline_x"] == pytest.approx(np.mean(past)) and full[10]["baseline_std_x"] == pytest.approx(np.std(past, ddof=1))


def chain_by_hand(events, window):
    out, usb, arm = [], {}, {}
    for e in sorted(events, key=lambda e: (e["timestamp"], e["event_id"])):
        k = (e["user"], e["host"])
        if e["event_type"] == "device" and e["action"] in ("connect", "mount"):
            usb[k] = e
        elif e["event_type"] == "file" and "secret" in e["object"]:
            if k in usb and e["timestamp"] - usb[k]["timestamp"] <= window:
                arm[k] = (usb[k], e)
        elif e["event_type"] == "email" and e["is_external"] and k in arm and e["timestamp"] - arm[k][1]["timestamp"] <= window:
            out.append((arm[k][0]["event_id"], arm[k][1]["event_id"], e["event_id"]))
            del arm[k]
    return sorted(out)


def test_chain_rule_equals_state_machine(spark):
    rng = random.Random(7)
    t, events = T0, []
    for i in range(1500):
        t += timedelta(minutes=rng.choice((0, 1, 20, 59, 60, 61)))
        kind = rng.choice(("device", "file", "email", "email"))
        events.append({"event_id": f"{i:05d}", "user": rng.choice("ab"), "timestamp": t, "event_type": kind, "action": rng.choice(("connect", "disconnect", "mount")) if kind == "device" else "x", "object": rng.choice(("secret", "plain")), "host": rng.choice("pq"), "is_external": rng.random() < 0.6})
    df = spark.createDataFrame([tuple(e.values()) for e in events], "event_id string, user string, timestamp timestamp_ntz, event_type string, action string, object string, host string, is_external boolean")
    got = sorted(tuple(r["evidence_event_ids"]) for r in rules.chain_alerts(rules.normalise(df), "secret", 60).collect())
    want = chain_by_hand(events, timedelta(minutes=60))
    assert want and got == want


def test_word_rules_and_blend(spark):
    texts = [("deleted", "x"), ("rm", "-rf /x"), ("rm", "x"), ("systemctl stop", "y"), ("useradd", "rm z")]
    df = spark.createDataFrame([(str(i), "u", T0, "p", a, o) for i, (a, o) in enumerate(texts)], "event_id string, user string, timestamp timestamp_ntz, event_type string, action string, object string")
    got = sorted((r["evidence_event_ids"][0], r["rule_id"][-1], r["mitre_technique_ids"][0]) for r in rules.word_alerts(rules.normalise(df)).collect())
    assert got == [("2", "3", "T1485"), ("3", "3", "T1489"), ("4", "2", "T1098"), ("4", "3", "T1485")]
    scored = spark.createDataFrame([("u", date(2024, 1, 1), 50.0), ("v", date(2024, 1, 1), 50.0), ("w", date(2024, 1, 1), None)], "user string, day date, risk_score double")
    none = {r["user"]: (r["risk_score"], r["rule_component"]) for r in rules.blend(scored, rules.word_alerts(rules.normalise(df.limit(0)))).collect()}
    assert none == {"u": (50.0, None), "v": (50.0, None), "w": (None, None)}
    some = {r["user"]: r["risk_score"] for r in rules.blend(scored, rules.word_alerts(rules.normalise(df))).collect()}
    assert some == {"u": pytest.approx(55.0), "v": pytest.approx(40.0), "w": None}


def test_drift(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 300), rng.normal(3, 1, 300)])
    df = spark.createDataFrame([("s", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(values)], "k string, t timestamp_ntz, v double")
    fold = [r["observations_at_detection"] for r in drift.page_hinkley(df, "k", "t", "v", threshold=30.0).orderBy("observations_at_detection").collect()]
    monitor, want = drift.PageHinkley(threshold=30.0), []
    for i, v in enumerate(values):
        if monitor.update(v):
            want.append(i + 1)
    assert want and fold == want
    assert [r["observations_at_detection"] for r in drift.detect(df, "k", "t", "v", threshold=30.0).orderBy("drift_time").collect()] == want
    found = [r["observations_at_detection"] for r in drift.detect(df, "k", "t", "v", "adwin").collect()]
    assert found and 300 < min(found) < 400
    with pytest.raises(ValueError):
        drift.threshold(df, "v", 1.0)


def test_metrics_with_ties(spark):
    rng = random.Random(5)
    rows = [(f"u{i}", date(2024, 1, 1), float(rng.randint(0, 5)), int(rng.random() < 0.3)) for i in range(200)]
    df = spark.createDataFrame(rows, "user string, day date, risk_score double, label int")
    got = metrics.auc_and_ap(df).first()
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap = sum(sum(p == s for p in pos) / len(pos) * sum(p >= s for p in pos) / sum(r[2] >= s for r in rows) for s in set(pos))
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)
    with pytest.raises(ValueError):
        metrics.at_k(df, 0, [F.desc("risk_score")])


def test_truth(spark):
    ev = spark.createDataFrame([("u", date(2024, 1, 10)), ("u", date(2024, 1, 11))], "user string, day date")
    assert sorted(r["day"].day for r in truth.day_labels(ev, 2).collect()) == [8, 9]


def test_folds():
    first = date(2024, 1, 1)
    assert expanding_folds(first, first + timedelta(10)) == []
    folds = expanding_folds(first, first + timedelta(29), 10, 5, 5, 5, 1)
    assert [f.fold_id for f in folds] == [1, 2] and folds[-1].test_end <= first + timedelta(29)
    assert all((f.validation_start - f.train_end).days == 2 for f in folds)
    with pytest.raises(ValueError):
        expanding_folds(first, first, 0)


def test_scalers_and_selection(spark):
    df = spark.createDataFrame([(i, float(i), 3.0, float(-2 * i), float((i * 7) % 5)) for i in range(20)], "id int, a double, c double, b double, d double")
    assert scaling.standard_statistics(df, ["c"])["c"] == (3.0, 3.0, 1.0)
    assert scaling.robust_statistics(df, ["a"])["a"] == (9.5, 9.5, 9.5)
    assert set(correlation_filter(df, ["a", "b", "c", "d"], ["id"])) == {"b", "d"}
    assert set(correlation_filter(df, ["a", "b", "c", "d"], ["id"], priority=["a"])) == {"a", "d"}


@pytest.mark.parametrize("family", ["iforest", "lof", "ocsvm", "autoencoder"])
def test_detectors_find_outliers(spark, family):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    x[:8] += 9
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    scores = [detectors.make(family, trees=40).fit(df.where("id >= 8") if family != "iforest" else df, "x", ["id"]).score(df, "x").orderBy(F.desc("anomaly"), "id").limit(8).select("id").collect() for _ in range(2)]
    assert {r["id"] for r in scores[0]} == set(range(8)) and scores[0] == scores[1]
    with pytest.raises(ValueError):
        detectors.make("nothing")


def test_log_sources(spark, tmp_path):
    (tmp_path / "answers/r4.2-1").mkdir(parents=True)
    (tmp_path / "LDAP").mkdir()
    (tmp_path / "logon.csv").write_text("﻿id,date,user,pc,activity\n1,01/04/2010 06:59:59,u,p,Logon\n2,18/09/2010 10:00:00,u,p,Logon\n3,1/4/2010 7:00:00, ,p,Logon\n4,1/9/2010 12:00:00,v,,Logoff\n")
    got = logs.events(spark, str(tmp_path / "logon.csv")).orderBy("timestamp").collect()
    assert [(r["user"], r["hour"], r["weekday"]) for r in got] == [("u", 6, 1), ("v", 12, 6)]
    assert not logs.inspect(spark, str(tmp_path)).usable
    (tmp_path / "LDAP/2010-01.csv").write_text("user_id,email,role,department,team\nu,a@Int.com,r,d,t\n")
    (tmp_path / "LDAP/bad.csv").write_text("user_id,email,role,department,team\nu,a@x.com,r,d,t\n")
    snaps = logs.snapshots(spark, str(tmp_path / "LDAP"))
    assert [r["domain"] for r in logs.domain_table(snaps).collect()] == ["int.com"]
    days = spark.createDataFrame([("u", date(2009, 12, 31)), ("u", date(2010, 1, 1)), ("w", date(2010, 1, 1))], "user string, day date")
    keys = {(r["user"], r["day"].year): r["org_peer_key"] for r in logs.attach_organisation(days, snaps).collect()}
    assert keys == {("u", 2009): "unknown | unknown", ("u", 2010): "r | d", ("w", 2010): "unknown | unknown"}
    (tmp_path / "answers/r4.2-1/a.csv").write_text('logon,{x1},07/01/2010 01:02:03,AAA,"x, y"\nlogon,,2010-07-02 01:02,AAA\nlogon,x,never,AAA\n')
    (tmp_path / "answers/r4.2-1/b.csv").write_text("user,date,type\nBBB,2010-07-03T04:05:06,file\n,2010-07-03,file\n")
    got = sorted((r["user"], r["event_id"], str(r["timestamp"]), r["release"]) for r in logs.answers(spark, str(tmp_path / "answers")).collect())
    assert got == [("AAA", "a.csv:2", "2010-07-02 01:02:00", "r4.2"), ("AAA", "{x1}", "2010-07-01 01:02:03", "r4.2"), ("BBB", "b.csv:2", "2010-07-03 04:05:06", "r4.2")]
    assert sorted(map(tuple, logs.answer_counts(spark, str(tmp_path / "answers")).collect())) == [("a.csv", 3, 1), ("b.csv", 2, 1)]
    (tmp_path / "answers/r4.2-1/c.csv").write_text('file,{x2},07/01/2010 01:02:03,CCC,"two\nlines"\n')
    assert [r["event_id"] for r in logs.answers(spark, str(tmp_path / "answers")).where("user = 'CCC'").collect()] == ["{x2}"]


def test_alert_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n{"id": "1", "rule": {"groups": "Sysmon, x"}, "data": {"win": {"system": {"eventID": "11"}}}}\n\n{"data.user": "flat", "data": {"user": "deep", "srcip": "8.8.8.8:443"}}\n')
    (tmp_path / "b.json").write_text(' [{"id": 3, "data": {"dstip": "10.0.0.1", "ueba": {"action": "DO"}}}]')
    (tmp_path / "c.json").write_text("")
    got = {r["user"] + r["event_id"][:5]: r for r in alerts.normalise(alerts.read_alerts(spark, str(tmp_path / "*.json"))).collect()}
    assert set(got) == {"unknown1", "flatwazuh", "unknown3"}
    assert (got["unknown1"]["event_type"], got["unknown1"]["action"]) == ("file", "file_create")
    assert got["flatwazuh"]["is_external"] and not got["unknown3"]["is_external"] and got["unknown3"]["action"] == "do"
    (tmp_path / "d.json").write_text("5\n")
    with pytest.raises(Exception, match="not a JSON object"):
        alerts.read_alerts(spark, str(tmp_path / "d.json")).collect()


def test_quantiles_and_running_sums(spark):
    from brisk.operators.order import quantiles, running

    rng = random.Random(12)
    a = [rng.choice((None, 0.0, 0.0, rng.random(), float(rng.randint(0, 3)))) for _ in range(301)]
    rows = [(i, x, None, float(i % 7)) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(5)
    shares = [0.05, 0.25, 0.5, 0.77, 0.99]
    known = [x for x in a if x is not None]
    plain, filled = quantiles(df, ["a", "b", "c"], shares), quantiles(df, ["a", "b", "c"], shares, fill=True)
    assert plain["a"] == pytest.approx(np.quantile(known, shares)) and plain["b"] == [None] * 5 and plain["c"] == pytest.approx(np.quantile([r[3] for r in rows], shares))
    whole = [np.median(known) if x is None else x for x in a]
    assert filled["a"] == pytest.approx([*np.quantile(whole, shares), np.median(known)]) and filled["b"] == [None] * 6
    got = {r["id"]: (r["n"], r["s"]) for r in running(df.na.drop(subset=["a"]), [F.desc("a"), "id"], {"n": F.lit(1), "s": "c"}).collect()}
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    assert got == {r[0]: (i + 1, sum(x[3] for x in order[: i + 1])) for i, r in enumerate(order)}
    by = {(r["c"], r["id"]): r["n"] for r in running(df, ["id"], {"n": F.lit(1)}, ("c",)).collect()}
    assert by == {(float(i % 7), i): i // 7 + 1 for i in range(301)}


def test_arms_without_ids_and_dropped_features(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(None, "u", at(0), "device", "connect", "x", False), (None, "u", at(1), "file", "x", "secret", False), (None, "u", at(2), "email", "x", "x", True), (None, "u", at(3), "file", "x", "secret", False), (None, "u", at(4), "email", "x", "x", True)]
    df = spark.createDataFrame(rows, "event_id string, user string, timestamp timestamp_ntz, event_type string, action string, object string, is_external boolean")
    assert [r["alert_timestamp"].minute for r in rules.correlate(df, "secret").collect()] == [2, 4]
    from brisk.operators.selection import correlation_report

    df = spark.createDataFrame([(i, float(i), float(-2 * i), float((i * 7) % 5)) for i in range(20)], "id int, a double, b double, d double")
    kept, dropped = correlation_report(df, ["a", "b", "d"], ["id"])
    assert kept == ["b", "d"] and dropped == [("a", "b", pytest.approx(-1.0))]


def test_alert_files_with_a_blank_head_and_long_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(" \n" * 5000 + '{"id": "1"}\n')
    (tmp_path / "b.json").write_text(" \n" * 5000 + '[{"id": "2"},\n {"id": "3", "data": {"srcip": "[2001:4860:4860::8888]"}}]')
    got = {r["event_id"]: r["is_external"] for r in alerts.normalise(alerts.read_alerts(spark, str(tmp_path / "*.json"))).collect()}
    assert got == {"1": False, "2": False, "3": True}


def test_single_files_and_manifest(spark, tmp_path):
    import hashlib
    import json

    from brisk.sources import files
    from brisk.sources.settings import write_manifest

    path = f"file://{tmp_path}/x.csv"
    for rows in ([(1, "a"), (2, None)], [(3, "b, c")]):
        files.write_csv(spark.createDataFrame(rows, "n int, s string"), path)
    assert (tmp_path / "x.csv").read_text() == 'n,s\n3,"b, c"\n'
    record = files.file_record(spark, path, True)
    assert record["bytes"] == 13 and record["sha256"] == hashlib.sha256((tmp_path / "x.csv").read_bytes()).hexdigest()
    assert not files.file_record(spark, f"{path}.none")["exists"]
    made = [write_manifest(spark, f"file://{tmp_path}/runs", "train", 7, [path], {}) for _ in range(2)]
    assert made[0] != made[1] and json.loads((tmp_path / "runs" / made[1].rsplit("/", 1)[-1] / "manifest.json").read_text())["inputs"][0]["exists"]
