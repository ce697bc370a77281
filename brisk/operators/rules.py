"""Correlation rules over normalised security events, and their share in the risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require
from .asof import HOT, hot_keys

NEEDED = ("event_id", "user", "timestamp", "event_type", "action", "object")

# Rule ids, techniques, confidences and word patterns.
CHAIN_RULE, ACCOUNT_RULE, DESTROY_RULE = "UEBA-CORR-001", "UEBA-CORR-002", "UEBA-CORR-003"
CHAIN_TECHNIQUES, CHAIN_CONFIDENCE, WORD_CONFIDENCE = ("T1052", "T1567.002"), 0.85, 0.75
ACCOUNT_TECHNIQUE, STOP_TECHNIQUE, DESTROY_TECHNIQUE = "T1098", "T1489", "T1485"
CONNECT_WORDS = r"\b(connect|insert|mount)\b|device_connect"
ACCOUNT_WORDS = r"\b(useradd|usermod|net user|add-user|sudoers|groupadd)\b"
DESTROY_WORDS = r"\b(delete|del |rm |format|wipe|shred|service stop|systemctl stop)\b"
STOP_WORDS = r"service stop|systemctl stop"


def normalise(events: DataFrame) -> DataFrame:
    """Lower-case type, action and object, `_unknown` host, false external flag; no null timestamps."""
    require(events, NEEDED, "events")
    has = lambda c: c in events.columns
    return events.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user").cast("string").alias("user"), F.col("timestamp").try_cast("timestamp_ntz").alias("timestamp"),
        *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("event_type", "action", "object")],
        (F.coalesce(F.col("host").cast("string"), F.lit("_unknown")) if has("host") else F.lit("_unknown")).alias("host"),
        (F.coalesce(F.col("is_external").try_cast("boolean"), F.lit(False)) if has("is_external") else F.lit(False)).alias("is_external"),
    ).where("timestamp IS NOT NULL")


def _text() -> Column:
    return F.lower(F.concat_ws(" ", "action", "object"))


def _alert(rule: Column, techniques: Column, confidence: float, why: Column, ids: list[Column], times: list[Column]) -> list[Column]:
    return [
        rule.alias("rule_id"), "user", "host", F.col("timestamp").alias("alert_timestamp"), techniques.alias("mitre_technique_ids"), F.lit(confidence).alias("confidence"),
        why.alias("rationale"), F.array(*ids).alias("evidence_event_ids"), F.array(*times).alias("evidence_timestamps"),
    ]


def chain_alerts(events: DataFrame, sensitive: str, minutes: int, by: tuple[str, ...] = ("user", "host"), hot: int | None = HOT) -> DataFrame:
    """A device is connected, a sensitive file follows within `minutes`, an external e-mail follows
    that file within `minutes`: one alert for each file that armed the chain.

    Two running values in one window operator: the latest connect, and the latest sensitive file
    that had a connect in reach. Times only grow, so the first e-mail in reach of an armed file is
    the one that fires.

    A chain is over after twice these minutes. So a key with more than `hot` events is cut into spans of
    so many minutes, an hour at least; each is read with the two before it, and gives the alerts of its
    own e-mails.
    """
    part, own, window = list(by), F.lit(True), F.make_dt_interval(mins=F.lit(minutes))
    if hot is not None:
        part, own = [*by, "_span"], F.col("_own")
        second = F.unix_date(F.to_date("timestamp")).cast("long") * 86400 + F.hour("timestamp") * 3600 + F.minute("timestamp") * 60 + F.second("timestamp")
        span = F.floor(second / max(3600, 60 * minutes))
        spans = F.when(F.col("_hot"), F.sequence(span, span + 2)).otherwise(F.array(F.lit(None).cast("long")))
        events = events.join(hot_keys(events, list(by), hot), list(by), "left").withColumn("_span", F.explode(spans))
        events = events.withColumn("_own", F.col("_hot").isNull() | (F.col("_span") == span)).drop("_hot")
    w = Window.partitionBy(*part).orderBy("timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct("timestamp", "event_id")
    usb = F.last(F.when((F.col("event_type") == "device") & _text().rlike(CONNECT_WORDS), here), ignorenulls=True).over(w)
    rows = events.withColumn("_usb", usb)
    arms = (F.col("event_type") == "file") & F.col("object").rlike(f"(?i){sensitive}") & (F.col("timestamp") - F.col("_usb.timestamp") <= window)
    rows = rows.withColumn("_arm", F.last(F.when(arms, F.struct("timestamp", "event_id", F.col("_usb").alias("usb"))), ignorenulls=True).over(w))
    mail = rows.where((F.col("event_type") == "email") & F.col("is_external") & (F.col("timestamp") - F.col("_arm.timestamp") <= window))
    first = Window.partitionBy(*part, "_arm.timestamp", "_arm.event_id").orderBy("timestamp", "event_id")
    fired = mail.withColumn("_n", F.row_number().over(first)).where("_n = 1").where(own)
    techniques = F.array(*[F.lit(t) for t in CHAIN_TECHNIQUES])
    why = F.lit("sensitive file after a connected device, then an external e-mail")
    return fired.select(*_alert(F.lit(CHAIN_RULE), techniques, CHAIN_CONFIDENCE, why, [F.col("_arm.usb.event_id"), F.col("_arm.event_id"), F.col("event_id")], [F.col("_arm.usb.timestamp"), F.col("_arm.timestamp"), F.col("timestamp")]))


def word_alerts(events: DataFrame) -> DataFrame:
    """Account administration and destructive commands, each by its words."""
    account, destroy = _text().rlike(ACCOUNT_WORDS), _text().rlike(DESTROY_WORDS)
    one = lambda rule, technique, why: (F.lit(rule), F.array(technique), WORD_CONFIDENCE, F.lit(why), [F.col("event_id")], [F.col("timestamp")])
    technique = F.when(_text().rlike(STOP_WORDS), STOP_TECHNIQUE).otherwise(DESTROY_TECHNIQUE)
    return (
        events.where(account).select(*_alert(*one(ACCOUNT_RULE, F.lit(ACCOUNT_TECHNIQUE), "account or group was changed")))
        .unionByName(events.where(destroy).select(*_alert(*one(DESTROY_RULE, technique, "data was destroyed or a service stopped"))))
    )


def correlate(events: DataFrame, sensitive: str, minutes: int = 60, hot: int | None = HOT) -> DataFrame:
    """Alerts of all rules, in order of time. An event may fire several."""
    if minutes <= 0:
        raise ValueError("the window must be positive")
    rows = normalise(events)
    alerts = chain_alerts(rows, sensitive, minutes, hot=hot).unionByName(word_alerts(rows))
    return alerts.orderBy("alert_timestamp", "rule_id", "user", "host", "evidence_event_ids")


def rule_days(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("user", F.to_date("alert_timestamp").alias("day")).agg(F.max("confidence").alias("rule_component"), F.array_sort(F.collect_set("rule_id")).alias("correlation_rule_ids"))


def blend(scored: DataFrame, alerts: DataFrame, weight: float = 0.2) -> DataFrame:
    """risk_score with the day's highest rule confidence mixed in. Without any alert the risk stays
    as it is; with one, days without alerts are scaled down too."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must be between 0 and 1")
    require(scored, ("user", "day", "risk_score"), "scored")
    some = alerts.limit(1).agg(F.count("*").alias("_some"))
    rows = scored.join(rule_days(alerts), ["user", "day"], "left").crossJoin(F.broadcast(some))
    part = F.when(F.col("_some") > 0, F.coalesce("rule_component", F.lit(0.0)))
    mixed = F.when(F.col("_some") > 0, 100 * ((1 - weight) * F.col("risk_score") / 100 + weight * part)).otherwise(F.col("risk_score"))
    ids = F.coalesce("correlation_rule_ids", F.array().cast("array<string>"))
    return rows.withColumns({"risk_score": mixed, "rule_component": part, "correlation_rule_ids": ids}).drop("_some")
