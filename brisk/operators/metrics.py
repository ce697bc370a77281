"""Ranking metrics at the level of user-days, users and incidents, each a one-row DataFrame.

Curves run over ranges of the score; the only window without partitions sees rows that are cut to k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require
from .order import running
from .panel import daily_alerts, user_scores


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_labels(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """scored with `label`, 0 where there is none."""
    require(labels, ("user", "day", "label"), "labels")
    return scored.join(labels.select("user", "day", "label"), ["user", "day"], "left").withColumn("label", F.coalesce(F.col("label").cast("int"), F.lit(0)))


def curve(rows: DataFrame, score: str = "risk_score", within: tuple[str, ...] = ()) -> DataFrame:
    """A row for each distinct score (of each key of `within`): positives and negatives at it, and at it
    or above."""
    by = rows.groupBy(*within, F.col(score).alias("s")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    return running(by, [F.desc("s")], {"tp": "pos", "fp": "neg"}, within)


def _average_precision() -> Column:
    return _ratio(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos")).alias("pr_auc")


def average_precision(rows: DataFrame, score: str = "risk_score", within: tuple[str, ...] = ()) -> DataFrame:
    """Average precision (ties are one step) of each key of `within`."""
    return curve(rows, score, within).groupBy(*within).agg(_average_precision())


def auc_and_ap(rows: DataFrame, score: str = "risk_score") -> DataFrame:
    """ROC-AUC (a tie counts half) and average precision (ties are one step)."""
    c = curve(rows, score)
    p, n = F.sum("pos"), F.sum("neg")
    return c.agg(
        _ratio(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), p * n).alias("roc_auc"), _average_precision(),
        p.alias("positives"), (p + n).alias("observations"),
    )


def at_k(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """alert_k, precision, recall and F1 of the first k rows."""
    if k <= 0:
        raise ValueError("alert_k must be positive")
    top = rows.orderBy(*order).limit(k).agg(F.count("*").alias("alert_k"), F.coalesce(F.sum("label"), F.lit(0)).alias("_hits"))
    out = top.crossJoin(rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("_all")))
    out = out.withColumns({"precision_at_k": _ratio(F.col("_hits"), F.col("alert_k")), "recall_at_k": _ratio(F.col("_hits"), F.col("_all"))})
    both = F.col("precision_at_k") + F.col("recall_at_k")
    return out.withColumn("f1_at_k", _ratio(2 * F.col("precision_at_k") * F.col("recall_at_k"), both)).drop("_hits", "_all")


def evaluate_days(scored: DataFrame, labels: DataFrame, test_start=None, k: int = 10) -> DataFrame:
    """User-day metrics; needs both classes."""
    rows = with_labels(scored.where("risk_score IS NOT NULL"), labels)
    rows = rows if test_start is None else rows.where(F.col("day") >= F.lit(test_start))
    positives = rows.agg(F.count_distinct("label").alias("c"), F.sum("label").alias("p")).first()
    if positives["c"] < 2:
        raise ValueError("evaluation needs both classes")
    order = [F.desc("risk_score"), F.asc("user"), F.asc("day")]
    p = positives["p"]
    names = {"precision_at_k": f"precision_at_{p}_positives", "recall_at_k": f"recall_at_{p}_positives"}
    own = at_k(rows, p, order).withColumnsRenamed(names).select(*names.values())
    out = auc_and_ap(rows).withColumn("prevalence", F.col("positives") / F.col("observations"))
    return out.crossJoin(at_k(rows, k, order)).crossJoin(own)


def ranked_gain(ranked: DataFrame, positives: int, k: int) -> DataFrame:
    """MAP@k and NDCG@k of rows (label, place) with places 1 to k."""
    hits = F.sum("label").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    ideal = sum((1 / F.log2(F.lit(float(i + 2))) for i in range(min(positives, k))), F.lit(0.0))
    rows = ranked.where(F.col("place") <= k).withColumn("hits", hits)
    return rows.agg(
        _ratio(F.sum(F.when(F.col("label") > 0, F.col("hits") / F.col("place")).otherwise(0.0)), F.lit(min(positives, k))).alias("map_at_k"),
        _ratio(F.sum(F.col("label") / F.log2(F.col("place") + 1)), ideal).alias("ndcg_at_k"),
    )


def evaluate_users(scored: DataFrame, incidents: DataFrame, start, end, k: int = 10, top_q: int = 3, score: str = "top_q_mean_risk") -> DataFrame:
    """Metrics of the ranking of users; a user is positive if an incident begins in the period."""
    require(incidents, ("user", "attack_start"), "incidents")
    bad = incidents.where(F.to_date("attack_start").between(F.lit(start), F.lit(end))).select("user").distinct().withColumn("label", F.lit(1))
    users = user_scores(scored, top_q, start, end).join(bad, "user", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    sizes = users.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    if not sizes["n"]:
        raise ValueError("no scored users in the period")
    order = [F.desc(score), F.asc("user")]
    top = users.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    counts = users.agg(F.count("*").alias("scored_users"), F.sum("label").alias("positive_users"), F.avg("label").alias("user_prevalence"))
    return counts.crossJoin(at_k(users, k, order)).crossJoin(ranked_gain(top, sizes["p"], k))


def evaluate_incidents(scored: DataFrame, incidents: DataFrame, k_per_day: int = 10, early_days: int = 0) -> DataFrame:
    """Detection, early warning, lead time and false alerts under a daily budget of alerts.

    One join on the user meets alerts and incidents; all conditions are aggregates over it."""
    require(incidents, ("incident_id", "user", "attack_start", "attack_end"), "incidents")
    alerts = daily_alerts(scored, k_per_day).select("user", "day").distinct()
    spans = incidents.select("incident_id", "user", F.to_date("attack_start").alias("lo"), F.to_date("attack_end").alias("hi"))
    first = F.date_sub("lo", early_days)
    met = alerts.join(spans, "user").where((F.col("day") <= F.col("hi")) & (F.col("day") >= first) | F.col("day").between(F.col("lo"), F.col("hi")))
    during = F.col("day").between(F.col("lo"), F.col("hi"))
    early = (F.col("day") < F.col("lo")) & (F.col("day") >= first) & F.lit(early_days > 0)
    met = met.where(during | early)
    each = met.groupBy("incident_id").agg(F.max(during.cast("int")).alias("seen"), F.min(F.when(early, F.col("day"))).alias("warned"), F.first("lo").alias("lo"))
    found = each.agg(
        F.coalesce(F.sum("seen"), F.lit(0)).alias("detected_incidents"), F.count("warned").alias("early_warned_incidents"), F.median(F.datediff("lo", "warned")).cast("double").alias("median_lead_time_days"),
    )
    matched = met.select("user", "day").distinct()
    false = alerts.join(matched, ["user", "day"], "left_anti").agg(F.count("*").alias("_false"))
    total = spans.agg(F.count("*").alias("incidents")).crossJoin(alerts.agg(F.count("*").alias("_alerts"))).crossJoin(scored.where("risk_score IS NOT NULL").agg(F.count("*").alias("_days")))
    out = total.crossJoin(found).crossJoin(false)
    return out.select(
        "incidents", "detected_incidents", _ratio(F.col("detected_incidents"), F.col("incidents")).alias("incident_detection_rate"), "early_warned_incidents",
        _ratio(F.col("early_warned_incidents"), F.col("incidents")).alias("early_warning_rate"), "median_lead_time_days",
        F.when(F.col("detected_incidents") > 0, F.col("_alerts") / F.col("detected_incidents")).alias("alerts_per_detected_incident"),
        _ratio(100 * F.col("_false"), F.col("_days")).alias("false_alerts_per_100_user_days"),
    )
