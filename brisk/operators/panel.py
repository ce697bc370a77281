"""Dense user-day panels, causal rolling baselines, top-k lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import numeric_features

KEYS = ["user", "day"]


def stack_days(frames: list[DataFrame]) -> DataFrame:
    """Sparse per-day aggregates of several sources as one row a user-day: union, then one sum; a
    column that a source does not have, and a sum of nulls, is 0."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in union.columns if c not in KEYS])


def dense_panel(days: DataFrame) -> DataFrame:
    """Every user on every day between the first and the last day of all; missing numbers are 0.

    The calendar of one user is an array made from two numbers, so users are exploded where they lie
    and only joined with the sparse rows.
    """
    calendar = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    users = days.select("user").distinct().crossJoin(F.broadcast(calendar)).where("lo IS NOT NULL")
    every = users.select("user", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    rest = [c for c in days.columns if c not in KEYS]
    return every.join(days, KEYS, "left").select(*KEYS, *[F.coalesce(c, F.lit(0)).alias(c) if c in numeric_features(days) else F.col(c) for c in rest])


def rolling_baselines(panel: DataFrame, window_days: int, min_history: int, features: list[str] | None = None) -> DataFrame:
    """history_days and, for each feature, the mean, the sample deviation and the z value against the
    `window_days` days before (never the day itself); z is null unless the history is long enough
    and the deviation positive."""
    features = features or numeric_features(panel)
    ordered = Window.partitionBy("user").orderBy("day")
    before = ordered.rowsBetween(-window_days, -1)
    out = panel.withColumns({
        "history_days": F.row_number().over(ordered).cast("long") - 1,
        **{f"baseline_{f}": F.avg(f).over(before) for f in features},
        **{f"baseline_std_{f}": F.stddev_samp(f).over(before) for f in features},
    })
    ready = F.col("history_days") >= min_history
    z = lambda f: F.when(ready & (F.col(f"baseline_std_{f}") > 0), (F.col(f) - F.col(f"baseline_{f}")) / F.col(f"baseline_std_{f}"))
    return out.withColumns({**{f"z_{f}": z(f) for f in features}, "baseline_ready": ready})


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows of a group in each task before it shuffles."""
    if k <= 0:
        raise ValueError("k must be positive")
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def top_days(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k scored days of the highest risk, in order."""
    return scored.where("risk_score IS NOT NULL").orderBy(F.desc("risk_score"), "user", "day").limit(k)


def daily_alerts(scored: DataFrame, k: int) -> DataFrame:
    """The k riskiest users of each day; ties by user."""
    return top_per(scored.where("risk_score IS NOT NULL"), ["day"], [F.desc("risk_score"), F.asc("user")], k)


def user_scores(scored: DataFrame, top_q: int = 3, start=None, end=None) -> DataFrame:
    """max_risk, mean of the top_q days, and scored_days of each user."""
    if top_q <= 0:
        raise ValueError("top_q must be positive")
    rows = scored.where("risk_score IS NOT NULL")
    rows = rows if start is None else rows.where(F.col("day") >= F.lit(start))
    rows = rows if end is None else rows.where(F.col("day") <= F.lit(end))
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("risk_score"), "day"))
    return rows.withColumn("_r", rank).groupBy("user").agg(
        F.max("risk_score").alias("max_risk"), F.avg(F.when(F.col("_r") <= top_q, F.col("risk_score"))).alias("top_q_mean_risk"), F.count("*").alias("scored_days"),
    )


def select_period(df: DataFrame, start, end) -> DataFrame:
    return df.where(F.col("day").between(F.lit(start), F.lit(end)))
