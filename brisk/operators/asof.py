"""As-of joins as one union and one window: a single shuffle on the keys, no range join.

A key with more than HOT rows is cut into hours: each hour is a part of its own, and begins with the last
match before it. These come from one row for each hour of such keys, so that no task holds a key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a key that one task orders.
HOT = 1_000_000


def hot_keys(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The keys with more than `most` rows, with `_hot` true. There are few: a table of n rows has at most n / most."""
    return rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*by, F.lit(True).alias("_hot"))


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str],
    tolerance: Column | None = None, tie: str | None = None, hot: int | None = HOT,
) -> DataFrame:
    """left with `values` and `right_time` of the latest row of right at or before it.

    Rows with a null key never match and stay out of the window. Among right rows of the same time the one with the largest
    `tie` is taken. With `tolerance` (an interval) older matches are dropped after the latest row has
    been chosen, so a row that is out of reach hides those before it. With hot=None keys are not counted
    first: for keys that are known to have few rows.
    """
    whole = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by])
    keyless, left, right = left.where(~whole), left.where(whole), right.where(whole)
    keys = [F.col(k) for k in by]
    matched = F.struct(F.col(right_time).alias("_rt"), *[F.col(v).alias(v) for v in values])
    null = F.lit(None).cast(right.select(matched.alias("m")).schema["m"].dataType)
    tie_of = F.col(tie).cast("string") if tie else F.lit(None).cast("string")
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), tie_of.alias("_tie"), matched.alias("_m"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_row"))
    row = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_tie"), null.alias("_m"), row.alias("_row"))
    rows, part = r.unionByName(l), list(by)
    if hot is not None:
        rows, part = rows.join(hot_keys(r.select(*by).union(l.select(*by)), by, hot), by, "left"), [*by, "_hour"]
        rows = rows.withColumn("_hour", F.when(F.col("_hot"), F.struct(F.to_date("_t").alias("d"), F.hour("_t").alias("h")))).drop("_hot")
        hours = rows.where("_hour is not null").groupBy(*part).agg(F.max_by("_m", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_m"))
        before = Window.partitionBy(*by).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
        carried = hours.withColumn("_m", F.last("_m", ignorenulls=True).over(before)).where("_m is not null")
        rows = rows.unionByName(carried.select(*part, F.col("_m._rt").alias("_t"), F.lit(0).alias("_side"), "_m"), allowMissingColumns=True)
    w = Window.partitionBy(*part).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_f", F.last("_m", ignorenulls=True).over(w)).where("_side = 1")
    good = F.col("_f").isNotNull()
    if tolerance is not None:
        good &= (F.col("_t") - F.col("_f._rt")) <= tolerance
    name = right_time if right_time not in left.columns else f"{right_time}_right"
    out = found.select("_row.*", F.when(good, F.col("_f._rt")).alias(name), *[F.when(good, F.col(f"_f.{v}")).alias(v) for v in values])
    return out.union(keyless.select("*", *[F.lit(None).cast(f.dataType) for f in out.schema[len(left.columns) :]]))
