"""Ground truth: answer events to user-day labels and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_labels(events: DataFrame, early_days: int = 0) -> DataFrame:
    """(user, day, label=1): the event days, or with `early_days` the days before them that are not
    event days themselves."""
    if early_days < 0:
        raise ValueError("early_days must not be negative")
    days = events.select("user", F.col("day").cast("date").alias("day")).where("user IS NOT NULL AND day IS NOT NULL").distinct()
    if early_days:
        before = days.select("user", F.explode(F.sequence(F.date_sub("day", early_days), F.date_sub("day", 1))).alias("day")).distinct()
        days = before.join(days, ["user", "day"], "left_anti")
    return days.withColumn("label", F.lit(1).cast("byte"))


def incidents(events: DataFrame) -> DataFrame:
    """One incident for each (release, source_file, user): first and last time and its events in order
    of time. Numbered within release and file by user."""
    rows = events.groupBy("release", "source_file", "user").agg(
        F.min("timestamp").alias("attack_start"), F.max("timestamp").alias("attack_end"),
        F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "event_id"))), lambda x: x["event_id"]).alias("evidence_event_ids"),
    )
    number = F.row_number().over(Window.partitionBy("release", "source_file").orderBy("user"))
    return rows.withColumn("incident_id", F.concat_ws(":", "release", "source_file", number))
