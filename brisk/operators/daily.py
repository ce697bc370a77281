"""Activity logs to sparse per-user-day counters.

Every function takes typed events (user, timestamp and what its log has) and returns one row a
user-day; Spark sums partially before the one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import contains_any, external_count, first_present, off_hours, recipients
from .asof import asof_backward

KEYS = ["user", "day"]


@dataclass(frozen=True)
class Terms:
    """Working hours and word lists of a deployment."""

    start_hour: int = 8
    end_hour: int = 18
    watchlist: tuple[str, ...] = ()
    job_search: tuple[str, ...] = ()
    data_leak: tuple[str, ...] = ()
    monitoring: tuple[str, ...] = ()
    sensitive: tuple[str, ...] = ()
    domains: tuple[str, ...] | DataFrame = field(default=())


def _count(c: Column) -> Column:
    return F.count_if(c)


def _off(t: Terms) -> Column:
    return off_hours(F.col("timestamp"), t.start_hour, t.end_hour)


def _optional(df: DataFrame, names: tuple[str, ...]) -> Column | None:
    name = first_present(df, names)
    return F.col(name) if name else None


PC = ("pc", "computer", "host")
ACTIVITY = ("activity", "action", "event")
URL = ("url", "uri", "website")
FILE = ("filename", "file_name", "path")


def logon_days(events: DataFrame, t: Terms) -> DataFrame:
    """Counts, off-hours, distinct hosts (no host counts as one), and hosts never used before by a
    user who had used another one before."""
    pc, act = _optional(events, PC), _optional(events, ACTIVITY)
    pc = pc.cast("string") if pc is not None else F.lit(None).cast("string")
    act = F.lower(act) if act is not None else F.lit("")
    rows = events.select(*KEYS, "timestamp", pc.alias("pc"), act.alias("act"))
    counts = rows.groupBy(*KEYS).agg(
        F.count("*").alias("logon_events"), _count(F.col("act").contains("logon")).alias("logon_count"), _count(F.col("act").contains("logoff")).alias("logoff_count"),
        _count(_off(t)).alias("logon_off_hours_events"), (F.count_distinct("pc") + F.max(F.col("pc").isNull().cast("long"))).alias("logon_unique_pcs"),
    )
    return counts.join(new_hosts(rows), KEYS, "left").withColumn("logon_new_pc_count", F.coalesce("logon_new_pc_count", F.lit(0)))


def new_hosts(rows: DataFrame) -> DataFrame:
    """(user, day, logon_new_pc_count): hosts first seen that day, after the user's first day."""
    first = rows.where("pc IS NOT NULL").groupBy("user", "pc").agg(F.min("day").alias("day"))
    begin = F.min("day").over(Window.partitionBy("user"))
    return first.withColumn("begin", begin).where("day > begin").groupBy(*KEYS).agg(F.count("*").alias("logon_new_pc_count"))


def device_days(events: DataFrame, t: Terms) -> DataFrame:
    """The connect counter matches parts of words, so it counts disconnects as well."""
    act = _optional(events, ACTIVITY)
    act = act if act is not None else F.lit("")
    return events.groupBy(*KEYS).agg(
        F.count("*").alias("device_events"), _count(F.coalesce(act.rlike("(?i)connect|insert|mount"), F.lit(False))).alias("device_connect_count"), _count(_off(t)).alias("device_off_hours_events"),
    )


def http_days(events: DataFrame, t: Terms) -> DataFrame:
    url = _optional(events, URL)
    lists = {"watchlist": t.watchlist, "job_search": t.job_search, "data_leak": t.data_leak, "monitoring_tool": t.monitoring}
    return events.groupBy(*KEYS).agg(
        F.count("*").alias("http_events"), _count(_off(t)).alias("http_off_hours_events"), *[_count(contains_any(url, terms)).alias(f"http_{name}_events") for name, terms in lists.items()],
    )


def email_columns(events: DataFrame, t: Terms) -> DataFrame:
    """events with people (recipients), outside (external ones), files (attachments) and size."""
    people = recipients([F.col(c) for c in ("to", "cc", "bcc") if c in events.columns] or [F.lit("")])
    files, size = _optional(events, ("attachments", "attachment", "attachment_count")), _optional(events, ("size", "bytes", "message_size"))
    number = lambda c, kind: F.coalesce(c.try_cast(kind), F.lit(0).cast(kind)) if c is not None else F.lit(0).cast(kind)
    rows = events.withColumns({"_people": people, "_files": number(files, "bigint"), "_bytes": number(size, "double")}).withColumn("_sent", F.size("_people").cast("long"))
    if isinstance(t.domains, DataFrame):
        return _outside_of_table(rows, t.domains)
    return rows.withColumn("_outside", external_count(F.col("_people"), list(t.domains)))


def _outside_of_table(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """rows with _outside: the recipients whose domain a table of any size (domain, lower-case) does not
    have; 0 if it is empty. Each recipient meets the table on its own, with its row."""
    if domains.isEmpty():
        return rows.withColumn("_outside", F.lit(0).cast("long"))
    each = rows.select(F.monotonically_increasing_id().alias("_id"), F.struct("*").alias("_row")).select("_id", "_row", F.explode_outer("_row._people").alias("_one"))
    each = each.withColumn("_domain", F.regexp_extract(F.lower("_one"), "@(.+)$", 1))
    met = each.join(domains.select(F.col("domain").alias("_domain"), F.lit(True).alias("_in")).distinct(), "_domain", "left")
    outside = F.count_if(F.col("_one").isNotNull() & F.col("_in").isNull())
    return met.groupBy("_id").agg(F.first("_row").alias("_row"), outside.alias("_outside")).select("_row.*", "_outside")


def email_days(events: DataFrame, t: Terms) -> DataFrame:
    return email_columns(events, t).groupBy(*KEYS).agg(
        F.count("*").alias("email_events"), _count(F.col("_files") > 0).alias("email_with_attachment_count"), F.sum("_files").alias("email_attachment_total"), F.sum("_bytes").alias("email_total_bytes"),
        F.sum("_sent").alias("email_recipient_count"), F.sum("_outside").alias("email_external_recipient_count"), _count(F.col("_outside") > 0).alias("email_external_events"), _count(_off(t)).alias("email_off_hours_events"),
    )


def file_days(events: DataFrame, t: Terms) -> DataFrame:
    return events.groupBy(*KEYS).agg(
        F.count("*").alias("file_events"), _count(_off(t)).alias("file_off_hours_events"), _count(contains_any(_optional(events, FILE), t.sensitive)).alias("sensitive_file_events"),
    )


def usb_file_days(devices: DataFrame, files: DataFrame, t: Terms) -> DataFrame:
    """File events while the latest device event of the same user and host was a connect. At the same
    instant a disconnect counts as later."""
    act = F.lower(_optional(devices, ACTIVITY))
    state = devices.where(act.isin("connect", "disconnect")).select("user", _optional(devices, PC).alias("pc"), F.col("timestamp").alias("since"), (act == "connect").cast("int").alias("connected"), F.when(act == "connect", 0).otherwise(1).alias("tie"))
    rows = files.select(*KEYS, "timestamp", _optional(files, PC).alias("pc"), contains_any(_optional(files, FILE), t.sensitive).alias("sensitive"))
    joined = asof_backward(rows, state, ["user", "pc"], "timestamp", "since", ["connected"], tie="tie").where("connected = 1")
    return joined.groupBy(*KEYS).agg(
        F.count("*").alias("usb_connected_file_events"), _count(_off(t)).alias("usb_connected_file_off_hours_events"), _count(F.col("sensitive")).alias("usb_connected_sensitive_file_events"),
    )


def email_after_file_days(files: DataFrame, emails: DataFrame, t: Terms, minutes: int = 60) -> DataFrame:
    """External e-mails at most `minutes` after the latest file event of the same user and host; only
    that one file is looked at."""
    rows = email_columns(emails, t).where("_outside > 0").select(*KEYS, "timestamp", _optional(emails, PC).alias("pc"))
    latest = files.select("user", _optional(files, PC).alias("pc"), F.col("timestamp").alias("touched"), contains_any(_optional(files, FILE), t.sensitive).alias("sensitive"))
    joined = asof_backward(rows, latest, ["user", "pc"], "timestamp", "touched", ["sensitive"], F.make_dt_interval(mins=F.lit(minutes)), tie="sensitive")
    return joined.where("touched IS NOT NULL").groupBy(*KEYS).agg(F.count("*").alias("external_email_after_file_events"), _count(F.col("sensitive")).alias("external_email_after_sensitive_file_events"))
