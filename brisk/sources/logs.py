"""Readers: activity logs, organisation snapshots, answer keys, lab incidents, and data set checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import answer_time, first_present, iso_weekday, log_time, require, strip
from ..operators.asof import asof_backward

LOGS = ("logon", "device", "http", "email", "file")
NEEDED = ("user", "date")
USER, TIME = ("user", "username", "user_id"), ("date", "timestamp", "time")
SNAPSHOT = ("user_id", "email", "role", "department", "team")


def files(spark: SparkSession, path: str, pattern: str = "*.csv", deep: bool = False) -> list[str]:
    """Files below a folder in any store that Spark reads, sorted; none if it does not exist."""
    try:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower()).load(path).select("path")
        return sorted(r["path"] for r in rows.collect())
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings, names without byte order mark and blanks."""
    df = spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


@dataclass(frozen=True)
class Manifest:
    root: str
    columns: dict[str, list[str]]
    snapshots: list[str]
    answers: list[str]

    @property
    def usable(self) -> bool:
        return all(set(NEEDED) <= set(self.columns.get(x, ())) for x in LOGS)

    def report(self) -> str:
        lines = [f"data set {self.root}: {'usable' if self.usable else 'not usable'}"]
        for x in LOGS:
            missing = sorted(set(NEEDED) - set(self.columns.get(x, ())))
            lines.append(f"  {x}.csv: " + ("missing" if x not in self.columns else f"lacks {', '.join(missing)}" if missing else "ok"))
        return "\n".join([*lines, f"  snapshots: {len(self.snapshots)}", f"  answer files: {len(self.answers)}"])


def inspect(spark: SparkSession, root: str) -> Manifest:
    """What a data set holds; reads headers only."""
    here = {p.rsplit("/", 1)[-1]: p for p in files(spark, root)}
    columns = {x: read_csv(spark, here[f"{x}.csv"]).columns for x in LOGS if f"{x}.csv" in here}
    return Manifest(root, columns, files(spark, f"{root}/LDAP"), files(spark, f"{root}/answers", deep=True))


def events(spark: SparkSession, path: str) -> DataFrame:
    """Typed log: user, timestamp, day, hour, weekday and the log's other columns; rows without user
    or readable time are dropped."""
    return typed(read_csv(spark, path))


def typed(raw: DataFrame) -> DataFrame:
    user, time = first_present(raw, USER), first_present(raw, TIME)
    if not user or not time:
        raise ValueError("a log needs a user and a time column")
    rest = [c for c in raw.columns if c not in (user, time)]
    out = raw.select(F.nullif(strip(F.col(user)), F.lit("")).alias("user"), log_time(F.col(time)).alias("timestamp"), *rest).na.drop(subset=["user", "timestamp"])
    return out.withColumns({"day": F.to_date("timestamp"), "hour": F.hour("timestamp"), "weekday": iso_weekday(F.col("timestamp"))})


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, n, c): all records of CSV files without a common layout in one scan: number from 0 and
    cells, as many as the widest record has, null where a record has fewer. Quoted line breaks are read
    as part of a cell; records without any character do not count."""
    read = lambda: spark.read.option("multiLine", True).option("escape", '"')
    width = read().option("singleVariantColumn", "v").csv(paths).agg(F.max(F.size(F.map_keys(F.expr("v::map<string, string>"))))).first()[0] or 1
    raw = read().schema(", ".join(f"c{i} string" for i in range(width))).csv(paths)
    cells = F.array(*[F.regexp_replace(f"c{i}", "\ufeff", "") for i in range(width)])
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("i"), cells.alias("c")).where(F.exists("c", lambda x: F.length(strip(x)) > 0))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("i")) - 1).drop("i")


def headers(rows: DataFrame) -> DataFrame:
    """(file, head): the first record of each file of `records`, lower-case and without blanks around."""
    return rows.where("n = 0").select("file", F.transform("c", lambda x: F.lower(strip(x))).alias("head"))


def place_of(names: tuple[str, ...]) -> Column:
    """The first place in `head` that has one of the names, from 0; null if none has."""
    found = F.filter(F.array(*[F.array_position("head", n) for n in names]), lambda p: p > 0)
    return (F.array_min(found) - 1).cast("int")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(user, snapshot_day, role, department, team, email) from files named YYYY-MM.csv; other names
    and files without all columns are skipped. All files are read in one scan, each by its own header."""
    paths = files(spark, folder)
    if not paths:
        return spark.createDataFrame([], "user string, snapshot_day date, role string, department string, team string, email string")
    rows = records(spark, paths)
    day = F.try_to_date(F.concat(F.regexp_extract("file", r"([0-9]{4}-[0-9]{1,2})\.csv$", 1), F.lit("-1")), "yyyy-M-d")
    places = F.struct(*[place_of((c,)).alias(c) for c in SNAPSHOT])
    heads = headers(rows).select("file", day.alias("snapshot_day"), places.alias("p")).where(F.col("snapshot_day").isNotNull() & F.regexp_like("file", F.lit(r"/[0-9]{4}-[0-9]{1,2}\.csv$")))
    heads = heads.where(" and ".join(f"p.{c} is not null" for c in SNAPSHOT))
    if heads.isEmpty():
        raise ValueError("no snapshot has the needed columns")
    cell = {c: F.get("c", F.col(f"p.{c}")) for c in SNAPSHOT}
    return rows.where("n > 0").join(heads, "file").select(cell["user_id"].alias("user"), "snapshot_day", *[cell[c].alias(c) for c in ("role", "department", "team", "email")])


def domain_table(snaps: DataFrame) -> DataFrame:
    """(domain): all domains of the snapshots' addresses."""
    domain = F.nullif(F.regexp_extract(F.lower(F.col("email")), "@(.+)$", 1), F.lit(""))
    return snaps.select(domain.alias("domain")).where("domain IS NOT NULL").distinct()


def attach_organisation(days: DataFrame, snaps: DataFrame, known: bool = True) -> DataFrame:
    """Role, department and team as of the day, and their key; users not in any snapshot share the
    key `unknown | unknown`. Without snapshots (known=False) all are null."""
    if not known:
        return days.withColumns({c: F.lit(None).cast("string") for c in ("role", "department", "team", "org_peer_key")})
    out = asof_backward(days, snaps, ["user"], "day", "snapshot_day", ["role", "department", "team"], tie="team", hot=None).drop("snapshot_day")
    return out.withColumn("org_peer_key", F.concat_ws(" | ", F.coalesce("role", F.lit("unknown")), F.coalesce("department", F.lit("unknown"))))


def _answer_rows(spark: SparkSession, folder: str, release: str) -> DataFrame:
    """All rows of the answer files whose path names the release; what cannot be read is null.

    A file has a header if its first row names user, username, timestamp, date or time; otherwise its
    columns are event_type, event_id, timestamp, user. Of several columns that could be meant the first
    counts. Both layouts go through one scan.
    """
    paths = [p for p in files(spark, folder, deep=True) if release in p]
    if not paths:
        raise ValueError("no answer file")
    rows = records(spark, paths)
    marks = F.array(*[F.lit(x) for x in ("user", "username", "timestamp", "date", "time")])
    kinds = {"kind": (("event_type", "type", "activity"), 0), "id": (("event_id", "id"), 1), "time": (("timestamp", "date", "time"), 2), "user": (("user", "username", "user_id"), 3)}
    headed = F.arrays_overlap(F.filter("head", lambda x: x.isNotNull()), marks)
    places = F.struct(*[F.when(F.col("headed"), place_of(names)).otherwise(F.lit(place)).alias(k) for k, (names, place) in kinds.items()])
    heads = headers(rows).withColumn("headed", headed).select("file", "headed", places.alias("p"))
    rows = rows.join(heads, "file").where(~(F.col("headed") & (F.col("n") == 0)))
    cell = lambda k: F.nullif(strip(F.get("c", F.col(f"p.{k}"))), F.lit(""))

    name = F.regexp_extract("file", "([^/]+)$", 1)
    out = rows.select(
        F.coalesce(cell("kind"), F.lit("unknown")).alias("event_type"),
        F.coalesce(cell("id"), F.concat_ws(":", name, F.col("n") + 1)).alias("event_id"),
        answer_time(cell("time")).alias("timestamp"), cell("user").alias("user"), name.alias("source_file"),
        F.coalesce(F.nullif(F.regexp_extract("file", r"(r\d\.\d)", 1), F.lit("")), F.lit("unknown")).alias("release"),
    )
    return out.withColumn("day", F.to_date("timestamp"))


def answers(spark: SparkSession, folder: str, release: str = "r4.2") -> DataFrame:
    """Insider events of all answer files whose path names the release, less rows without user or time."""
    return _answer_rows(spark, folder, release).where("user IS NOT NULL AND timestamp IS NOT NULL")


def answer_counts(spark: SparkSession, folder: str, release: str = "r4.2") -> DataFrame:
    """(source_file, rows, bad_rows): rows of each answer file, and how many of them lack user or time."""
    bad = F.count_if(F.col("user").isNull() | F.col("timestamp").isNull())
    return _answer_rows(spark, folder, release).groupBy("source_file").agg(F.count("*").alias("rows"), bad.alias("bad_rows"))


def lab_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incidents from a CSV; all columns are needed and none may end before it begins."""
    raw = read_csv(spark, path)
    names = ("incident_id", "user", "attack_start", "attack_end", "scenario_id", "technique_id")
    require(raw, names, "lab incidents")
    out = raw.select(*[answer_time(F.col(c)).alias(c) if c.startswith("attack") else F.col(c) for c in names])
    if not out.where("attack_end < attack_start").isEmpty():
        raise ValueError("an incident ends before it begins")
    return out


def latest_snapshot(snaps: DataFrame) -> DataFrame:
    """Each user's last snapshot."""
    n = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("snapshot_day"), "team"))
    return snaps.withColumn("_n", n).where("_n = 1").drop("_n")
