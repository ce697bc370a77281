"""Column expressions that the operators share. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layout of log timestamps; one or two digits.
US_TIME = "M/d/yyyy H:mm:ss"
#: Layouts that answer keys use, tried in order before ISO 8601.
ANSWER_TIMES = ("MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm")


def first_present(df: DataFrame, names: Iterable[str]) -> str | None:
    """The first of several column names that df has."""
    return next((n for n in names if n in df.columns), None)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def log_time(c: Column, layout: str = US_TIME) -> Column:
    """A zone-less timestamp, null if it cannot be read."""
    return F.try_to_timestamp(strip(c), F.lit(layout)).cast("timestamp_ntz")


def answer_time(c: Column) -> Column:
    c = strip(c)
    tried = [F.try_to_timestamp(c, F.lit(x)).cast("timestamp_ntz") for x in ANSWER_TIMES]
    return F.coalesce(*tried, c.try_cast("timestamp_ntz"))


def iso_weekday(ts: Column) -> Column:
    """Monday is 1."""
    return F.weekday(ts) + 1


def off_hours(ts: Column, start: int, end: int) -> Column:
    """Before `start`, from `end` on, or on a weekend."""
    return (F.hour(ts) < start) | (F.hour(ts) >= end) | (F.weekday(ts) >= 5)


def contains_any(c: Column | None, terms: Iterable[str]) -> Column:
    """Whether c holds one of the terms, literally, in any case; false for null and for no terms."""
    terms = [t for t in terms if t]
    if c is None or not terms:
        return F.lit(False)
    return F.coalesce(c.rlike("(?iu)" + "|".join(re.escape(t) for t in terms)), F.lit(False))


def recipients(columns: list[Column]) -> Column:
    """Non-blank recipients of the given `;`-separated columns."""
    joined = F.concat_ws(";", *[F.coalesce(c, F.lit("")) for c in columns])
    return F.filter(F.transform(F.split(joined, ";"), strip), lambda x: F.length(x) > 0)


def external_count(people: Column, domains: list[str]) -> Column:
    """Recipients whose domain (all after the first @) is not internal; one without @ is external.
    0 if no internal domains are known."""
    if not domains:
        return F.lit(0).cast("long")
    inside = F.array(*[F.lit(d.lower()) for d in domains])
    return F.size(F.filter(people, lambda x: ~F.array_contains(inside, F.regexp_extract(F.lower(x), "@(.+)$", 1)))).cast("long")


def arctan_scale(value: Column, low: Column, high: Column) -> Column:
    """Squash into (0, 1) around the middle of two quantiles; 0.5 if they do not differ."""
    half = (high - low) / 2
    return F.when(high <= low, F.lit(0.5)).otherwise(F.lit(0.5) + F.atan((value - (low + high) / 2) / half) / F.lit(3.141592653589793))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def top_deviation(names: list[str]) -> Column:
    """struct(name, value) of the largest absolute value among columns; null counts as 0, the first
    of several wins."""
    best = F.struct(F.lit(-1.0).alias("size"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("value"))
    each = F.array(*[F.struct(F.abs(F.coalesce(F.col(n), F.lit(0.0))).alias("size"), F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0.0)).alias("value")) for n in names])
    return F.aggregate(each, best, lambda a, x: F.when(x["size"] > a["size"], x).otherwise(a))


def numeric_features(df: DataFrame, keys: Iterable[str] = ("user", "day"), prefixes: Iterable[str] = ("baseline_", "z_", "peer_")) -> list[str]:
    """Numeric columns that are neither keys nor derived."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys and not f.name.startswith(tuple(prefixes))]


def require(df: DataFrame, names: Iterable[str], what: str) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"{what}: columns missing: {', '.join(missing)}")
