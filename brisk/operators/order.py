"""Running sums, ranks and quantiles over a global order, without a task that sees all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A session in one process
    may go without it, as tests do; any other must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-brisk-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column | str], within: tuple[str, ...] = ()) -> DataFrame:
    """df with sums over all rows up to and including each, in the order, for each key of `within`.

    Rows are dealt over tasks by ranges of the order and stored, since ranges are sampled anew
    whenever they are computed; each range then adds what those before it hold. The order must tell
    all rows apart."""
    value = lambda v: F.col(v) if isinstance(v, str) else v
    rows = stored(df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()))
    keys = ["_part", *within]
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys).agg(*[F.sum(value(v)).alias(f"_{n}") for n, v in sums.items()])
    starts = parts.select(*keys, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, keys)
    return out.withColumns({n: F.sum(value(v)).over(own) + F.col(f"_{n}") for n, v in sums.items()}).drop("_part", *[f"_{n}" for n in sums])


def quantiles(df: DataFrame, columns: list[str], shares: list[float], fill: bool = False) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of several columns, nulls left out; with fill, the
    quantiles after nulls have become the median, and the median as the last of each list.

    Values are counted first, so that equal ones are one row, and ranked by ranges."""
    if not columns:
        return {}
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    nulls = F.count_if(F.col("value").isNull())
    counted = tall.groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranked = running(counted.where("value IS NOT NULL"), ["value"], {"upto": "n"}, ("feature",))
    sizes = {r["feature"]: (r["n"], r["m"]) for r in tall.groupBy("feature").agg(F.count("value").alias("n"), nulls.alias("m")).collect()}

    def at(wanted: dict[tuple[str, int], None]) -> dict[tuple[str, int], float]:
        """Values at places (from 0) of features."""
        spark = df.sparkSession
        places = spark.createDataFrame(sorted(wanted), "feature string, place long")
        met = ranked.join(F.broadcast(places), "feature").where("place < upto and place >= upto - n")
        return {(r["feature"], r["place"]): r["value"] for r in met.select("feature", "place", "value").collect()}

    def between(n: int, q: float) -> tuple[int, int, float]:
        place = q * (n - 1)
        return int(place), min(int(place) + 1, n - 1), place - int(place)

    known = [c for c in columns if sizes.get(c, (0, 0))[0]]
    ends = {(c, i): None for c in known for q in (0.5, *shares) for i in between(sizes[c][0], q)[:2]}
    if not fill:
        found = at(ends)
        mix = lambda c, q: (lambda lo, hi, w: found[c, lo] + w * (found[c, hi] - found[c, lo]))(*between(sizes[c][0], q))
        return {c: [mix(c, q) if c in known else None for q in shares] for c in columns}
    found = at({(c, i): None for c in known for i in between(sizes[c][0], 0.5)[:2]})
    median = {c: (lambda lo, hi, w: found[c, lo] + w * (found[c, hi] - found[c, lo]))(*between(sizes[c][0], 0.5)) for c in known}
    # nulls lie at the median: behind half of the values, before the rest
    half = {c: sizes[c][0] - sizes[c][0] // 2 for c in known}

    def shifted(c: str, place: int) -> int | None:
        n, m = sizes[c]
        return place if place < half[c] else None if place < half[c] + m else place - m

    both = {(c, q): between(sum(sizes[c]), q) for c in known for q in shares}
    found |= at({(c, p): None for (c, q), (lo, hi, _) in both.items() for p in (shifted(c, lo), shifted(c, hi)) if p is not None})
    value = lambda c, i: median[c] if shifted(c, i) is None else found[c, shifted(c, i)]
    out: dict[str, list[float | None]] = {}
    for c in columns:
        if c in known:
            out[c] = [(lambda lo, hi, w: value(c, lo) + w * (value(c, hi) - value(c, lo)))(*both[c, q]) for q in shares] + [median[c]]
        else:
            out[c] = [None] * (len(shares) + 1)
    return out
