"""Scalers whose statistics come from one aggregate, and nearest centres.

A scale of zero counts as 1: a column that was constant in training still tells values apart later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance
from .order import quantiles


def standard_statistics(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """fill, centre, scale: median for nulls, then mean and population deviation of the filled values."""
    fill = {c: v[0] if v[0] is not None else 0.0 for c, v in quantiles(df, columns, [0.5]).items()}
    full = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c]))) for c in columns}
    row = df.agg(*[F.avg(full[c]).alias(f"m_{c}") for c in columns], *[F.stddev_pop(full[c]).alias(f"s_{c}") for c in columns]).first()
    return {c: (float(fill[c]), row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def robust_statistics(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """fill and centre: the median; scale: the interquartile range of the filled values."""
    out = {}
    for c, (low, middle, high, fill) in quantiles(df, columns, [0.25, 0.5, 0.75], fill=True).items():
        out[c] = (fill or 0.0, middle or 0.0, high - low if low is not None and high > low else 1.0)
    return out


def scaled(statistics: dict[str, tuple[float, float, float]]) -> Column:
    """array<double> of the scaled columns."""
    return F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(fill)) - F.lit(centre)) / F.lit(scale) for c, (fill, centre, scale) in statistics.items()])


def nearest(vector: Column, centres: list[list[float]]) -> Column:
    """struct(d, i): distance to the nearest centre and its number; the first of several."""
    each = [F.struct(distance(vector, F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*each))
