"""Feature selection: ordinal-rank correlation and permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import average_precision
from .order import quantiles, running, stored


def rank_correlations(df: DataFrame, features: list[str], order: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of ordinal ranks; ties in a feature are ranked by `order`.

    Features are unpivoted and ranked by ranges of their values, so that no task holds a feature;
    all pairs then come from one aggregate.
    """
    full = df.select(*order, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    tall = full.unpivot(order, features, "feature", "value")
    ranked = running(tall, ["value", *order], {"rank": F.lit(1)}, ("feature",))
    wide = ranked.groupBy(*order).pivot("feature", features).agg(F.first("rank"))
    pairs = list(combinations(features, 2))
    row = wide.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(each).alias("p")).select("p.*")


def correlation_filter(df: DataFrame, features: list[str], order: list[str], limit: float = 0.9, priority: Iterable[str] = ()) -> list[str]:
    """Features that do not follow one kept before them: those named in `priority` first, then by
    variance. Constant features go."""
    return correlation_report(df, features, order, limit, priority)[0]


def correlation_report(df: DataFrame, features: list[str], order: list[str], limit: float = 0.9, priority: Iterable[str] = ()) -> tuple[list[str], list[tuple[str, str, float]]]:
    """The kept features, and (dropped, kept, correlation) of those that follow one of them."""
    if not 0 < limit <= 1:
        raise ValueError("limit must be in (0, 1]")
    fills = quantiles(df, features, [0.5])
    filled = df.select(*order, *[F.coalesce(F.col(f).cast("double"), F.lit(float(fills[f][0] or 0.0))).alias(f) for f in features])
    spread = filled.agg(*[F.var_pop(f).alias(f) for f in features]).first().asDict()
    alive = [f for f in features if spread[f]]
    first = {f: i for i, f in enumerate(priority)}
    alive.sort(key=lambda f: (first.get(f, len(first)), -spread[f]))
    if len(alive) < 2:
        return alive, []
    r = {frozenset((x["a"], x["b"])): x["r"] for x in rank_correlations(filled, alive, order).collect()}
    kept: list[str] = []
    dropped: list[tuple[str, str, float]] = []
    for f in alive:
        partner = next((k for k in kept if abs(r[frozenset((f, k))] or 0.0) > limit), None)
        if partner is None:
            kept.append(f)
        else:
            dropped.append((f, partner, r[frozenset((f, partner))]))
    return kept, dropped


def permuted_copies(df: DataFrame, features: list[str], key: list[str], repetitions: int, seed: int) -> DataFrame:
    """A copy of df for each feature and repetition (columns `_feature`, `_repetition`), in which the
    feature's values are dealt anew over all rows, and df itself (both null).

    Rows are numbered in the order of their keys, and of each feature and repetition once more in the
    order of a hash; a value goes to the row that has its second number as its first. All are ranked
    at once, by ranges of the hashes. Keys must tell rows apart."""
    rows = stored(running(df, key, {"_place": F.lit(1)}))
    each = F.array(*[F.struct(F.lit(f).alias("_feature"), F.col(f).cast("double").alias("_value")) for f in features])
    tall = rows.select("_place", F.explode(each).alias("x")).select("_place", "x.*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("_repetition"))
    tall = tall.withColumn("_hash", F.xxhash64(F.lit(seed), "_repetition", "_feature", "_place"))
    dealt = running(tall, ["_hash", "_place"], {"_to": F.lit(1)}, ("_feature", "_repetition")).select("_feature", "_repetition", F.col("_to").alias("_place"), "_value")
    value = lambda c: F.when(F.col("_feature") == c, F.col("_value")).otherwise(F.col(c)).alias(c) if c in features else F.col(c)
    copies = rows.join(dealt, "_place").select("_feature", "_repetition", *[value(c) for c in df.columns])
    own = [F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in df.columns]
    return copies.unionByName(rows.select(F.lit(None).cast("string").alias("_feature"), F.lit(None).cast("int").alias("_repetition"), *own))


def permutation_importance(df: DataFrame, features: list[str], key: list[str], score: Callable[[DataFrame], DataFrame], repetitions: int = 5, seed: int = 7, column: str = "risk_score") -> DataFrame:
    """(feature, baseline, mean and deviation of the drop of the average precision) over `repetitions`
    permutations of each feature. `score` gives the rows of df (with `label`) the column that ranks them,
    and keeps the others; all permutations are scored and ranked together."""
    if repetitions <= 0:
        raise ValueError("repetitions must be positive")
    scored = score(permuted_copies(df, features, key, repetitions, seed)).select("_feature", "_repetition", "label", column)
    case = F.struct("_feature", "_repetition").alias("case")
    quality = stored(average_precision(scored.select(case, "label", column), column, ("case",)))
    base = quality.where("case._feature is null").select(F.col("pr_auc").alias("baseline_pr_auc"))
    drop = F.col("baseline_pr_auc") - F.col("pr_auc")
    each = quality.where("case._feature is not null").crossJoin(F.broadcast(base))  # one row
    out = each.groupBy(F.col("case._feature").alias("feature")).agg(F.first("baseline_pr_auc").alias("baseline_pr_auc"), F.avg(drop).alias("mean_pr_auc_drop"), F.stddev_pop(drop).alias("std_pr_auc_drop"))
    return out.orderBy(F.desc("mean_pr_auc_drop"), "feature")


def top_features(importance: DataFrame, least: int = 20, most: int = 30) -> list[str]:
    """Features with a positive drop, at least `least` (by rank) and at most `most`."""
    if not 0 < least <= most:
        raise ValueError("0 < least <= most is needed")
    rows = importance.orderBy(F.desc("mean_pr_auc_drop"), "feature").limit(most).collect()
    good = [r["feature"] for r in rows if r["mean_pr_auc_drop"] > 0]
    return good if len(good) >= least else [r["feature"] for r in rows[:least]]
