"""Fit peers and a detector on training days; score all days.

Training rows are written to the shared folder once; statistics come from aggregates over them, and
only centres, quantiles and the detector's model reach the driver.
Scoring is one narrow pass: small lookups are joined (Spark broadcasts them if their size allows) and
one Arrow function computes the anomaly.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import arctan_scale, distance, numeric_features, top_deviation
from ..operators.order import quantiles, stored
from ..operators.scaling import nearest, robust_statistics, scaled, standard_statistics
from . import detectors

KEY = ["user", "day"]


@dataclass
class RiskModel:
    raw: list[str]
    features: list[str]
    peer_scale: dict
    robust_scale: dict
    centres: list[list[float]]
    clusters: DataFrame  # user, cluster
    groups: DataFrame  # org_peer_key, centre
    detector: object
    bounds: dict
    weights: tuple[float, float]
    settings: dict = field(default_factory=dict)


def _peer_distance(rows: DataFrame, model: RiskModel) -> DataFrame:
    """peer_distance and peer_source: to the centre of the organisation group if it has one, else to
    the user's cluster, else (unknown user) to the nearest cluster."""
    vector = scaled(model.peer_scale)
    rows = rows.withColumn("_v", vector).join(model.clusters, "user", "left")
    rows = rows.join(model.groups, "org_peer_key", "left") if "org_peer_key" in rows.columns else rows.withColumn("_centre", F.lit(None).cast("array<double>"))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.centres])
    own = F.when(F.col("_cluster").isNotNull(), distance(F.col("_v"), F.get(centres, F.col("_cluster")))).otherwise(nearest(F.col("_v"), model.centres)["d"])
    by_group = F.col("_centre").isNotNull()
    return rows.withColumns({
        "peer_distance": F.when(by_group, distance(F.col("_v"), F.col("_centre"))).otherwise(own),
        "peer_source": F.when(by_group, "ldap_role_department").otherwise("behavioral_cluster"),
    }).drop("_v", "_cluster", "_centre")


@dataclass
class Ground:
    """What models of all families have in common: training rows, scales, peers."""

    train: DataFrame
    raw: list[str]
    known: list[str]  # features with values
    peer_scale: dict
    robust_scale: dict
    centres: list[list[float]]
    clusters: DataFrame
    groups: DataFrame


def ground(features: DataFrame, train_end, *, clusters: int = 8, seed: int = 7, min_rows: int = 100, min_group: int = 5) -> Ground:
    """Scales and peers of the days up to train_end whose baseline is ready."""
    raw = [c for c in numeric_features(features) if c != "history_days" or "history_days" in features.columns]
    candidates = [*raw, *[c for c in features.columns if c.startswith("z_")]]
    train = stored(features.where((F.col("day") <= F.lit(train_end)) & F.col("baseline_ready")))
    row = train.agg(F.count("*").alias("n"), F.count_distinct("user").alias("u"), *[F.count(c).alias(f"c_{c}") for c in candidates]).first()
    if row["n"] < min_rows:
        raise ValueError(f"{row['n']} training days; {min_rows} are needed")
    if row["u"] < 2:
        raise ValueError("two users are needed")
    known = [c for c in candidates if row[f"c_{c}"]]

    profiles = stored(train.groupBy("user").agg(*[F.avg(c).alias(c) for c in raw]))
    peer_scale = standard_statistics(profiles, raw)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = profiles.select("user", array_to_vector(scaled(peer_scale)).alias("features"))
    kmeans = KMeans(k=max(2, min(clusters, row["u"])), seed=seed, maxIter=50).fit(points)
    members = stored(kmeans.transform(points).select("user", F.col("prediction").alias("_cluster")))
    groups = features.sparkSession.createDataFrame([], "org_peer_key string, _centre array<double>")
    if "org_peer_key" in features.columns:
        big = train.groupBy("org_peer_key").agg(F.count_distinct("user").alias("_u"), *[F.avg(c).alias(c) for c in raw]).where(F.col("_u") >= min_group)
        groups = stored(big.select("org_peer_key", scaled(peer_scale).alias("_centre")))
    return Ground(train, raw, known, peer_scale, robust_statistics(train, known), [list(map(float, c)) for c in kmeans.clusterCenters()], members, groups)


def fit(
    features: DataFrame, train_end, *, family: str = "isolation_forest", clusters: int = 8, anomaly_weight: float = 0.7, peer_weight: float = 0.3, seed: int = 7, trees: int = 100, neighbours: int = 35,
    nu: float = 0.01, selected: list[str] | None = None, min_rows: int = 100, min_group: int = 5, on: Ground | None = None,
) -> RiskModel:
    """Fit on days up to train_end whose baseline is ready, or `on` what other models of these days have
    made of them."""
    if anomaly_weight < 0 or peer_weight < 0 or anomaly_weight + peer_weight <= 0:
        raise ValueError("weights must not be negative, and one positive")
    on = on or ground(features, train_end, clusters=clusters, seed=seed, min_rows=min_rows, min_group=min_group)
    if selected is not None and (missing := sorted(set(selected) - set(on.known))):
        raise ValueError(f"selected features are not available: {missing}")
    used = list(selected) if selected is not None else on.known
    robust = {c: on.robust_scale[c] for c in used}
    detector = detectors.make(family, seed, trees, neighbours, nu)
    vectors = on.train.withColumn("_x", scaled(robust))
    detector.fit(vectors, "_x", KEY)
    total = anomaly_weight + peer_weight
    model = RiskModel(on.raw, used, on.peer_scale, robust, on.centres, on.clusters, on.groups, detector, {}, (anomaly_weight / total, peer_weight / total), {"family": family, "seed": seed})
    seen = stored(_peer_distance(detector.score(vectors, "_x", "_a"), model).select("_a", "peer_distance"))
    q = quantiles(seen, ["_a", "peer_distance"], [0.05, 0.99])
    model.bounds = {"anomaly": tuple(q["_a"]), "peer": tuple(q["peer_distance"])}
    return model


def score(features: DataFrame, model: RiskModel) -> DataFrame:
    """features with risk_score and its parts; days whose baseline is not ready keep nulls."""
    ready = F.col("baseline_ready")
    rows = _peer_distance(features, model).withColumn("_x", scaled(model.robust_scale))
    rows = model.detector.score(rows, "_x", "_a").drop("_x")
    lits = lambda k: [F.lit(float(v)) for v in model.bounds[k]]
    rows = rows.withColumns({"anomaly_component": F.when(ready, arctan_scale(F.col("_a"), *lits("anomaly"))), "peer_component": F.when(ready, arctan_scale(F.col("peer_distance"), *lits("peer")))})
    wa, wp = model.weights
    zs = [c for c in features.columns if c.startswith("z_")]
    top = top_deviation(zs)
    return rows.withColumns({
        "risk_score": F.when(ready, 100 * (wa * F.col("anomaly_component") + wp * F.col("peer_component"))),
        "peer_distance": F.when(ready, F.col("peer_distance")), "peer_source": F.when(ready, F.col("peer_source")),
        "top_deviation_feature": F.when(ready, F.regexp_replace(top["name"], "^z_", "")), "top_deviation_z": F.when(ready, top["value"]),
    }).drop("_a")


def save(model: RiskModel, path: str) -> None:
    """Parquet tables for what is by user or group and for the detector, one row for the rest."""
    spark = model.clusters.sparkSession
    model.clusters.write.mode("overwrite").parquet(f"{path}/clusters")
    model.groups.write.mode("overwrite").parquet(f"{path}/groups")
    model.detector.save(spark, f"{path}/detector")
    plain = {k: getattr(model, k) for k in ("raw", "features", "peer_scale", "robust_scale", "centres", "bounds", "weights", "settings")}
    spark.createDataFrame([(json.dumps(plain),)], "settings string").write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> RiskModel:
    plain = json.loads(spark.read.parquet(f"{path}/model").first()["settings"])
    plain["bounds"] = {k: tuple(v) for k, v in plain["bounds"].items()}
    detector = detectors.make(plain["settings"].get("family", "isolation_forest")).restore(spark, f"{path}/detector")
    return RiskModel(clusters=spark.read.parquet(f"{path}/clusters"), groups=spark.read.parquet(f"{path}/groups"), detector=detector, **plain)
