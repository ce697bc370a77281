"""Permutation importance against the same permutations made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brisk.operators import metrics, selection


def precision(score, label):
    """Average precision with ties as one step."""
    out, tp, seen = 0.0, 0, 0
    for s in sorted(set(score), reverse=True):
        pos = label[score == s].sum()
        tp, seen = tp + pos, seen + (score == s).sum()
        out += pos * tp / seen
    return out / label.sum()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, 400).round(1), rng.integers(0, 3, 400)
    label = (a + rng.normal(0, 1, 400) > 1).astype(int)
    return spark.createDataFrame([(int(i * 7 % 400), f"d{i}", float(x), int(y), int(z)) for i, (x, y, z) in enumerate(zip(a, b, label, strict=True))], "user int, day string, a double, b int, label int").repartition(5)


def test_importance_equals_permutations_by_hand(spark, rows):
    got = {r["feature"]: r for r in selection.permutation_importance(rows, ["a", "b"], ["user", "day"], lambda d: d.withColumn("s", F.col("a") + 0.1 * F.col("b")), 3, seed=11, column="s").collect()}
    held = rows.orderBy("user", "day").toPandas()
    places = spark.createDataFrame([(i + 1, r, f) for i in range(len(held)) for r in range(3) for f in "ab"], "p long, r int, f string").withColumn("h", F.xxhash64(F.lit(11), "r", "f", "p")).toPandas()
    base = precision((held["a"] + 0.1 * held["b"]).to_numpy(), held["label"].to_numpy())
    for f in "ab":
        drops = []
        for r in range(3):
            order = places[(places["r"] == r) & (places["f"] == f)].sort_values(["h", "p"])["p"].to_numpy() - 1
            copy = held.copy()
            copy[f] = held[f].to_numpy()[order]
            drops.append(base - precision((copy["a"] + 0.1 * copy["b"]).to_numpy(), held["label"].to_numpy()))
        assert got[f]["baseline_pr_auc"] == pytest.approx(base)
        assert got[f]["mean_pr_auc_drop"] == pytest.approx(np.mean(drops)) and got[f]["std_pr_auc_drop"] == pytest.approx(np.std(drops))
    assert got["a"]["mean_pr_auc_drop"] > got["b"]["mean_pr_auc_drop"]
    with pytest.raises(ValueError):
        selection.permutation_importance(rows, ["a"], ["user", "day"], lambda d: d, 0)


def test_average_precision_by_key(spark, rows):
    got = {r["b"]: r["pr_auc"] for r in metrics.average_precision(rows, "a", ("b",)).collect()}
    for k, part in rows.toPandas().groupby("b"):
        assert got[k] == pytest.approx(precision(part["a"].to_numpy(), part["label"].to_numpy()))
