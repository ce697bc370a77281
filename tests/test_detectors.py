"""Detectors fitted by Spark against plain NumPy fits of the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brisk.models import detectors
from brisk.operators import neighbours


def frame(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(parts)


def plain_neighbours(x, q, k, own):
    """Places of the k nearest, nearest and smallest first; with own, q is x and a row is not its own neighbour."""
    order = np.lexsort(x.T[::-1])
    d = neighbours.distances(q, x[order])
    if own:
        for i, place in enumerate(np.argsort(order)):
            d[i, place] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order[near], np.take_along_axis(d, near, 1)


def plain_lof(x, q, k):
    near, d = plain_neighbours(x, x, k, True)
    radius = d[:, -1]
    density = 1 / (np.maximum(d, radius[near]).mean(1) + 1e-10)
    near, d = plain_neighbours(x, q, k, False)
    return density[near].mean(1) * (np.maximum(d, radius[near]).mean(1) + 1e-10)


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(6, 0.3, (300, 3)), np.zeros((200, 3)), rng.integers(0, 4, (200, 3)), [[50.0, 0, 0]]])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("chunk,lot", [(1024, 2048), (40, 30)])
def test_neighbours_are_the_nearest(spark, clouds, chunk, lot, monkeypatch):
    monkeypatch.setattr(neighbours, "LOT", lot)
    points = neighbours.distinct_vectors(frame(spark, clouds), "x")
    held = {r["vid"]: (tuple(r["x"]), r["n"]) for r in points.collect()}
    values = [v for v, _ in sorted(held.values())]
    assert [held[v][0] for v in sorted(held)] == values and sum(n for _, n in held.values()) == len(clouds)
    queries = np.concatenate([clouds[:50], [[3.0, 3, 3], [1000.0, 0, 0]]])
    asked = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(queries)], "qid long, x array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(asked, neighbours.cells(points, chunk), 7).collect():
        got.setdefault(r["qid"], []).append((r["d"], held[r["vid"]][0], r["n"]))
    x = clouds[np.lexsort(clouds.T[::-1])]
    for i, q in enumerate(queries):
        d = neighbours.distances(q[None], x)[0]
        want = [(d[j], tuple(x[j])) for j in np.argsort(d, kind="stable")[:7]]
        assert [(d, v) for d, v, n in sorted(got[i]) for _ in range(n)] == want


@pytest.mark.parametrize("sent", [4096, 10])
def test_lof_reads_all_rows(spark, clouds, sent, monkeypatch):
    monkeypatch.setattr(detectors, "SENT", sent)
    rows = frame(spark, np.concatenate([clouds, [[3.0, 3, 3], [1000.0, 0, 0]]]))
    fitted = detectors.make("lof", neighbours=12).fit(rows.where(F.col("id") < len(clouds)), "x", ["id"])
    got = dict(map(tuple, fitted.score(rows, "x").select("id", "anomaly").collect()))
    want = plain_lof(clouds, np.concatenate([clouds, [[3.0, 3, 3], [1000.0, 0, 0]]]), 12)
    assert np.allclose([got[i] for i in range(len(want))], want, rtol=1e-9)


def test_lof_of_few_rows_and_its_tables(spark, tmp_path):
    one = frame(spark, [[1.0, 2.0]])
    assert detectors.make("lof").fit(one, "x", ["id"]).score(one, "x").first()["anomaly"] == pytest.approx(1, abs=1e-6)
    rows = frame(spark, np.random.default_rng(1).normal(0, 1, (60, 2)))
    for family in ("lof", "ocsvm", "autoencoder", "iforest"):
        fitted = detectors.make(family, trees=5).fit(rows, "x", ["id"])
        fitted.save(spark, f"{tmp_path}/{family}")
        again = detectors.make(family).restore(spark, f"{tmp_path}/{family}")
        score = lambda d: [r["anomaly"] for r in d.score(rows, "x").orderBy("id").collect()]
        assert score(fitted) == score(again)


def test_svm_of_parts_equals_one_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (900, 3)), rng.normal(4, 0.5, (500, 3)), np.round(rng.normal(0, 2, (600, 3)))])
    nu, gamma = 0.05, 0.2
    a, rho = detectors._solve(x, np.full(len(x), 1 / (nu * len(x))), gamma)
    want = rho - np.exp(-gamma * neighbours.distances(x, x[a > 0]) ** 2) @ a[a > 0]
    rows = frame(spark, x)
    fitted = detectors.OneClassSvm(nu, gamma, part=150, taken=20).fit(rows, "x", ["id"])
    got = np.array([r["anomaly"] for r in fitted.score(rows, "x").orderBy("id").collect()])
    assert np.abs(got - want).max() < 1e-4 and len(fitted.model[1]) < len(x) / 4
    scaled = detectors.make("ocsvm", nu=nu).fit(rows, "x", ["id"])
    assert scaled.model[2] == pytest.approx(1 / (3 * x.var()))


@pytest.mark.parametrize("tasks", [1, 3])
def test_autoencoder_of_several_tasks_equals_one_process(spark, tasks):
    x = np.random.default_rng(2).normal(0, 1, (330, 5))
    w = detectors._start(7, 5)
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(3):
        for at in range(0, len(x), 50):
            b = x[at : at + 50]
            t += 1
            for i, g in enumerate(detectors._gradient(w, b, b.size)):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 1e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    fitted = detectors.Autoencoder(epochs=3, batch=50, tasks=tasks).fit(frame(spark, x), "x", ["id"])
    for a, b in zip(fitted.model, w, strict=True):
        assert np.allclose(a, b, atol=1e-9)


def test_the_number_of_tasks_does_not_change_the_autoencoder(spark):
    rows = frame(spark, np.random.default_rng(6).normal(0, 1, (1000, 7)))
    one, several = (detectors.Autoencoder(epochs=2, batch=64, tasks=t).fit(rows, "x", ["id"]).model for t in (1, 4))
    assert all(np.array_equal(a, b) for a, b in zip(one, several, strict=True))  # the same steps, handed on


def test_the_gradient_is_that_of_the_error():
    rng = np.random.default_rng(4)
    x, w = rng.normal(0, 1, (6, 4)), detectors._start(1, 4)
    error = lambda: ((np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3] - x) ** 2).mean()
    for a, g in zip(w, detectors._gradient(w, x, x.size), strict=True):
        for i in np.ndindex(a.shape):
            before = error()
            a[i] += 1e-6
            assert (error() - before) / 1e-6 == pytest.approx(g[i], abs=1e-4)
            a[i] -= 1e-6


def test_svm_over_landmarks_equals_one_of_all_rows(spark, monkeypatch):
    """Above as many landmarks as span all rows, the model does not grow with its support vectors."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (1500, 2)), rng.normal(3, 0.5, (499, 2)), [[9.0, -9]]])
    nu, gamma = 0.3, 0.05
    a, rho = detectors._solve(x, np.full(len(x), 1 / (nu * len(x))), gamma)
    want = rho - np.exp(-gamma * neighbours.distances(x, x[a > 0]) ** 2) @ a[a > 0]
    monkeypatch.setattr(detectors, "SPANNED", 300)  # landmarks are chosen from a part, then from what lies outside their span
    fitted = detectors.OneClassSvm(nu, gamma, part=100, taken=500).fit(frame(spark, x), "x", ["id"])
    got = np.array([r["anomaly"] for r in fitted.score(frame(spark, x), "x").orderBy("id").collect()])
    assert np.abs(got - want).max() < 1e-5 and len(fitted.model[1]) < nu * len(x) / 4 and (a > 0).sum() >= nu * len(x)
    every = detectors.OneClassSvm(nu, gamma, part=100, taken=500, landmarks=0).fit(frame(spark, x), "x", ["id"])
    assert len(every.model[1]) >= nu * len(x)
    assert np.abs(detectors.OneClassSvm._score(every.model, x) - want).max() < 1e-5


def test_a_query_meets_as_many_points_whatever_their_number(monkeypatch):
    rng, plain, met = np.random.default_rng(9), neighbours.distances, []
    monkeypatch.setattr(neighbours, "distances", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    each = []
    for n in (4000, 32000):
        x, q = rng.normal(0, 1, (n, 3)), rng.normal(0, 1, (200, 3))
        met.clear()
        row, place, d, r = neighbours._nearest(q, x, np.full(len(q), np.inf), 10)
        each.append(sum(met) / len(q))
        want = plain(q, x)
        assert (place.reshape(200, 10) == np.argsort(want, axis=1, kind="stable")[:, :10]).all() and (r == np.sort(want, axis=1)[:, 9]).all()
    assert each[1] < 1.5 * each[0] < 0.75 * 4000


def test_training_rows_are_scored_without_another_search(spark, clouds, monkeypatch):
    monkeypatch.setattr(detectors, "SENT", 10)
    rows = frame(spark, clouds)
    fitted = detectors.make("lof", neighbours=250).fit(rows, "x", ["id"])  # more than equal vectors, and fewer
    monkeypatch.setattr(detectors, "nearest_neighbours", None)
    got = [r["anomaly"] for r in fitted.score(rows, "x").orderBy("id").collect()]
    assert np.allclose(got, plain_lof(clouds, clouds, 250), rtol=1e-9)


@pytest.mark.parametrize("sent", [4096, 10])
def test_sums_over_neighbours_are_those_of_single_rows(spark, clouds, sent, monkeypatch):
    """Neighbours stay lists, a row for each query and cell, whatever their number."""
    monkeypatch.setattr(neighbours, "LOT", sent)
    points = neighbours.distinct_vectors(frame(spark, clouds), "x")
    index = neighbours.cells(points, 100)
    lists = neighbours.stored(neighbours.nearest_neighbours(points.withColumn("qid", F.col("vid")), index, 20, own=True, lists=True))
    assert lists.count() == lists.select("qid", "cell").distinct().count() <= points.count() * len(index.low)
    single = lists.select("qid", "radius", F.inline(F.arrays_zip("vid", "d", "n", "before"))).toPandas()
    assert (single.groupby("qid")["n"].sum() == 20).all() and (single.groupby("qid")["d"].max() == single.groupby("qid")["radius"].first()).all()
    known = index.points.select("vid", "cell", F.sqrt(F.col("vid") % 7).alias("radius"), (1.0 + F.col("vid") % 5).alias("density"))
    held = single.drop(columns="radius").merge(known.toPandas(), on="vid")
    for others in (None, 19):
        part = held if others is None else held[held["vid"] != held["qid"]].assign(n=lambda h: np.minimum(h["n"], others - h["before"]).clip(lower=0))
        part = part.assign(rs=part["n"] * np.maximum(part["d"], part["radius"]), ds=part["n"] * part["density"])
        want = part.groupby("qid")[["n", "rs", "ds"]].sum().query("n > 0")
        got = neighbours.sums_over(lists, known, others).toPandas().set_index("qid").sort_index()
        assert list(got.index) == list(want.index) and np.allclose(got[["w", "rs", "ds"]], want[["n", "rs", "ds"]])


@pytest.mark.parametrize("block", [1, 7, 512])
def test_landmarks_taken_together_span_what_single_ones_do(block, monkeypatch):
    monkeypatch.setattr(detectors, "BLOCK", block)
    x = np.random.default_rng(11).normal(0, 1, (600, 3))
    known = x[:40]
    z = np.concatenate([known, detectors._landmarks(x, known, 0.1, 600)])
    back = detectors._factor(z, 0.1)
    rest = 1 - ((detectors._kernel(x, z, 0.1) @ back.T) ** 2).sum(1)
    assert rest.max() <= 1.001 * detectors.REST and not detectors._outside(x, z, back, 0.1)[rest < 0.999 * detectors.REST].any()
    less = z[:60]
    outside = detectors._outside(x, less, detectors._factor(less, 0.1), 0.1)
    want = 1 - ((detectors._kernel(x, less, 0.1) @ detectors._factor(less, 0.1).T) ** 2).sum(1) > detectors.REST
    assert (outside == want).all() and outside.any() and not outside.all()
    assert 5 <= len(detectors._landmarks(x, x[:0], 0.1, 5)) <= 6 + block


def test_a_leaf_is_met_by_all_queries_of_a_lot_at_once(monkeypatch):
    rng, calls = np.random.default_rng(12), []
    for name in ("distances", "_squares"):
        if plain := getattr(neighbours, name, None):
            monkeypatch.setattr(neighbours, name, lambda a, b, plain=plain: calls.append(len(a)) or plain(a, b))
    x, q = rng.normal(0, 1, (16000, 4)), rng.normal(0, 1.3, (3000, 4))
    x[:4000] = np.round(x[:4000])  # ties
    q[:200] *= 1000
    most = rng.uniform(0.1, 2000, len(q))
    row, place, d, r = neighbours._nearest(q, x, most, 20)
    assert len(calls) < 3 * 16000 / 125
    for i in rng.permutation(3000)[:300]:
        away = neighbours.np.sqrt(((q[i] - x) ** 2).sum(1))
        near = np.argsort(away, kind="stable")[:20]
        near = near[away[near] <= most[i]]
        assert np.allclose(d[row == i], away[near]) and r[i] == (d[row == i][-1] if len(near) == 20 else most[i])
        assert set(place[row == i]) == set(near) or len(set(away)) < len(away)


@pytest.mark.parametrize("big", [1e-170, 1e160])
def test_neighbours_of_very_small_and_large_numbers(big):
    x = np.random.default_rng(13).normal(0, 1, (1500, 2))
    row, place, d, r = neighbours._nearest(x[:40], x, np.full(40, np.inf), 5)
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        got = neighbours._nearest(x[:40] * big, x * big, np.full(40, np.inf), 5)
    assert len(got[0]) == 200 and (got[0] == row).all()


@pytest.mark.parametrize("chunk,lot", [(2000, 2048), (60, 50)])
def test_sums_without_lists_are_those_over_lists(spark, clouds, chunk, lot, monkeypatch):
    monkeypatch.setattr(neighbours, "LOT", lot)
    index = neighbours.cells(neighbours.distinct_vectors(frame(spark, clouds), "x"), chunk)
    rng = np.random.default_rng(14)
    asked = np.concatenate([clouds[:150], rng.normal(2, 3, (150, 3)), [[1000.0, 0, 0]]])
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(asked)], "qid long, x array<double>")
    known = index.points.select("vid", F.sqrt(F.col("vid") % 7).alias("radius"), (1.0 + F.col("vid") % 5).alias("density"))
    lists = neighbours.stored(neighbours.nearest_neighbours(queries, index, 20, lists=True))
    want = neighbours.sums_over(lists, known.join(index.points.select("vid", "cell"), "vid")).toPandas().sort_values("qid")
    got = neighbours.neighbour_sums(queries, index, known, 20).toPandas().sort_values("qid")
    assert list(got["qid"]) == list(want["qid"]) == list(range(301)) and np.allclose(got[["w", "rs", "ds"]], want[["w", "rs", "ds"]], rtol=1e-12)


def test_too_many_landmarks_are_known_from_a_small_sample(spark, monkeypatch):
    x = np.random.default_rng(15).normal(0, 1, (6000, 5))
    assert len(detectors._landmarks(x[:200], x[:0], 0.05, 300)) < 300 < len(detectors._landmarks(x, x[:0], 0.05, 400))
    points = detectors.distinct_vectors(frame(spark, x), "x")
    svm = detectors.OneClassSvm(0.5, landmarks=300)
    svm.dims, svm.width = 5, 0.05
    monkeypatch.setattr(detectors, "SPANNED", 800)
    monkeypatch.setattr(detectors, "_factor", None)  # the driver needs it only if all rows are held against landmarks
    svm._span(points, len(x))
    assert svm.spanned is None
