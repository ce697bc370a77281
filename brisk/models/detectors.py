"""Anomaly detectors over a feature vector; a higher score is more anomalous.

All training rows are read, by Spark tasks. The forest grows its trees in tasks, one tree a group, each
from a random sample of all rows, which is its method. LOF joins all rows with their nearest neighbours.
The one-class SVM is solved next to its border, on ever larger samples and then all rows,
until no row lies on the wrong side. The autoencoder's steps are taken where the rows lie, by one task
after another. Scoring is an Arrow-batched pass over all rows with the small fitted model; LOF
with more than SENT distinct vectors scores its training rows as it is fitted, and others by the same join.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbours import POINTS, cells, distances, distinct_vectors, matrix, nearest_neighbours, neighbour_sums, sums_over
from ..operators.order import running, stored

#: Rows of a tree; distinct vectors of a LOF model that are sent to all tasks; distinct vectors of the first
#: solution of the SVM, and those next to the border that one task solves at first.
TREE_ROWS, SENT, PART, TAKEN = 256, 4096, 8192, 8192
#: Of the SVM: what may lie outside the span of the landmarks (squared, of 1); landmarks at most; vectors from
#: which one task chooses them, and how many of these at once at most; stretches of sums up to the border.
REST, LANDMARKS, SPANNED, BLOCK, CUTS = 1e-6, 4096, 16384, 512, 4096


def _packed(model: object) -> bytes:
    """A model of numbers, arrays and lists of these as bytes that hold no code."""
    arrays: list[np.ndarray] = []

    def plain(x: object) -> object:
        if isinstance(x, np.ndarray):
            arrays.append(x)
            return {"array": len(arrays) - 1}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    shape = json.dumps(plain(model))
    out = io.BytesIO()
    np.savez(out, shape=np.frombuffer(shape.encode(), np.uint8), **{f"a{i}": a for i, a in enumerate(arrays)})
    return out.getvalue()


def _unpacked(data: bytes) -> object:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        real = lambda x: held[f"a{x['array']}"] if isinstance(x, dict) else [real(v) for v in x] if isinstance(x, list) else x
        return real(json.loads(held["shape"].tobytes()))


def _score_with(rows: DataFrame, vector: str, model: object, score: Callable[[object, np.ndarray], np.ndarray], name: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(_packed(model))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = _unpacked(sent.value)
        for part in parts:
            yield pd.Series(score(fitted, np.stack(part.to_numpy()).astype(float)) if len(part) else np.zeros(0))

    return rows.withColumn(name, F.pandas_udf(run, "double")(F.col(vector)))


class _Detector:
    """A detector whose model is a few arrays."""

    model: object

    def score(self, rows: DataFrame, vector: str, name: str = "anomaly") -> DataFrame:
        return _score_with(rows, vector, self.model, self._score, name)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(_packed(self.model),)], "model binary").write.mode("overwrite").parquet(path)

    def restore(self, spark: SparkSession, path: str):
        self.model = _unpacked(spark.read.parquet(path).first()["model"])
        return self


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows (Liu, Ting, Zhou 2008)."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class IsolationForest(_Detector):
    """Isolation forest: `trees` trees of at most TREE_ROWS rows each."""

    def __init__(self, trees: int = 100, seed: int = 7):
        self.trees, self.seed = trees, seed

    def fit(self, rows: DataFrame, vector: str, key: list[str]) -> IsolationForest:
        n = rows.count()
        take = min(1.0, 1.5 * TREE_ROWS / max(n, 1))  # some more than are needed, then the lowest hashes
        pick = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(self.seed), t, *key), F.lit(1 << 30)) < int((1 << 30) * take))
        dealt = rows.select(F.explode(pick).alias("tree"), F.xxhash64(*key).alias("h"), F.col(vector).alias("x"))
        seed = self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            x = np.array(pdf.sort_values("h")["x"].tolist()[:TREE_ROWS], float)
            rng = np.random.default_rng([seed, tree])
            nodes: list[tuple] = []
            limit = int(np.ceil(np.log2(max(len(x), 2))))
            todo = [(np.arange(len(x)), 0, -1, 0)]
            while todo:
                rows_, depth, parent, side = todo.pop()
                me = len(nodes)
                spread = np.flatnonzero(np.ptp(x[rows_], axis=0) > 0) if len(rows_) > 1 and depth < limit else []
                if len(spread):
                    f = int(rng.choice(spread))
                    cut = rng.uniform(x[rows_, f].min(), x[rows_, f].max())
                    nodes.append((f, cut, -1, -1, 0.0))
                    low = x[rows_, f] < cut
                    todo += [(rows_[low], depth + 1, me, 2), (rows_[~low], depth + 1, me, 3)]
                else:
                    nodes.append((-1, 0.0, -1, -1, depth + float(average_path(len(rows_)))))
                if parent >= 0:
                    old = list(nodes[parent])
                    old[side] = me
                    nodes[parent] = tuple(old)
            return pd.DataFrame({"tree": [tree], "size": [len(x)], "nodes": [_packed(np.array(nodes))]})

        grown = dealt.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes binary").orderBy("tree").collect()
        self.model = ([_unpacked(r["nodes"]) for r in grown], float(average_path(max((r["size"] for r in grown), default=2))) or 1.0)
        return self

    @staticmethod
    def _score(model: tuple, x: np.ndarray) -> np.ndarray:
        trees, norm = model
        depth = np.zeros(len(x))
        for nodes in trees:
            at = np.zeros(len(x), int)
            while len(live := np.flatnonzero(nodes[at, 0] >= 0)):
                node = nodes[at[live]]
                low = x[live, node[:, 0].astype(int)] < node[:, 1]
                at[live] = np.where(low, node[:, 2], node[:, 3]).astype(int)
            depth += nodes[at, 4]
        return 2 ** -(depth / max(len(trees), 1) / norm)


class LocalOutlierFactor(_Detector):
    """Novelty form: training rows among the scored ones meet themselves as a neighbour. Of neighbours
    at equal distance the smaller vectors count first."""

    def __init__(self, neighbours: int = 35):
        self.neighbours = neighbours

    def fit(self, rows: DataFrame, vector: str, key: list[str]) -> LocalOutlierFactor:
        points = distinct_vectors(rows, vector)
        n = points.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        self.k = max(1, min(self.neighbours, n - 1))
        self.index = cells(points, max(POINTS, 8 * self.k))
        near = stored(nearest_neighbours(points.withColumn("qid", F.col("vid")), self.index, self.k, own=True, lists=True))
        placed = self.index.points.select("vid", "x", "n", "cell")
        radius = near.groupBy(F.col("qid").alias("vid")).agg(F.max("radius").alias("radius"))
        # a single vector has no neighbours
        placed = stored(placed.join(radius, "vid", "left").fillna({"radius": 0.0}))
        reach = sums_over(near, placed.withColumn("density", F.lit(0.0))).select(F.col("qid").alias("vid"), (1 / (F.col("rs") / F.col("w") + 1e-10)).alias("density"))
        table = stored(placed.join(reach, "vid", "left").fillna({"density": 1e10}))
        # a training row that is scored meets itself once more, so the last of its neighbours counts once less
        others = sums_over(near, table, self.k - 1)
        once = F.least(F.col("n"), F.lit(self.k))
        every = table.join(others.withColumnRenamed("qid", "vid"), "vid", "left").fillna({"w": 0.0, "ds": 0.0, "rs": 0.0}).withColumn("w", F.col("w") + once)
        own = (F.col("ds") + once * F.col("density")) / F.col("w") * ((F.col("rs") + once * F.col("radius")) / F.col("w") + 1e-10)
        self._set(stored(every.select("vid", "x", "n", "radius", "density", own.alias("own"))))
        return self

    def _set(self, table: DataFrame) -> None:
        self.table, self.model = table, None
        small = table.orderBy("vid").limit(SENT + 1).select("x", "n", "radius", "density").collect()
        if len(small) <= SENT:
            self.model = (np.array([r["x"] for r in small], float), np.array([r["n"] for r in small], float), self.k, np.array([r["radius"] for r in small]), np.array([r["density"] for r in small]))

    @staticmethod
    def _score(model: tuple, q: np.ndarray) -> np.ndarray:
        x, n, k, radius, density = model
        out = []
        for at in range(0, len(q), 512):
            d = distances(q[at : at + 512], x)
            near = np.argsort(d, axis=1, kind="stable")
            take = n[near]
            take = np.clip(k - (np.cumsum(take, axis=1) - take), 0, take)
            near, take = near[:, :k], take[:, :k]
            reach = (take * np.maximum(np.take_along_axis(d, near, 1), radius[near])).sum(1) / take.sum(1)
            out.append((take * density[near]).sum(1) / take.sum(1) * (reach + 1e-10))
        return np.concatenate(out)

    def score(self, rows: DataFrame, vector: str, name: str = "anomaly") -> DataFrame:
        if self.model is not None:
            return super().score(rows, vector, name)
        queries = rows.select(F.col(vector).cast("array<double>").alias("_v")).distinct()
        both = stored(queries.join(self.table.select("x", F.col("own").alias(name)), F.col("_v") == F.col("x"), "left").drop("x").withColumn("qid", F.monotonically_increasing_id()))
        found, new = both.where(F.col(name).isNotNull()).select("_v", name), both.where(F.col(name).isNull()).select("qid", F.col("_v").alias("x"))
        if not new.isEmpty():
            mean = lambda c: F.col(c) / F.col("w")
            scored = neighbour_sums(new, self.index, self.table, self.k).select("qid", (mean("ds") * (mean("rs") + 1e-10)).alias(name))
            found = found.unionByName(new.join(scored, "qid").select(F.col("x").alias("_v"), name))
        return rows.join(stored(found), rows[vector].cast("array<double>") == F.col("_v"), "left").drop("_v")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table.withColumn("k", F.lit(self.k)).write.mode("overwrite").parquet(path)

    def restore(self, spark: SparkSession, path: str) -> LocalOutlierFactor:
        table = spark.read.parquet(path)
        self.k = table.first()["k"]
        self._set(table.drop("k"))
        self.index = cells(self.table, max(POINTS, 8 * self.k)) if self.model is None else None
        return self


class _Kernel:
    """Columns of the RBF kernel matrix of x, some of them kept."""

    def __init__(self, x: np.ndarray, gamma: float, megabytes: int = 512):
        self.x, self.gamma, self.kept = x, gamma, {}
        self.most = max(2, megabytes * (1 << 20) // max(1, 8 * len(x)))

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.kept:
            if len(self.kept) >= self.most:
                self.kept.pop(next(iter(self.kept)))
            self.kept[i] = _kernel(self.x, self.x[i : i + 1], self.gamma)[:, 0]
        return self.kept[i]


def _kernel(q: np.ndarray, x: np.ndarray, gamma: float) -> np.ndarray:
    """The RBF kernel of all rows of q with all of x."""
    out = q @ (2 * gamma * x.T)
    out -= gamma * (q * q).sum(1)[:, None]
    out -= gamma * (x * x).sum(1)
    np.minimum(out, 0, out=out)
    return np.exp(out, out=out)


def _sums(q: np.ndarray, x: np.ndarray, a: np.ndarray, gamma: float) -> np.ndarray:
    """For each row of q the sum over the rows of x of a times the kernel. Exponents are one product of matrices, for so
    many rows at once that they stay in the processor's cache."""
    out = np.zeros(len(q))
    if not len(x):
        return out
    mid, lot = x.mean(0), max(1, (1 << 16) // len(x))
    x = x - mid
    right = np.column_stack([2 * gamma * x, np.ones(len(x)), -gamma * (x * x).sum(1)]).T.copy()
    held = np.empty((min(lot, len(q)), len(x)))
    for at in range(0, len(q), lot):
        part = q[at : at + lot] - mid
        each = np.matmul(np.column_stack([part, -gamma * (part * part).sum(1), np.ones(len(part))]), right, out=held[: len(part)])
        np.minimum(each, 0, out=each)
        out[at : at + lot] = np.exp(each, out=each) @ a
    return out


def _solve(x: np.ndarray, cap: np.ndarray, gamma: float, start: np.ndarray | None = None, rounds: int = 10_000_000, fixed: np.ndarray | None = None, mass: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (sum `mass`, each up to its cap) and offset of the one-class SVM by sequential minimal
    optimisation (Schoelkopf et al. 2001; second-order choice of Fan, Chen, Lin 2005). `fixed` is what
    rows that are not among x add to the sum of each."""
    kernel = _Kernel(x, gamma)
    if start is None:
        left = mass - (np.cumsum(cap) - cap)
        start = np.clip(left, 0, cap)
    a = start.copy()
    held = np.flatnonzero(a)
    g = _sums(x, x[held], a[held], gamma) + (0 if fixed is None else fixed)
    tiny = 1e-9 * cap
    for _ in range(rounds):
        i = int(np.where(a < cap - tiny, g, np.inf).argmin())
        ki, over = kernel[i], np.where(a > tiny, g - g[i], 0)
        if not over.max(initial=0.0) > 1e-6 * max(1e-12, abs(g).max()):
            break
        over = np.maximum(over, 0)
        j = int((over * over / np.maximum(2 - 2 * ki, 1e-12)).argmax())
        step = min((g[j] - g[i]) / max(2 - 2 * ki[j], 1e-12), cap[i] - a[i], a[j])
        a[i] += step
        a[j] -= step
        g += step * (ki - kernel[j])
    some = a > tiny
    edge = some & (a < cap - tiny)
    a[~some] = 0
    return a, float(g[edge].mean() if edge.any() else g[some].max(initial=0.0))


def _outside(q: np.ndarray, z: np.ndarray, back: np.ndarray, gamma: float) -> np.ndarray:
    """Whether of each row of q more than REST (squared, of 1) lies outside the span of z; back is the inverse of its
    Cholesky factor. Rows that the first landmarks span already don't meet the others."""
    out = np.ones(len(q), bool)
    for at in range(0, len(q), 1024):
        kernel = _kernel(q[at : at + 1024], z, gamma)
        left, live = np.ones(len(kernel)), np.arange(at, at + len(kernel))
        for low in range(0, len(z), BLOCK):
            high = min(low + BLOCK, len(z))
            left -= ((kernel[:, :high] @ back[low:high, :high].T) ** 2).sum(1)
            if (go := left > REST).mean() < 0.75 or high == len(z):
                out[live[~go]] = False
                kernel, left, live = kernel[go], left[go], live[go]
    return out


def _factor(z: np.ndarray, gamma: float) -> np.ndarray:
    """The inverse of the Cholesky factor of the kernel of z."""
    return np.linalg.inv(np.linalg.cholesky(_kernel(z, z, gamma) + 1e-13 * np.eye(len(z)))) if len(z) else np.zeros((0, 0))


def _landmarks(x: np.ndarray, z: np.ndarray, gamma: float, most: int) -> np.ndarray:
    """Rows of x, farthest first, that leave of none more than REST outside their span and that of z (pivoted
    Cholesky); with more than `most` of both it ends earlier.

    The BLOCK farthest rows are taken together: among them the farthest is the farthest of all until it lies nearer than
    the nearest of them did, and then all rows meet the ones taken at once."""
    held = np.zeros((max(len(z), min(most, len(z) + len(x))) + BLOCK, len(x)))
    held[: len(z)] = _factor(z, gamma) @ _kernel(z, x, gamma)
    r, left, found = len(z), 1 - (held[: len(z)] ** 2).sum(0), []
    while left.max(initial=0.0) > REST and r <= most:
        far = np.argpartition(-left, min(BLOCK, len(left)) - 1)[:BLOCK]
        own, taken, rows = left[far], [], np.zeros((len(far), len(far)))
        floor = max(REST, own.min()) if len(far) < len(left) else REST
        each = _kernel(x[far], x[far], gamma) - held[:r, far].T @ held[:r, far]
        while len(taken) < len(far) and (own.max() > floor or not taken):
            i, n = int(own.argmax()), len(taken)
            rows[n] = (each[i] - rows[:n, i] @ rows[:n]) / np.sqrt(own[i])
            own -= rows[n] ** 2
            own[i] = 0
            taken.append(i)
        new, n = far[taken], len(taken)
        held[r : r + n] = np.linalg.solve(np.tril(rows[:n, taken].T), _kernel(x[new], x, gamma) - held[:r, new].T @ held[:r])
        left -= (held[r : r + n] ** 2).sum(0)
        left[new] = 0
        r += n
        found += new.tolist()
    return x[found]


class OneClassSvm(_Detector):
    """RBF one-class SVM over all rows. Equal vectors are one with a cap as high as their number.

    A hash sample of `part` vectors is solved first, then samples eight times as large each, until all
    vectors take part. On each, all sums are computed by the solution at hand; vectors whose sum lies
    clearly under the border have their cap and those clearly above it 0, and the `taken` vectors next
    to the border are solved by one task, given the others. Over all vectors this is repeated, with
    twice as many, until no vector lies on the wrong side: the conditions of the optimum then hold for all.

    At least nu of the rows are support vectors. If fewer landmarks span all vectors (but for REST), sums
    over support vectors become sums over landmarks, whose number does not follow that of the rows; so
    each pass takes a time in proportion to the rows. Vectors of many spread dimensions have no such
    landmarks; there the support vectors stay, and must fit in one task and a broadcast."""

    def __init__(self, nu: float = 0.01, gamma: float | None = None, part: int = PART, taken: int = TAKEN, landmarks: int = LANDMARKS):
        self.nu, self.gamma, self.part, self.taken, self.landmarks = nu, gamma, part, taken, landmarks

    def fit(self, rows: DataFrame, vector: str, key: list[str]) -> OneClassSvm:
        points = distinct_vectors(rows, vector)
        row = points.agg(F.count("*").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max(F.size("x")).alias("p")).first()
        m, p = row["m"], row["p"] or 0
        if not m:
            self.model = (np.zeros((0, 0)), np.zeros(0), self.gamma or 1.0, 0.0)
            return self
        gamma = self.gamma
        if gamma is None:  # 1 / (p * variance of all numbers)
            each = points.select("n", F.explode("x").alias("v"))
            mean = each.agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).first()["v"]
            spread = each.agg((F.sum(F.col("n") * (F.col("v") - mean) ** 2) / F.sum("n")).alias("v")).first()["v"]
            gamma = 1 / max(p * spread, 1e-12)
        self.dims, self.width = p, gamma
        self._span(points, m)
        draw = F.pmod(F.xxhash64("vid", F.lit(1)), F.lit(1 << 30))
        size, model = min(m, self.part), None
        while True:
            some = points if size >= m else points.where(draw < int((1 << 30) * (size / m)))
            model = self._border(some, model, size >= m)
            if size >= m:
                break
            size = min(m, 8 * size)
        self.model = model
        return self

    def _span(self, points: DataFrame, m: int) -> None:
        """Landmarks, if there are fewer than support vectors. Those of a small sample tell early if there will be too many."""
        self.spanned, gamma, dims = None, self.width, self.dims
        most = min(self.landmarks, int(self.nu * m))
        z, left, size, columns = np.zeros((0, dims)), points.select("vid", "x"), m, "x array<double>"

        def outside(sent):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                z, back = sent.value
                for b in batches:
                    yield b.filter(pa.array(_outside(matrix(b.column("x"), dims), z, back, gamma)))

            return run

        def more(z: np.ndarray, taken: int) -> np.ndarray:
            """Landmarks z and those that a sample of so many rows needs besides."""
            met = left if size <= taken else left.where(F.pmod(F.xxhash64("vid", F.lit(2)), F.lit(1 << 30)) < int((1 << 30) * (taken / size)))
            pick = lambda pdf: pd.DataFrame({"x": list(_landmarks(np.array(pdf.sort_values("vid")["x"].tolist(), float), z, gamma, most))})
            return np.array([*z.tolist(), *[r["x"] for r in met.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(pick, columns).collect()]], float).reshape(-1, dims)

        if size > SPANNED:
            z = more(z, SPANNED // 4)
            if len(z) * (size / (SPANNED // 4)) ** 0.25 > most:  # their number grows faster than that
                return
        while size and len(z) <= most:
            z = more(z, SPANNED)
            if size <= SPANNED or len(z) > most:
                break
            sent = points.sparkSession.sparkContext.broadcast((z, _factor(z, gamma)))
            left = stored(left.mapInArrow(outside(sent), "vid long, x array<double>"))
            size = left.count()
        if len(z) <= most:
            self.spanned = (z, _factor(z, gamma))

    def _short(self, table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and weights whose sums are those of the vectors and weights of the table (vid, x, a)."""
        dims, gamma = self.dims, self.width
        if self.spanned is None:
            held = table.select("vid", "x", "a").orderBy("vid").toPandas()
            return np.array(held["x"].tolist(), float).reshape(-1, dims), held["a"].to_numpy()
        z, back = self.spanned
        sent = table.sparkSession.sparkContext.broadcast(z)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value))
            for b in batches:
                total += _sums(sent.value, matrix(b.column("x"), dims), b.column("a").to_numpy(), gamma)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        got = table.select("x", "a").mapInArrow(run, "sums array<double>").collect()
        return z, back.T @ (back @ np.sum([np.array(r["sums"]) for r in got] or [np.zeros(len(z))], axis=0))

    def _border(self, points: DataFrame, model: tuple | None, last: bool) -> tuple:
        """The model of points (vid, x, n), from that of a part of them; unless it is the last, without a check."""
        gamma, nu, dims, spark = self.width, self.nu, self.dims, points.sparkSession
        total, m = points.agg(F.sum("n").alias("n"), F.count("*").alias("m")).first()
        if not m:
            return model
        taken, side, rows = max(self.taken, 1), None, points.select("vid", "x", "n", F.lit(0).alias("side"))

        while True:
            lo, hi = 0, CUTS * 4
            if model is not None:
                rows = stored(self._placed(rows, model).drop("s"))
                rho = model[3]
                if last and side is not None:
                    off = max(1e-5 * abs(rho), REST)
                    wrong = ((F.col("side") < 0) & (F.col("f") > rho + off)) | ((F.col("side") > 0) & (F.col("f") < rho - off))
                    bad = rows.where(wrong).count()
                    if not bad:
                        return model
                    taken *= 2
                counted = sorted(map(tuple, rows.groupBy("cut").agg(F.sum("n"), F.count("*")).collect()))
                lo, hi = _around(counted, nu * total, taken)
            else:
                rows = rows.withColumn("f", F.lit(0.0)).withColumn("cut", F.lit(0))
            cap = F.col("n") / (nu * total)
            rows = rows.withColumn("side", F.when(F.col("cut") < lo, -1).when(F.col("cut") > hi, 1).otherwise(0)).withColumn("a", cap)
            under = rows.where("side < 0")
            mass = 1 - (under.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / (nu * total))
            sent = spark.sparkContext.broadcast(self._short(under) if mass < 1 else (np.zeros((0, dims)), np.zeros(0)))

            def solved(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(["f", "vid"], ignore_index=True)
                x = np.array(pdf["x"].tolist(), float)
                a, rho = _solve(x, pdf["a"].to_numpy(), gamma, fixed=_sums(x, *sent.value, gamma), mass=mass)  # noqa: B023
                return pdf.assign(a=a, rho=rho)[["vid", "x", "a", "rho"]]

            done = stored(rows.where("side = 0").groupBy("side").applyInPandas(solved, "vid long, x array<double>, a double, rho double"))
            rho = done.first()["rho"]
            model = (*self._short(under.select("vid", "x", "a").unionByName(done.where("a > 0").select("vid", "x", "a"))), gamma, rho)
            side, rows = True, rows.select("vid", "x", "n", "side")
            if not last or (lo <= 0 and hi >= CUTS * 4):
                return model

    def _placed(self, rows: DataFrame, model: tuple) -> DataFrame:
        """rows with their sums f and the stretch of sums in which these lie."""
        cut = F.floor(F.greatest(F.col("f"), F.lit(0.0)) / F.lit(max(model[3], 1e-300)) * CUTS)
        return _score_with(rows, "x", model, self._score, "s").withColumn("f", F.lit(model[3]) - F.col("s")).withColumn("cut", F.least(cut, F.lit(CUTS * 4)).cast("int"))

    @staticmethod
    def _score(model: tuple, q: np.ndarray) -> np.ndarray:
        x, a, gamma, rho = model
        return rho - _sums(q, x, a, gamma) if len(x) else np.zeros(len(q))


def _around(counted: list[tuple[int, int, int]], weight: float, taken: int) -> tuple[int, int]:
    """The first and last stretch about the one in which the weights reach `weight`, such that they hold `taken`
    vectors. counted: stretch, weight, vectors; stretches before and after the ones given are empty."""
    places, weights, sizes = (np.array(v) for v in zip(*counted, strict=True))
    end = len(places) - 1
    lo = hi = mid = min(int(np.searchsorted(np.cumsum(weights), weight)), end)
    held = sizes[mid]
    while held < taken and (lo > 0 or hi < end):
        if lo > 0 and (hi == end or places[mid] - places[lo - 1] <= places[hi + 1] - places[mid]):
            lo -= 1
            held += sizes[lo]
        else:
            hi += 1
            held += sizes[hi]
    return (int(places[lo]) if lo else 0), (int(places[hi]) if hi < end else CUTS * 4)


class Autoencoder(_Detector):
    """One hidden layer (ReLU), trained with Adam on the squared error; the score is the error.

    Batches are `batch` rows in the order of their keys, and each step needs the one before. Rows are dealt
    over tasks that run at the same time (a barrier stage), each with a stretch of whole batches; a task
    takes the steps of its own and hands the weights on to the next. So tasks talk once for each epoch
    and task, not once for each batch. The number of tasks follows that of the rows (NUMBERS each) and
    does not change the result."""

    NUMBERS = 1 << 24

    def __init__(self, seed: int = 7, epochs: int = 20, batch: int = 256, rate: float = 1e-3, tasks: int | None = None):
        self.seed, self.epochs, self.batch, self.rate, self.tasks = seed, epochs, batch, rate, tasks

    def fit(self, rows: DataFrame, vector: str, key: list[str]) -> Autoencoder:
        spark = rows.sparkSession
        rows = rows.select(*key, F.col(vector).cast("array<double>").alias("_x"))
        placed = stored(running(rows, [*key, "_x"], {"place": F.lit(1)}).select((F.col("place") - 1).alias("place"), "_x"))
        size = placed.agg(F.count("*").alias("n"), F.max(F.size("_x")).alias("p")).first()
        n, p = size["n"], size["p"] or 0
        tasks = self.tasks or max(1, min(spark.sparkContext.defaultParallelism, n * p // self.NUMBERS))
        seed, epochs, batch, rate = self.seed, self.epochs, self.batch, self.rate

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from base64 import b64decode, b64encode

            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()
            together, me = len(context.getTaskInfos()), context.partitionId()
            held = [(b.column("place").to_numpy(), matrix(b.column("_x"), p)) for b in batches if b.num_rows]
            place = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
            order = np.argsort(place)
            place, x = place[order], (np.concatenate([h[1] for h in held])[order] if held else np.zeros((0, p)))
            w = _start(seed, p)
            first, second, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
            for _ in range(epochs):
                for turn in range(together):
                    if turn == me:
                        for at in range(0, len(x), batch):
                            part = x[at : at + batch]
                            t += 1
                            for i, v in enumerate(_gradient(w, part, part.size)):
                                first[i] = 0.9 * first[i] + 0.1 * v
                                second[i] = 0.999 * second[i] + 0.001 * v * v
                                w[i] = w[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
                    if together > 1:
                        said = context.allGather(b64encode(_packed([w, first, second, t])).decode() if turn == me else "")
                        w, first, second, t = _unpacked(b64decode(said[turn]))
            if me == 0:
                yield pa.RecordBatch.from_arrays([pa.array([_packed(w)], pa.binary())], ["model"])

        stretch = -(-n // (tasks * batch)) * batch  # whole batches
        own = F.floor(F.col("place") / stretch).cast("int") if n else None
        dealt = placed.repartitionById(tasks, own) if n else placed.coalesce(1)
        got = dealt.mapInArrow(train, "model binary", barrier=True).collect()
        self.model = _unpacked(got[0]["model"])
        return self

    @staticmethod
    def _score(model: tuple, q: np.ndarray) -> np.ndarray:
        out = np.maximum(q @ model[0] + model[1], 0) @ model[2] + model[3]
        return ((out - q) ** 2).mean(1)


def _start(seed: int, p: int) -> list[np.ndarray]:
    """Weights and offsets of both layers before training."""
    rng = np.random.default_rng(seed)
    h = max(2, min(32, p // 2))
    into, out = (rng.uniform(-1, 1, s) / np.sqrt(max(1, s[0])) for s in ((p, h), (h, p)))
    return [into, np.zeros(h), out, np.zeros(p)]


def _gradient(w: list[np.ndarray], x: np.ndarray, numbers: int) -> list[np.ndarray]:
    """Of the squared error of rows x, as their part in a mean over so many numbers."""
    hidden = np.maximum(x @ w[0] + w[1], 0)
    error = 2 * (hidden @ w[2] + w[3] - x) / max(1, numbers)
    back = (error @ w[2].T) * (hidden > 0)
    return [x.T @ back, back.sum(0), hidden.T @ error, error.sum(0)]


NAMES = {"iforest": "isolation_forest", "isolation_forest": "isolation_forest", "lof": "lof", "ocsvm": "ocsvm", "one_class_svm": "ocsvm", "autoencoder": "autoencoder"}


def make(family: str, seed: int = 7, trees: int = 100, neighbours: int = 35, nu: float = 0.01):
    """A detector by name."""
    kind = NAMES.get(family)
    if kind is None:
        raise ValueError(f"unknown detector {family}; known are {sorted(NAMES)}")
    return {"isolation_forest": lambda: IsolationForest(trees, seed), "lof": lambda: LocalOutlierFactor(neighbours), "ocsvm": lambda: OneClassSvm(nu), "autoencoder": lambda: Autoencoder(seed)}[kind]()
