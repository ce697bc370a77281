"""Exact k nearest neighbours of many vectors among many, by boxes.

Equal vectors are one point that counts as often as it occurs, so that a vector that a third of all rows
have is one point. Space is cut at medians of a sample; the points of a piece are a cell, and the box around
them is known to all tasks. A query first meets the cell whose box is nearest, which bounds its distances,
and then the cells whose boxes are not farther away than that bound, and no others. Within a cell the task
cuts the points into leaves, at medians again, and a query meets these nearest first, while they can hold
anything nearer; all queries of a lot that meet a leaf do so at once. So the work for a query does not follow
the number of points, but for the boxes of CELLS cells at most that it is held against. Queries of a cell are
dealt over lots, so a task holds one cell and one lot. Neighbours of a model's own points stay lists, one for
each query and cell, and what is known of points is met with them cell by cell (`sums_over`), so that no join
sees a row for each neighbour. Of other queries only sums are wanted: points bring along what is known of them,
and lists are kept only of queries that must meet several cells (`neighbour_sums`). Only a sample of SAMPLE
points and one row of figures a cell reach the driver.

Of points at equal distance the smallest vector comes first (as arrays compare).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import stored

#: Cells at most, and points of one if there are fewer; points from which cuts are found; points of a leaf; queries of a lot.
CELLS, POINTS, SAMPLE, LEAF, LOT = 1024, 131072, 32768, 256, 32768
#: Leaves of a run, how many of its leaves a query meets after the nearest, before all others, and queries that meet a leaf
#: at once, so that a call is worth its while and distances stay near the processor.
RUN, AHEAD, BLOCK = 16, 4, 512

_ASKED = "qid long, cell int, vid array<long>, d array<double>, n array<int>"
_LISTS = {"vid": pa.int64(), "d": pa.float64(), "n": pa.int32(), "before": pa.int32(), "radius": pa.float64(), "density": pa.float64()}


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The rows of a column of arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), dims)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b, such that equal rows have 0."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        step = a[:, j, None] - b[None, :, j]
        step *= step
        out += step
    return np.sqrt(out, out=out)


def distinct_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """(vid, x, n): the distinct vectors of rows, numbered in their order, and how often each occurs."""
    counted = stored(rows.select(F.col(vector).cast("array<double>").alias("x")).groupBy("x").agg(F.count("*").alias("n")))
    return stored(counted.repartitionByRange("x").sortWithinPartitions("x").withColumn("vid", F.monotonically_increasing_id()))


@dataclass
class Cells:
    points: DataFrame  # vid, x, n, cell
    low: np.ndarray  # of each cell: corners of the box around its points
    high: np.ndarray


def _cuts(x: np.ndarray, parts: int) -> list[tuple[int, float, int, int]]:
    """A tree over rows of x: (dimension, cut, place of the lower part, place of the rest); a part is (-1, 0, its number, 0)."""
    nodes, todo, n = [(0, 0.0, 0, 0)], [(0, x, parts)], 0
    while todo:
        at, own, left = todo.pop()
        order = np.argsort(-own.std(0), kind="stable") if left > 1 and len(own) > 1 else []
        for j in order:
            cut = np.median(own[:, j])
            cut = cut if own[:, j].min() < cut else own[own[:, j] > cut, j].min(initial=np.inf)
            if own[:, j].min() < cut < np.inf:
                low = own[:, j] < cut
                nodes[at] = (int(j), float(cut), len(nodes), len(nodes) + 1)
                share = min(left - 1, max(1, round(left * low.mean())))
                todo += [(len(nodes), own[low], share), (len(nodes) + 1, own[~low], left - share)]
                nodes += [(0, 0.0, 0, 0)] * 2
                break
        else:
            nodes[at] = (-1, 0.0, n, 0)
            n += 1
    return nodes


def _part_of(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The part of the tree in which each row of x lies."""
    at = np.zeros(len(x), int)
    while len(live := np.flatnonzero(nodes[at, 0] >= 0)):
        node = nodes[at[live]]
        low = x[live, node[:, 0].astype(int)] < node[:, 1]
        at[live] = np.where(low, node[:, 2], node[:, 3]).astype(int)
    return nodes[at, 2].astype(int)


def _leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the rows of x in leaves of at most so many."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(np.sort(own))
            continue
        j = int(x[own].std(0).argmax()) if x.shape[1] else 0
        half = len(own) // 2
        own = own[np.argpartition(x[own, j], half)] if x.shape[1] else own
        todo += [own[:half], own[half:]]
    return out


def _to_boxes(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distances of all rows of q to all boxes, not above those to any of their points as `distances` has them."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        step = np.maximum(np.maximum(low[None, :, j] - q[:, j, None], q[:, j, None] - high[None, :, j]), 0)
        step *= step
        out += step
    return np.sqrt(out, out=out)


def cells(points: DataFrame, chunk: int = POINTS) -> Cells:
    """points (vid, x, n) dealt over cells."""
    spark, m = points.sparkSession, points.count()
    share = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(m, 1)))
    chosen = (points if m <= SAMPLE else points.where(share)).select("vid", "x").orderBy("vid").toPandas()["x"]
    sample = np.array(chosen.tolist(), float).reshape(len(chosen), -1)
    dims = sample.shape[1]
    sent = spark.sparkContext.broadcast(np.array(_cuts(sample, max(1, min(CELLS, m // chunk)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _part_of(matrix(b.column("x"), dims), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    dealt = stored(points.select("vid", "x", "n").mapInArrow(deal, "vid long, x array<double>, n long, cell int"))
    corner = [f(F.col("x")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(dims)]
    rows = sorted(map(tuple, dealt.groupBy("cell").agg(F.count("*"), *corner).collect()))  # each holds a point of the sample
    box = np.array([r[2:] for r in rows], float).reshape(len(rows), 2 * dims)
    return Cells(dealt, box[:, :dims], box[:, dims:])


def _visits(queries: DataFrame, index: Cells, bounded: bool) -> DataFrame:
    """(qid, x, r, cell): the nearest cell of each query, or with its bound r the others that can hold nearer points."""
    sent = queries.sparkSession.sparkContext.broadcast((index.low, index.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows if len(low) else 0, 512):
                b = whole.slice(at, 512)
                away = _to_boxes(matrix(b.column("x"), low.shape[1]), low, high)
                home, q, r = away.argmin(1), np.arange(b.num_rows), np.full(b.num_rows, np.inf)
                cell = home
                if bounded:
                    r = b.column("r").to_numpy()
                    go = away <= r[:, None]
                    go[q, home] = False
                    q, cell = np.nonzero(go)
                rows = pa.array(q)
                yield pa.RecordBatch.from_arrays([b.column("qid").take(rows), b.column("x").take(rows), pa.array(r[q]), pa.array(cell.astype(np.int32))], ["qid", "x", "r", "cell"])

    return queries.mapInArrow(run, "qid long, x array<double>, r double, cell int")


def _gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squares of `_to_boxes`, computed for some rows at once that stay in the processor's cache."""
    out, lot = np.zeros((len(q), len(low))), max(1, 8192 // len(low))
    low, high, step = np.ascontiguousarray(low.T), np.ascontiguousarray(high.T), np.empty((lot, len(low)))
    for at in range(0, len(q), lot):
        own = out[at : at + lot]
        part = step[: len(own)]
        for j in range(len(low)):
            x = q[at : at + lot, j, None]
            np.subtract(x, np.clip(x, low[j], high[j], out=part), out=part)
            part *= part
            own += part
    return out


def _squares(q: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of q to all of s by one product of matrices, and how far those of each row of q can be off."""
    mid = s.mean(0)
    a, b = q - mid, s - mid
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    a *= -2
    ones = np.ones
    return np.column_stack([a, aa, ones(len(a))]) @ np.column_stack([b, ones(len(b)), bb]).T, _slack(s) * (aa + bb.max())


def _slack(s: np.ndarray) -> float:
    """What rounding can add to a sum over the dimensions, as a share of it."""
    return 8 * (s.shape[1] + 2) * np.finfo(float).eps


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and its places."""
    by = np.argsort(key, kind="stable")
    for i in np.split(by, np.flatnonzero(np.diff(key[by])) + 1) if len(by) else ():
        yield int(key[i[0]]), i


def _nearest(q: np.ndarray, s: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, places in s and distances of the k nearest of each, none beyond `most`, and the bounds of all rows of q.

    A query meets the nearest leaf of its nearest run of RUN leaves, then the next AHEAD of that run, and then all other
    leaves within the bound that these gave. Leaves are met by all their queries at once, and all but the first by products of
    matrices, whose rounding errors are allowed for; the points that may count are then measured as `distances` does."""
    leaves = _leaves(s, max(LEAF, 2 * k))
    low, high = (np.array([f(s[i], axis=0) for i in leaves]).reshape(len(leaves), -1) for f in (np.min, np.max))
    runs = np.arange(0, len(leaves), RUN)
    slack = _slack(s)
    bound, best, hits = most * most * (1 + slack), np.full((len(q), k), np.inf), []

    def meet(rows: np.ndarray, leaf: np.ndarray, gap: np.ndarray, first: bool = False) -> None:
        for c, every in _by(leaf):
            for at in range(0, len(every), BLOCK):
                part = every[at : at + BLOCK]
                i = rows[part[gap[part] <= bound[rows[part]]]]
                if not len(i):
                    continue
                own = s[leaves[c]]
                d, off = (distances(q[i], own) ** 2, np.zeros(len(i))) if first else _squares(q[i], own)
                if not first:
                    some = np.flatnonzero(~(d.min(1) - off > bound[i]))  # not a number where squares are too large: those are met
                    i, d, off = i[some], d[some], off[some]
                both = np.concatenate([best[i], d + off[:, None]], axis=1)
                best[i] = np.partition(both, k - 1, axis=1)[:, :k]
                bound[i] = np.fmin(bound[i], best[i].max(1) * (1 + slack))
                a, b = np.nonzero(~(d > (bound[i] + off)[:, None]))
                hits.append((i[a], leaves[c][b], d[a, b] - off[a]))

    far = _gaps(q, np.minimum.reduceat(low, runs), np.maximum.reduceat(high, runs)) * (1 - slack)
    nearest, home = np.zeros((len(q), min(1 + AHEAD, len(leaves))), int), far.argmin(1)
    gaps = np.full(nearest.shape, np.inf)
    for u, i in _by(home):
        of = slice(u * RUN, (u + 1) * RUN)
        gap = _gaps(q[i], low[of], high[of]) * (1 - slack)
        order = np.argsort(gap, axis=1)[:, : nearest.shape[1]]
        nearest[i, : order.shape[1]], gaps[i, : order.shape[1]] = u * RUN + order, np.take_along_axis(gap, order, 1)
    every = np.arange(len(q))
    meet(every, nearest[:, 0], gaps[:, 0], True)
    met = np.isfinite(gaps[:, 1:])
    meet(np.repeat(every, met.sum(1)), nearest[:, 1:][met], gaps[:, 1:][met])
    rest = []
    for u in range(len(runs)):
        i = np.flatnonzero(far[:, u] <= bound)
        of = slice(u * RUN, (u + 1) * RUN)
        gap = _gaps(q[i], low[of], high[of]) * (1 - slack)
        go = gap <= bound[i, None]
        known = np.flatnonzero(home[i] == u)
        there = np.where(np.isfinite(gaps[i[known]]), nearest[i[known]], nearest[i[known], :1])
        go[known[:, None], there - u * RUN] = False
        a, b = np.nonzero(go)
        rest.append((i[a], u * RUN + b, gap[a, b]))
    meet(*(np.concatenate(v) for v in zip(*rest, strict=True)))
    row, place, least = (np.concatenate(v) for v in zip(*hits, strict=True)) if hits else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    row, place = (v[~(least > bound[row])] for v in (row, place))
    step = q[row] - s[place]
    step *= step
    d = np.zeros(len(row))
    for j in range(s.shape[1]):
        d += step[:, j]
    np.sqrt(d, out=d)
    row, place, d = (v[d <= most[row]] for v in (row, place, d))
    by = np.argsort(row * len(s) + place)
    by = by[np.argsort(d[by], kind="stable")]
    by = by[np.argsort(row[by].astype(np.uint16) if len(q) <= 1 << 16 else row[by], kind="stable")]
    row, place, d = row[by], place[by], d[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    r, last = most.copy(), rank == k - 1
    r[row[last]] = d[last]
    first = rank < k
    return row[first], place[first], d[first], r


def _dealt(queries: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries and points (both with `cell`) with the lot of each query, and a copy of each point for each lot of its cell."""
    lots = queries.groupBy("cell").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    asked = queries.join(F.broadcast(lots), "cell").withColumn("lot", F.pmod(F.xxhash64("qid"), "lots").cast("int")).drop("lots")
    there = points.join(F.broadcast(lots), "cell").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    return asked, there


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _long(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    """Of a table of lists the place of the row of each element, and the elements."""
    columns = [_flat(table.column(n)) for n in names]
    size = columns[0].value_lengths().to_numpy(zero_copy_only=False)
    return [np.repeat(np.arange(table.num_rows), size), *[c.flatten().to_numpy(zero_copy_only=False) for c in columns]]


def _listed(start: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """Columns as lists that begin at the places given."""
    offsets = pa.array(np.append(start, len(next(iter(columns.values())))).astype(np.int32))
    return {n: pa.ListArray.from_arrays(offsets, pa.array(v, _LISTS[n])) for n, v in columns.items()}


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Places at which any of the keys changes."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _meet(visits: DataFrame, index: Cells, k: int) -> DataFrame:
    """(qid, cell, vid, d, n, x, r): of each cell that a query visits its k nearest points, as lists, and the query's bound.
    More than k equal points count as k."""
    dims = index.low.shape[1]
    asked, there = _dealt(stored(visits), index.points.select("vid", "x", "n", "cell"))

    def nearest(queries: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("vid")
        x, n = matrix(points.column("x"), dims), np.minimum(points.column("n").to_numpy(), k)
        q, most = matrix(queries.column("x"), dims), queries.column("r").to_numpy()
        row, place, d, r = _nearest(q, x, most, k) if len(q) and len(x) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), most)
        start = _starts(row) if len(row) else np.zeros(0, int)
        of = pa.array(row[start])
        lists = _listed(start, {"vid": points.column("vid").to_numpy()[place], "d": d, "n": n[place]})
        return pa.table({**{c: _flat(queries.column(c).take(of)) for c in ("qid", "cell")}, **lists, "x": _flat(queries.column("x").take(of)), "r": pa.array(r[row[start]])})

    lot = ["cell", "lot"]
    return asked.groupBy(*lot).cogroup(there.groupBy(*lot)).applyInArrow(nearest, f"{_ASKED}, x array<double>, r double")


def _weights(row: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """How often each element counts among the first k of its row; rows are sorted, with n of each element."""
    before = np.cumsum(n) - n
    start = _starts(row) if len(row) else np.zeros(0, int)
    before = before - np.repeat(before[start], np.diff(np.append(start, len(row))))
    return np.clip(k - before, 0, n)


def _totals(row: np.ndarray, n: np.ndarray, d: np.ndarray, radius: np.ndarray, density: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    total = lambda v: np.bincount(row, n * v, rows)
    return {"w": total(np.ones(len(n))), "rs": total(np.maximum(d, radius)), "ds": total(density)}


def neighbour_sums(queries: DataFrame, index: Cells, known: DataFrame, k: int) -> DataFrame:
    """`sums_over` the k nearest neighbours of queries (qid, x), without lists of them but of queries that meet more than one
    cell; known: (vid, radius, density) of all points."""
    low, high = index.low, index.high
    dims, names = low.shape[1], ["vid", "d", "n", "radius", "density"]
    sent = queries.sparkSession.sparkContext.broadcast((low, high))
    points = index.points.select("vid", "x", "n", "cell").join(known.select("vid", "radius", "density"), "vid")

    def meet(visits: DataFrame, others: bool) -> DataFrame:
        asked, there = _dealt(stored(visits), points)

        def nearest(queries: pa.Table, points: pa.Table) -> pa.Table:
            points = points.sort_by("vid")
            x, q, most = matrix(points.column("x"), dims), matrix(queries.column("x"), dims), queries.column("r").to_numpy()
            vid, n, radius, density = (_flat(points.column(c)).to_numpy() for c in ("vid", "n", "radius", "density"))
            row, place, d, r = _nearest(q, x, most, k) if len(q) and len(x) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), most)
            more = np.ones(len(q), bool)
            for at in range(0, 0 if others else len(q), 4096):
                away = _to_boxes(q[at : at + 4096], *sent.value)
                more[at : at + 4096] = (away <= r[at : at + 4096, None]).sum(1) > 1
            take = _weights(row, n[place], k)
            whole = _totals(row, take, d, radius[place], density[place], len(q))
            keep = more[row] & (take > 0)
            row, place, d = row[keep], place[keep], d[keep]
            lists = _listed(np.searchsorted(row, np.arange(len(q))), {"vid": vid[place], "d": d, "n": np.minimum(n[place], k), "radius": radius[place], "density": density[place]})
            return pa.table({"qid": _flat(queries.column("qid")), "x": _flat(queries.column("x")), "r": pa.array(r), "more": pa.array(more), **whole, **lists})

        lot = ["cell", "lot"]
        types = "qid long, x array<double>, r double, more boolean, w double, rs double, ds double, " + ", ".join(f"{c} array<{'long' if c == 'vid' else 'int' if c == 'n' else 'double'}>" for c in names)
        return asked.groupBy(*lot).cogroup(there.groupBy(*lot)).applyInArrow(nearest, types)

    def merged(lists: pa.Table) -> pa.Table:
        row, vid, d, n, radius, density = _long(lists, names)
        qid, row = np.unique(_flat(lists.column("qid")).to_numpy()[row], return_inverse=True)
        by = np.lexsort((vid, d, row))
        row, d, n, radius, density = (v[by] for v in (row, d, n, radius, density))
        return pa.table({"qid": qid, **_totals(row, _weights(row, n, k), d, radius, density, len(qid))})

    first = stored(meet(_visits(queries.select("qid", "x"), index, False), False))
    sums = ["qid", "w", "rs", "ds"]
    out, left = first.where("not more").select(*sums), first.where("more")
    if count := left.count():
        more = meet(_visits(left.select("qid", "x", "r"), index, True), True)
        lists = left.select("qid", *names).unionByName(more.select("qid", *names))
        part = F.pmod(F.xxhash64("qid"), F.lit(-(-count // LOT))).alias("part")
        out = out.unionByName(lists.groupBy(part).applyInArrow(merged, "qid long, w double, rs double, ds double"))
    return out.where("w > 0")


def _first(found: DataFrame, queries: int, k: int, own: bool) -> DataFrame:
    """(qid, cell, vid, d, n, before, radius): the k nearest of each query, a row for each cell that has some: the last one
    less what is over, how many lie before each, and the distance of the last."""

    def first(lists: pa.Table) -> pa.Table:
        row, vid, d, n = _long(lists, ["vid", "d", "n"])
        qid, cell = (_flat(lists.column(c)).to_numpy()[row] for c in ("qid", "cell"))
        n = n - (vid == qid) if own else n
        by = np.lexsort((vid, d, qid))
        by = by[n[by] > 0]
        qid, cell, vid, d, n = (v[by] for v in (qid, cell, vid, d, n))
        before = np.cumsum(n) - n
        start = _starts(qid) if len(qid) else np.zeros(0, int)
        before -= np.repeat(before[start], np.diff(np.append(start, len(qid))))
        keep = before < k
        qid, cell, vid, d, n, before = (v[keep] for v in (qid, cell, vid, d, n, before))
        n = np.minimum(n, k - before)
        start = _starts(qid) if len(qid) else np.zeros(0, int)
        ends = np.append(start[1:], len(qid)) - 1
        radius = np.repeat(d[ends[: len(start)]], np.diff(np.append(start, len(qid)))) if len(qid) else d
        by = np.lexsort((cell, qid))
        qid, cell, vid, d, n, before, radius = (v[by] for v in (qid, cell, vid, d, n, before, radius))
        start = _starts(qid, cell) if len(qid) else np.zeros(0, int)
        return pa.table({"qid": qid[start], "cell": cell[start], **_listed(start, {"vid": vid, "d": d, "n": n, "before": before}), "radius": radius[start]})

    part = F.pmod(F.xxhash64("qid"), F.lit(-(-queries // LOT) or 1)).alias("part")
    return found.groupBy(part).applyInArrow(first, f"{_ASKED}, before array<int>, radius double")


def nearest_neighbours(queries: DataFrame, index: Cells, k: int, own: bool = False, lists: bool = False) -> DataFrame:
    """(qid, vid, d, n, before) for queries (qid, x): their k nearest points, n times each, and how many lie before
    each; with own, qid is the vid of the query itself, which does not count as its own neighbour. With lists, a row
    for each query and cell that holds neighbours (`cell`), and `radius`, the distance of the last of all."""
    some = k + own
    first = stored(_meet(_visits(queries.select("qid", "x"), index, False), index, some))
    asked = first.select("qid", "x", "r")  # without a bound (r infinite) if its cell has fewer
    more = _meet(_visits(asked, index, True), index, some)
    columns = ["qid", "cell", "vid", "d", "n"]
    found = _first(first.select(*columns).unionByName(more.select(*columns)), first.count(), k, own)
    return found if lists else found.select("qid", F.inline(F.arrays_zip("vid", "d", "n", "before")))


def sums_over(lists: DataFrame, points: DataFrame, others: int | None = None) -> DataFrame:
    """(qid, w, rs, ds): of the neighbours in lists their number and the sums of the greater of distance and radius, and of
    density; lists (stored, they are read twice); points: (vid, cell, radius, density). With others, only so many neighbours count, and not the query itself."""
    columns = ["qid", "cell", "vid", "d", "n", "before"]
    asked, there = _dealt(lists.select(*columns), points.select("vid", "cell", "radius", "density"))

    def sums(lists: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("vid")
        known, radius, density = (_flat(points.column(c)).to_numpy() for c in ("vid", "radius", "density"))
        row, vid, d, n, before = _long(lists, ["vid", "d", "n", "before"])
        qid = _flat(lists.column("qid")).to_numpy()
        if others is not None:
            n = np.where(vid == qid[row], 0, np.clip(n, 0, np.maximum(others - before, 0)))
        place = np.searchsorted(known, vid)
        total = lambda v: np.bincount(row, n * v, len(qid))
        return pa.table({"qid": qid, "w": total(np.ones(len(n))), "rs": total(np.maximum(d, radius[place])), "ds": total(density[place])})

    lot = ["cell", "lot"]
    each = asked.groupBy(*lot).cogroup(there.groupBy(*lot)).applyInArrow(sums, "qid long, w double, rs double, ds double")
    return each.groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("w", "rs", "ds")]).where("w > 0")
