"""Exact k-nearest-neighbour join over pivot cells.

The rows searched (refs) are dealt into the cells of pivots, a bounded sample of
themselves; a ref's distance to its pivot, the *radius*, is all that the bounds
need.

1. Cells: one pass over the refs counts each cell and keeps its largest, its
   smallest and its k + 1 least radii (a few numbers for each of at most
   ``MAX_PIVOTS`` cells).
2. Reach: by the triangle inequality a ref with radius s is within
   ``d(q, pivot) + s`` of a query, so the k-th least such sum over all cells is
   an upper bound on the query's k-th distance.
3. Home: neighbouring cells make up groups of like size, and a cell larger
   than a group is cut into slices by id hash, so a hot cell fills several
   groups.  A query is first searched in the group of its nearest cell; its
   k-th distance there is its reach from now on.
4. Routing: with that reach it goes to the other groups with a cell that it can
   reach: not beyond the largest or inside the smallest radius, nor behind the
   plane half way between the cell's pivot and the query's own.
5. Search: a group and a block of the queries that go there are one cogrouped
   task.  A group has as many blocks as its queries fill, and its refs are
   copied to those only, so a task takes at most ``TASK_WORK`` products of
   queries, refs and dimensions however large the tables.  Inside, refs and
   queries stand in the leaves of median-split trees; the queries of a leaf
   are compared with the refs of those leaves whose box is within their reach.
6. Merge: the lists, k rows each at most, are ranked per query.

Rows of few dimensions (below ``SCREENED``) have boxes for cells instead, the
leaves of a tree of median splits over a bounded sample: a row finds its box by
a few comparisons, the pass of step 1 keeps the box around each leaf's refs, and
a query goes to the boxes that its reach touches.

In the worst case (no structure to prune by, e.g. uniform directions in many
dimensions) every query visits every group, which is the cost of the plain grid
in :mod:`raresift.operators.knn`; pairs of many dimensions are screened by a
matrix product (euclidean) or in 16-bit steps (manhattan) and only those
that can be among the k best are measured exactly.  Bounds carry a slack for
rounding; ties are told by ref id on distances rounded to ``DIST_DIGITS``, as in
the grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift.session import materialize

DIST_DIGITS = 9
MAX_PIVOTS = 512
#: rows drawn for the splits of boxes: for each box, and at most
SAMPLE_ROWS = 64
MAX_SAMPLE = 32_768
#: rows per core from which tables in few partitions are dealt anew
PART_ROWS = 16_384
#: refs per pivot aimed at in small tables
CELL_ROWS = 48
#: products of queries, refs and dimensions that a task takes at most
TASK_WORK = 1 << 37
#: rows that a task takes at most of either side
TASK_ROWS = 131_072
#: rows in a leaf, and leaves compared at once
LEAF = 32
LEAVES = 128
#: steps that values are rounded to, and dimensions whose sum of steps 16 bits hold
LEVELS, WIDTH = 1023, 64
#: dimensions from which pairs are screened before they are measured
SCREENED = 9


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of ``a`` and ``b``, summed dimension by
    dimension (as an SQL sum of terms would)."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        t = a[:, j, None] - b[None, :, j]
        out += t * t if metric == "euclidean" else np.abs(t)
    return np.sqrt(out) if metric == "euclidean" else out


def slack(reach):
    """What rounding may add to a bound of this size."""
    return 2.0 * 10.0**-DIST_DIGITS + 1e-11 * reach


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _drawn(refs: DataFrame, number: int) -> np.ndarray:
    """At most ``number`` refs, those of the least id hashes."""
    rows = refs.orderBy(F.xxhash64("rid"), "rid").limit(number).select("rx").collect()
    return np.array([r["rx"] for r in rows], np.float64)


def draw_pivots(refs: DataFrame, number: int) -> np.ndarray:
    """At most ``number`` different refs, those of the least id hashes."""
    x = _drawn(refs, number)
    return np.unique(x, axis=0) if len(x) else x.reshape(0, 0)


def _in_parts(rows: DataFrame, id_col: str, number: int, cores: int) -> DataFrame:
    """Many rows in fewer partitions than cores (a table in few files) are dealt
    by id hash, as every pass over them is one task a partition."""
    if number < PART_ROWS * cores or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(2 * cores, F.xxhash64(id_col))


def _assigner(pivots: np.ndarray, metric: str):
    def assign(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, radius = np.empty(len(x), np.int64), np.empty(len(x))
        step = max(16, 32_768 // len(pivots))  # stays in a core's cache
        for a in range(0, len(x), step):
            d = distances(x[a : a + step], pivots, metric)
            cell[a : a + step] = own = d.argmin(1)
            radius[a : a + step] = d[np.arange(len(d)), own]
        return cell, radius

    return assign


class Cells:
    """What is known of the cells: pivots, counts and radii."""

    def __init__(self, pivots: np.ndarray, metric: str, count, least, largest, low):
        self.pivots, self.metric = pivots, metric
        self.count, self.least, self.largest = count, least, largest
        self.low = low  # (cell, k + 1): the least radii, inf where there are fewer
        self.between = distances(pivots, pivots, metric)

    def reach(self, d: np.ndarray, k: int) -> np.ndarray:
        """Upper bound on the k-th distance of queries at ``d`` from the pivots."""
        sums = (d[:, :, None] + self.low[None, :, :]).reshape(len(d), -1)
        if sums.shape[1] < k:
            return np.full(len(d), np.inf)
        return np.partition(sums, k - 1, axis=1)[:, k - 1]

    def reachable(self, d: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """(query, cell): may the cell hold a ref within ``reach``?"""
        limit = (reach + slack(np.where(np.isfinite(reach), reach, 0.0)))[:, None]
        edge = slack(d + self.largest[None, :])
        own = d.argmin(1)
        near = d[np.arange(len(d)), own][:, None]
        gap = self.between[own]
        if self.metric == "euclidean":
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gap > 0, (d * d - near * near) / (2 * gap), 0.0)
        else:
            plane = (d - near) / 2
        ok = (d - self.largest - edge <= limit) & (self.least - d - edge <= limit) & (plane - edge <= limit)
        return ok & (self.count > 0)


    @property
    def number(self) -> int:
        return len(self.pivots)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _assigner(self.pivots, self.metric)(x)[0]

    def within(self, x: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
        """(query, cell): may the cell hold one of the k nearest?  ``reach`` is
        inf where no bound is known yet."""
        d = distances(x, self.pivots, self.metric)
        open_ = np.isinf(reach)  # fewer than k refs at home
        if open_.any():
            reach[open_] = self.reach(d[open_], k)
        return self.reachable(d, reach)


class Boxes:
    """Cells of few dimensions: the leaves of a tree of median splits, with the
    box around each leaf's refs.  A row finds its leaf in a few comparisons, so
    nothing is measured to pivots."""

    def __init__(self, dim, at, left, right, metric: str):
        # nodes: the rows below ``at`` in ``dim`` go left; a child below 0 is leaf -1 - child
        self.dim, self.at, self.left, self.right, self.metric = dim, at, left, right, metric
        self.number = len(dim) + 1
        self.count = np.zeros(self.number, np.int64)
        self.low = self.high = np.empty((self.number, 0))

    @classmethod
    def of(cls, sample: np.ndarray, leaves: int, metric: str) -> "Boxes":
        """Leaves of about the same number of ``sample`` rows; equal rows stay together."""
        nodes, found = [], 0  # (dim, at, left, right)
        open_ = [(np.arange(len(sample)), leaves, -1, 0)]
        while open_:
            rows, n, parent, side = open_.pop()
            x = sample[rows]
            split = None
            if n > 1 and len(rows) > 1:
                for j in np.argsort(x.min(0) - x.max(0), kind="stable").tolist():
                    v = np.sort(x[:, j])
                    if not v[0] < v[-1]:
                        break
                    m = min(max(1, round(len(v) * (n // 2) / n)), len(v) - 1)
                    at = v[m]
                    if not v[0] < at:  # the lowest value fills the lower half
                        at = v[np.searchsorted(v, v[0], "right")]
                    split = j, float(at)
                    break
            if split is None:
                me, found = -1 - found, found + 1
            else:
                me = len(nodes)
                nodes.append([*split, 0, 0])
                below = x[:, split[0]] < split[1]
                open_ += [(rows[~below], n - n // 2, me, 3), (rows[below], n // 2, me, 2)]
            if parent >= 0:
                nodes[parent][side] = me
        cols = list(zip(*nodes)) if nodes else [()] * 4
        return cls(np.array(cols[0], np.int64), np.array(cols[1], np.float64), np.array(cols[2], np.int64), np.array(cols[3], np.int64), metric)

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if self.number == 1:
            return out
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        while len(rows):
            node = np.where(x[rows, self.dim[node]] < self.at[node], self.left[node], self.right[node])
            done = node < 0
            out[rows[done]] = -1 - node[done]
            rows, node = rows[~done], node[~done]
        return out

    def leaf(self, column: str) -> str:
        """SQL text of the leaf of a vector column (:meth:`assign` without Python)."""

        def text(node: int) -> str:
            if node < 0:
                return str(-1 - node)
            at = float(self.at[node])
            value = f"{at!r}D" if math.isfinite(at) else f"CAST('{at}' AS DOUBLE)"
            return f"IF({column}[{self.dim[node]}] < {value}, {text(int(self.left[node]))}, {text(int(self.right[node]))})"

        return text(0) if self.number > 1 else "0"

    def learn(self, refs: DataFrame, d: int) -> "Boxes":
        """Counts and boxes of the leaves, in one pass over the refs."""
        ends = [f(F.col("rx")[j]) for f in (F.min, F.max) for j in range(d)]
        told = refs.groupBy(F.expr(self.leaf("rx")).alias("cell")).agg(F.count(F.lit(1)), *ends)
        self.low, self.high = np.full((self.number, d), np.inf), np.full((self.number, d), -np.inf)
        for r in told.collect():  # one a leaf
            self.count[r[0]], self.low[r[0]], self.high[r[0]] = r[1], r[2 : 2 + d], r[2 + d :]
        return self

    def group(self, column: str, id_col: str, first, slots):
        """The group of a row: its leaf's, or the slice of it that its id falls in."""
        leaf = F.expr(self.leaf(column))
        if (slots == 1).all():
            return leaf.cast("int")
        return (_looked_up(first, leaf) + F.pmod(_spread(id_col), _looked_up(slots, leaf))).cast("int")

    def deal(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :func:`deal`: every leaf is a group, one larger than ``size`` is cut
        into slices by id hash."""
        slots = np.maximum(1, -(-self.count // max(1, size)))
        return np.cumsum(slots) - slots, slots, np.arange(int(slots.sum()))

    def _apart(self, x: np.ndarray, far: bool) -> np.ndarray:
        """(query, cell): distance to the nearest (farthest) point of the box."""
        out = np.zeros((len(x), self.number))
        with np.errstate(invalid="ignore"):
            for j in range(x.shape[1]):
                below, above = self.low[None, :, j] - x[:, j, None], x[:, j, None] - self.high[None, :, j]
                gap = np.maximum(np.abs(below), np.abs(above)) if far else np.maximum(0.0, np.maximum(below, above))
                out += gap * gap if self.metric == "euclidean" else gap
        return np.sqrt(out, out=out) if self.metric == "euclidean" else out

    def within(self, x: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
        """As :meth:`Cells.within`; the k-th ref is no farther than the far
        corners of the nearest boxes that hold k."""
        open_ = np.flatnonzero(np.isinf(reach))
        if len(open_):
            far = np.where(self.count > 0, self._apart(x[open_], True), np.inf)
            order = np.argsort(far, axis=1, kind="stable")
            held = np.cumsum(self.count[order], axis=1) >= k
            last = np.take_along_axis(order, held.argmax(1)[:, None], 1)
            reach[open_] = np.where(held.any(1), np.take_along_axis(far, last, 1)[:, 0], np.inf)
        limit = (reach + slack(np.where(np.isfinite(reach), reach, 0.0)))[:, None]
        near = self._apart(x, False)
        with np.errstate(invalid="ignore"):
            return ~(near - slack(near) > limit) & (self.count > 0)


def _looked_up(values: np.ndarray, at):
    return F.element_at(F.expr(f"array({', '.join(map(str, values.tolist()))})"), at + 1)


def learn_cells(refs: DataFrame, pivots: np.ndarray, metric: str, k: int, counter=None) -> Cells:
    """The cells' counts and radii, in one pass over the refs."""
    assign = _assigner(pivots, metric)

    def run(batches):
        n = len(pivots)
        count, least, largest, low = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n), [np.empty(0)] * n
        for b in batches:
            cell, radius = assign(_matrix(b.column(0)))
            if counter is not None:
                counter.add(len(cell) * n)
            order = np.lexsort((radius, cell))
            cell, radius = cell[order], radius[order]
            at, start, number = np.unique(cell, return_index=True, return_counts=True)
            for c, s, m in zip(at.tolist(), start.tolist(), number.tolist()):
                count[c] += m
                least[c], largest[c] = min(least[c], radius[s]), max(largest[c], radius[s + m - 1])
                low[c] = np.sort(np.concatenate((low[c], radius[s : s + min(m, k + 1)])))[: k + 1]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), pa.array(least[some]), pa.array(largest[some]), pa.array([low[c].tolist() for c in some], pa.list_(pa.float64()))],
            names=["cell", "n", "least", "largest", "low"],
        )

    told = refs.select("rx").mapInArrow(run, "cell int, n long, least double, largest double, low array<double>")
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("low"))), 1, k + 1)
    rows = told.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"), merged.alias("low")).collect()
    n = len(pivots)
    count, least, largest, low = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n), np.full((n, k + 1), np.inf)
    for r in rows:  # one a pivot
        c = r["cell"]
        count[c], least[c], largest[c] = r["n"], r["least"], r["largest"]
        low[c, : len(r["low"])] = r["low"]
    return Cells(pivots, metric, count, least, largest, low)


def deal(cells: Cells, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first slot of each cell, slots of each cell, group of each slot): a slot
    is a cell or a slice of one, no larger than a group."""
    size = max(1, math.ceil(cells.count.sum() / groups))
    slots = np.maximum(1, -(-cells.count // size))
    first = np.cumsum(slots) - slots
    # neighbours stand together: along the direction in which pivots spread most
    middle = cells.pivots - cells.pivots.mean(0)
    axis = np.linalg.svd(middle, full_matrices=False)[2][0] if len(middle) > 1 else np.zeros(cells.pivots.shape[1])
    group_of = np.zeros(int(slots.sum()), np.int64)
    group, room = 0, size
    for c in np.argsort(middle @ axis, kind="stable").tolist():
        each = math.ceil(cells.count[c] / slots[c])
        for s in range(int(slots[c])):
            if each > room and room < size:
                group, room = group + 1, size
            group_of[first[c] + s] = group
            room -= each
    return first, slots, group_of


class Tasks:
    """The tasks of each group: as many as blocks of at most ``rows`` fill."""

    def __init__(self, queries: np.ndarray, rows: int):
        self.blocks = np.where(queries > 0, -(-queries // rows), 0)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.number = int(self.blocks.sum())


def _task_refs(refs: DataFrame, cells: Cells, first, slots, group_of, tasks: Tasks, counter=None) -> DataFrame:
    """The refs of each group, once for each of its tasks ``_t``."""
    if isinstance(cells, Boxes):
        rows = refs.withColumn("_t", cells.group("rx", "rid", first, slots))
        if (tasks.blocks == 1).all():
            return rows
        blocks, start = _looked_up(tasks.blocks, F.col("_t")), _looked_up(tasks.first, F.col("_t"))
        return rows.where(blocks > 0).withColumn("_t", F.explode(F.sequence(start, start + blocks - 1)))
    assign, names = cells.assign, refs.columns
    at = names.index("rx")

    def run(batches):
        for b in batches:
            cell = assign(_matrix(b.column(at)))
            if counter is not None:
                counter.add(len(cell) * cells.number)
            slice_ = b.column(len(names)).to_numpy(zero_copy_only=False) % slots[cell] if len(cell) else cell
            group = group_of[first[cell] + slice_]
            step = max(1, 65_536 // max(1, int(tasks.blocks.max())))
            for a in range(0, len(cell), step):
                own = group[a : a + step]
                copies = tasks.blocks[own]
                row = np.repeat(np.arange(len(own)), copies)
                block = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                take = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(take) for k in range(len(names))), pa.array(tasks.first[own[row]] + block, pa.int32())], names=[*names, "_t"]
                )

    schema = T.StructType([*refs.schema.fields, T.StructField("_t", T.IntegerType())])
    return refs.withColumn("_h", _spread("rid")).mapInArrow(run, schema)


def _spread(column: str):
    return F.pmod(F.xxhash64(column, F.lit(3)), F.lit(1 << 30))


def _homes(cells: Cells, first, slots, group_of, counter):
    """Batch (qid, qx, _h) -> (rows, groups, reaches): a slice of the nearest cell."""
    assign = cells.assign

    def run(b):
        x = _matrix(b.column(1))
        cell = assign(x)
        if counter is not None:
            counter.add(len(x) * cells.number)
        slice_ = b.column(2).to_numpy(zero_copy_only=False) % slots[cell] if len(cell) else cell
        yield np.arange(len(x)), group_of[first[cell] + slice_], np.full(len(x), np.inf)

    return run


def _others(cells: Cells, first, slots, group_of, k: int, counter):
    """Batch (qid, qx, _h, reach, home) -> (rows, groups, reaches): all groups
    within reach but the home group."""
    groups, boxes = int(group_of.max()) + 1, isinstance(cells, Boxes)
    cell_of = np.repeat(np.arange(len(slots)), slots)  # every slot of a box is a group
    holds = np.zeros((0 if boxes else len(cells.count), groups), np.float32)
    for c in range(len(holds)):
        holds[c, group_of[first[c] : first[c] + slots[c]]] = 1

    def run(b):
        x, known = _matrix(b.column(1)), b.column(3).to_numpy(zero_copy_only=False)
        home = b.column(4).to_numpy(zero_copy_only=False)
        if counter is not None:
            counter.add(len(x) * cells.number)
        step = max(1, (1 << 20) // max(len(cells.count) * (k + 1), groups))
        for a in range(0, len(x), step):
            reach = known[a : a + step].copy()
            ok = cells.within(x[a : a + step], reach, k)
            go = ok[:, cell_of] if boxes else (ok.astype(np.float32) @ holds) > 0
            go[np.arange(len(reach)), home[a : a + step]] = False
            row, group = np.nonzero(go)
            yield a + row, group, reach[row]

    return run


def _count_groups(queries: DataFrame, route, groups: int) -> np.ndarray:
    """Queries that go to each group."""

    def run(batches):
        n = np.zeros(groups, np.int64)
        for b in batches:
            for _, group, _ in route(b):
                n += np.bincount(group, minlength=groups)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups), pa.int32()), pa.array(n)], names=["_g", "n"])

    return _counted(queries.mapInArrow(run, "_g int, n long"), groups, F.sum("n"))


def _counted(rows: DataFrame, groups: int, number=None) -> np.ndarray:
    """Rows (or another number) by group ``_g``."""
    out = np.zeros(groups, np.int64)
    for g, n in rows.groupBy("_g").agg(F.count(F.lit(1)) if number is None else number).collect():
        out[g] = n
    return out


def _task_queries(queries: DataFrame, route, tasks: Tasks) -> DataFrame:
    """(qid, qx, _reach, _g, _t): queries by group and block."""

    def run(batches):
        for b in batches:
            h = b.column(2).to_numpy(zero_copy_only=False)
            for row, group, reach in route(b):
                take = pa.array(row)
                task = tasks.first[group] + h[row] % tasks.blocks[group]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(reach), pa.array(group, pa.int32()), pa.array(task, pa.int32())],
                    names=["qid", "qx", "_reach", "_g", "_t"],
                )

    return queries.mapInArrow(run, "qid long, qx array<double>, _reach double, _g int, _t int")


class _Best:
    """The k best refs so far of a block of queries, and their reach."""

    def __init__(self, n: int, k: int, reach: np.ndarray):
        self.k, self.reach = k, reach.copy()
        self.distance = np.full((n, k), np.inf)
        self.rid = np.full((n, k), np.iinfo(np.int64).max)
        self.row = np.full((n, k), -1)

    def limit(self, q: np.ndarray) -> np.ndarray:
        reach = self.reach[q]
        return reach + slack(np.where(np.isfinite(reach), reach, 0.0))

    def offer(self, q: np.ndarray, d: np.ndarray, rows: np.ndarray, rid: np.ndarray) -> None:
        """Pairs at distances ``d`` of queries ``q`` and refs ``rows`` (ids ``rid``)."""
        if not len(q):
            return
        hit, i = np.unique(q, return_inverse=True)
        value = np.concatenate((np.round(d, DIST_DIGITS), self.distance[hit].ravel()))
        ids = np.concatenate((rid, self.rid[hit].ravel()))
        row = np.concatenate((rows, self.row[hit].ravel()))
        of = np.concatenate((i, np.repeat(np.arange(len(hit)), self.k)))
        order = np.lexsort((ids, value, of))
        start = np.searchsorted(of[order], np.arange(len(hit)))
        top = order[start[:, None] + np.arange(self.k)]
        self.distance[hit], self.rid[hit], self.row[hit] = value[top], ids[top], row[top]
        self.reach[hit] = np.minimum(self.reach[hit], self.distance[hit, -1])


def tree(x: np.ndarray, rows: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Row order of a tree that halves the widest dimension, and the ends of its
    leaves; a leaf with more than ``rows`` holds equal points."""
    order, open_, out = np.arange(len(x)), [(0, len(x))] if len(x) else [], []
    while open_:
        a, b = open_.pop()
        own = x[order[a:b]]
        spread = own.max(0) - own.min(0) if b - a > rows else np.zeros(1)
        j = int(spread.argmax())
        if not spread[j] > 0:
            out.append((a, b))
            continue
        m = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, j], m)]
        open_ += [(a + m, b), (a, a + m)]
    return order, out


def _first_ids(order: np.ndarray, ends: list[tuple[int, int]], x: np.ndarray, rid: np.ndarray, k: int, rows: int) -> list[np.ndarray]:
    """The rows of each leaf; of more than ``rows`` equal points only those of the
    k + 1 least ids, as the others lose every tie (one id may be the query's)."""
    out = []
    for a, b in ends:
        own = order[a:b]
        if b - a > rows and (x[own] == x[own[0]]).all():
            own = own[np.argsort(rid[own], kind="stable")]
            new = np.append(0, np.cumsum(rid[own][1:] != rid[own][:-1]))
            own = own[new <= k]
        out.append(own)
    return out


def _near_by_steps(x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, row of y) of all pairs whose sum of absolute differences may be
    within ``limit``.  Values are rounded to whole steps; with |a - b| = a + b -
    2 min(a, b) a dimension takes two passes over 16-bit numbers.  Rounding
    changes a distance by a step a dimension at most."""
    n, d = x.shape
    low = np.minimum(x.min(0), y.min(0))
    step = float((np.maximum(x.max(0), y.max(0)) - low).max()) / LEVELS or 1.0
    a, b = (np.minimum(np.rint((v - low) / step), LEVELS).astype(np.uint16) for v in (x, y))
    # pairs stay where the sum of minima is at least half of this
    need = np.ceil(a.sum(1, dtype=np.int64) - (limit / step + d * (1.0 + 1e-9) + 1.0)).astype(np.int64)
    sums, columns, hits = b.sum(1, dtype=np.int64), np.ascontiguousarray(b.T), []
    for c in range(0, len(y), 512):
        part = columns[:, c : c + 512]
        total, t = np.zeros((n, part.shape[1]), np.int32), np.empty((n, part.shape[1]), np.uint16)
        for m in range(0, d, WIDTH):
            s = np.zeros_like(t)
            for k in range(m, min(d, m + WIDTH)):
                np.minimum(a[:, k, None], part[None, k], out=t)
                s += t
            total += s
        p, q = np.nonzero(2 * total >= need[:, None] + sums[None, c : c + 512])
        hits.append((p, q + c))
    return tuple(np.concatenate(h) for h in zip(*hits))


def _close(x: np.ndarray, y: np.ndarray, metric: str, limit: np.ndarray, k: int | None = None):
    """(row of x, row of y, distance) of the pairs within ``limit`` of x's row;
    with ``k`` only those that can be among the row's k nearest of them."""
    d = x.shape[1]
    top = max(np.abs(x).max(), np.abs(y).max()) if d >= SCREENED else 0.0
    if d < SCREENED or not np.isfinite(limit).all() or not top < 1e15:
        out = distances(x, y, metric)
        if k is not None and len(y) > 2 * k:
            kth = np.partition(out, k - 1, axis=1)[:, k - 1]
            limit = np.minimum(limit, kth + slack(np.where(np.isfinite(kth), kth, 0.0)))
        i, j = np.nonzero((out <= limit[:, None]) & np.isfinite(out))
        return i, j, out[i, j]
    if metric == "euclidean":
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        s = x @ y.T
        s *= -2.0
        s += xx[:, None]
        s += yy[None, :]
        # the product's rounding, well above d units in the last place
        i, j = np.nonzero(s <= (limit * limit + 1e-15 * (d + 8) * 4 * (xx + yy.max()))[:, None])
    else:
        i, j = _near_by_steps(x, y, limit)
    out = np.zeros(len(i))
    for m in range(d):
        t = x[i, m] - y[j, m]
        out += t * t if metric == "euclidean" else np.abs(t)
    if metric == "euclidean":
        np.sqrt(out, out=out)
    near = out <= limit[i]
    return i[near], j[near], out[near]


def search(x: np.ndarray, qid, reach, y: np.ndarray, rid, k: int, metric: str, exclude_self: bool):
    """(query row, ref row, distance) of the k best refs of every query within
    its reach, and the distances taken."""
    best, taken = _Best(len(x), k, reach), 0
    order, ends = tree(y, LEAF)
    parts = _first_ids(order, ends, y, rid, k, LEAF)
    size = np.array([len(p) for p in parts])
    start, order = np.cumsum(size) - size, np.concatenate(parts)
    ys, ids = y[order], rid[order]
    low, high = np.array([y[p].min(0) for p in parts]), np.array([y[p].max(0) for p in parts])
    wide = x.shape[1] >= SCREENED
    # few queries lie far apart: small leaves keep their boxes small
    xo, xends = tree(x, 8 * LEAF if wide else int(np.clip(4 * LEAF * len(x) // len(y), LEAF // 4, 2 * LEAF)))
    for a, b in xends:
        for own in np.array_split(xo[a:b], -(-(b - a) // 256)):
            q = x[own]
            gap = np.maximum(0.0, np.maximum(low - q.max(0), q.min(0) - high))
            far = np.sqrt((gap * gap).sum(1)) if metric == "euclidean" else gap.sum(1)
            turn = np.argsort(far, kind="stable")
            at, step = 0, max(2, -(-(k + 1) // LEAF))
            while at < len(turn):
                limit = best.limit(own)
                some = turn[at : at + step]
                some = some[~(far[some] - slack(far[some]) > limit.max())]
                if not len(some):
                    break
                rows = np.repeat(start[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
                for c in range(0, len(rows), LEAF * LEAVES):
                    part = rows[c : c + LEAF * LEAVES]
                    i, j, d = _close(q, ys[part], metric, best.limit(own), None if exclude_self else k)
                    taken += len(q) * len(part)
                    j = part[j]
                    if exclude_self:
                        other = qid[own[i]] != ids[j]
                        i, j, d = i[other], j[other], d[other]
                    best.offer(own[i], d, order[j], ids[j])
                at, step = at + step, min(4 * step, LEAVES)
    i, j = np.nonzero(best.row >= 0)
    return i, best.row[i, j], best.distance[i, j], best.reach, taken


def _task_search(k: int, metric: str, exclude_self: bool, counter):
    def run(q: pa.Table, r: pa.Table):
        col = lambda t, c: t.column(c).to_numpy()
        reach = col(q, "_reach")
        if not len(q) or not len(r):
            none = np.empty(0, np.int64)
            return none, none, np.empty(0), reach
        i, j, d, reach, taken = search(_matrix(q.column("qx")), col(q, "qid"), reach, _matrix(r.column("rx")), col(r, "rid"), k, metric, exclude_self)
        if counter is not None:
            counter.add(taken)
        return i, j, d, reach

    return run


def _cogrouped(q: DataFrame, r: DataFrame, tasks: Tasks, run, schema) -> DataFrame:
    q, r = q.repartition(tasks.number, "_t"), r.repartition(tasks.number, "_t")
    return q.groupBy("_t").cogroup(r.groupBy("_t")).applyInArrow(run, schema)


def pivot_knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    metric: str,
    exclude_self: bool,
    extra: Sequence[str],
    n_q: int,
    n_refs: int,
    max_queries_per_cell: int,
    max_refs_per_cell: int,
    counter=None,
) -> DataFrame:
    """(qid, rid, distance, extra...): at most k rows per query and group, the k
    nearest of all among them.  ``queries`` has qid, qx; ``refs`` rid, rx and the
    extra columns.  ``counter``: an accumulator for all distances taken,
    those to pivots among them."""
    from pyspark.sql.pandas.types import to_arrow_type

    found = [T.StructField("rid", T.LongType()), T.StructField("distance", T.DoubleType())]
    found += [T.StructField(f.name, f.dataType) for f in refs.schema.fields if f.name in extra]
    schema = T.StructType([T.StructField("qid", T.LongType()), *found])
    spark = queries.sparkSession
    if not n_q or not n_refs:
        return spark.createDataFrame([], schema)
    d = refs.select(F.size("rx").alias("d")).first()["d"]
    wanted = k + 1 if exclude_self else k  # a query may be one of the refs
    side = max(1, min(TASK_ROWS, math.isqrt(TASK_WORK // max(1, d))))
    most_q, most_refs = min(side, max_queries_per_cell), min(side, max_refs_per_cell)
    cores = spark.sparkContext.defaultParallelism
    groups = max(math.ceil(n_refs / most_refs), min(2 * cores, max(1, n_refs // 512)))
    queries, refs = _in_parts(queries, "qid", n_q, cores), _in_parts(refs, "rid", n_refs, cores)
    if 0 < d < SCREENED:
        cells = Boxes.of(_drawn(refs, min(MAX_SAMPLE, SAMPLE_ROWS * groups)), groups, metric).learn(refs, d)
        first, slots, group_of = cells.deal(most_refs)
    else:
        # more pivots spare distances to refs, but each ref is measured to all of them
        cells = learn_cells(refs, draw_pivots(refs, max(1, min(MAX_PIVOTS, n_refs // CELL_ROWS, math.ceil(2 * math.sqrt(n_q))))), metric, k, counter)
        first, slots, group_of = deal(cells, groups)
    groups = int(group_of.max()) + 1

    def tasks_of(rows: DataFrame, route) -> Tasks:
        n = np.full(groups, n_q) if n_q <= most_q else _count_groups(rows, route, groups)
        return Tasks(n, most_q)

    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in found]
    names, kept = [f.name for f in found[2:]], to_arrow_type(T.ArrayType(T.StructType(found)))
    find = _task_search(k, metric, exclude_self, counter)

    def columns(r: pa.Table, j, d):
        take = pa.array(j, pa.int64())
        return [r.column("rid").take(take), pa.array(d), *(r.column(c).take(take) for c in names)]

    def at_home(q: pa.Table, r: pa.Table) -> pa.Table:
        i, j, d, reach = find(q, r)
        lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns(r, j, d)]
        near = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(q) + 1)), pa.int32()), pa.StructArray.from_arrays(lists, names=[f.name for f in fields])).cast(kept)
        return pa.table([q.column("qid"), q.column("qx"), pa.array(reach), q.column("_g"), near], names=["qid", "qx", "_reach", "_g", "_near"])

    def elsewhere(q: pa.Table, r: pa.Table) -> pa.Table:
        i, j, d, _ = find(q, r)
        return pa.Table.from_arrays([q.column("qid").take(pa.array(i, pa.int64())), *columns(r, j, d)], schema=pa.schema([("qid", pa.int64()), *fields]))

    rows = queries.withColumn("_h", _spread("qid"))
    if isinstance(cells, Boxes):
        rows = rows.select("qid", "qx", "_h", F.lit(math.inf).alias("_reach"), cells.group("qx", "qid", first, slots).alias("_g"))
        tasks = Tasks(np.full(groups, n_q) if n_q <= most_q else _counted(rows, groups), most_q)
        at_home_of = rows.select("qid", "qx", "_reach", "_g", (_looked_up(tasks.first, F.col("_g")) + F.col("_h") % _looked_up(tasks.blocks, F.col("_g"))).cast("int").alias("_t"))
    else:
        tasks = tasks_of(rows, _homes(cells, first, slots, group_of, None))
        at_home_of = _task_queries(rows, _homes(cells, first, slots, group_of, counter), tasks)
    home = _cogrouped(
        at_home_of,
        _task_refs(refs, cells, first, slots, group_of, tasks, counter),
        tasks, at_home,
        T.StructType([T.StructField("qid", T.LongType()), T.StructField("qx", T.ArrayType(T.DoubleType())), T.StructField("_reach", T.DoubleType()),
                      T.StructField("_g", T.IntegerType()), T.StructField("_near", T.ArrayType(T.StructType(found)))]),
    )
    if groups == 1:
        return home.select("qid", F.inline("_near"))
    home = materialize(home)  # the reaches decide where each query goes next
    rows = home.select("qid", "qx", _spread("qid").alias("_h"), "_reach", "_g")
    tasks = tasks_of(rows, _others(cells, first, slots, group_of, wanted, None))
    out = home.select("qid", F.inline("_near"))
    if not tasks.number:
        return out
    more = _cogrouped(
        _task_queries(rows, _others(cells, first, slots, group_of, wanted, counter), tasks),
        _task_refs(refs, cells, first, slots, group_of, tasks, counter),
        tasks, elsewhere, schema,
    )
    return out.unionByName(more)
