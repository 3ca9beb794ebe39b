"""Hard-negative mining by threshold joins over an L2-norm pruned inverted index.

Anchors are searched against all rows.  Rows are dealt evenly into shards; each
gets an inverted index over its dimensions (groups of ``GROUP`` of them, those
of the largest sums of squares first).  The list of a group holds its rows in
the order of their suffix norms, the norm of a row from that group on, so for
any threshold the rows that the group must show stand in front and the rest of
the list is left unread: what a row holds from there on is covered by the bound
(suffix norm of the row times suffix norm of the anchor), it cannot lift a pair
over the threshold by itself.

A search adds up partial scores list by list for a block of anchors, drops the
rows whose partial scores plus the remaining norms stay below every anchor's
threshold, and completes the survivors' scores with exact products.  Where an
anchor's window is not full, its threshold is lowered and it is searched again.

1. Positives: every anchor meets its own shard, thresholds falling until it has
   its ``POSITIVES`` best rows of the same label; the last of their scores bounds
   the last one overall from below, so all other shards are joined once, at that
   threshold, and the best of all are merged.
2. Negatives: the same for the windows of scores that the positives span: the own
   shard fills the windows as far as it can, then all others are joined at the
   thresholds found.

Each search returns at most as many rows per anchor and shard as its window
takes, so a hot vector or label makes no more of them.  Shards are dealt round
robin, whatever the rows hold.  Scores are whole numbers (``floor(SCALE * x)``),
exact in double precision; bounds are widened for rounding.

Defined results: rows without an id or a label take no part, nor do those whose
vector is null or holds null or non-finite components; shorter vectors count as
padded with zeros; components beyond ``LIMIT`` count as ``LIMIT``; an anchor is
never its own positive, an equal row is; equal scores are told by the smaller
id, then by shard and place; an anchor without positives or a positive
without negatives gives no rows; rows with one id are rows of their own.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.llm.catalog import register
from raresift.llm.common import materialize, read, release
from raresift.llm.vectors import narrow, whole_numbers

SCALE = 256
LIMIT = 1 << 20
POSITIVES = 5
NEGATIVES = 3
#: a negative's score is at least LOW and at most HIGH hundredths of the positive's
LOW, HIGH = 50, 95
SHARD_ROWS = 50_000
SHARDS = 6
BLOCK = 4096
CELL = 1 << 15
GROUP = 8
STEP = 64
SLACK = 1e-9


class Index:
    """Inverted index of one shard for inner products of at least a threshold."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.ids, self.labels = ids, labels
        self.order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        self.x = narrow(x[:, self.order])
        squares = self.x.astype(np.float64) ** 2
        starts = range(0, x.shape[1], GROUP)
        # norm of each row from each group on (exact sums of whole squares)
        self.norms = [np.sqrt(squares[:, s:].sum(1)) for s in starts]
        self.lists = [np.argsort(-n, kind="stable").astype(np.int32) for n in self.norms]

    def prepare(self) -> None:
        """The lists' values in list order (not stored, made in the task)."""
        if hasattr(self, "values"):
            return
        largest = self.norms[0].max() if len(self.ids) and self.norms else 0.0
        # whole numbers below 2^24 are exact in single precision
        self.kind = np.float32 if largest**2 < 1 << 24 else np.float64
        self.values = [np.ascontiguousarray(self.x[rows, g * GROUP : (g + 1) * GROUP], self.kind) for g, rows in enumerate(self.lists)]
        self.in_order = [n[rows] for n, rows in zip(self.norms, self.lists)]

    def anchors(self, y: np.ndarray) -> np.ndarray:
        """Anchor vectors in the order of the index's dimensions."""
        wide = max(y.shape[1], self.x.shape[1])
        if y.shape[1] < wide:
            y = np.pad(y, ((0, 0), (0, wide - y.shape[1])))
        return y[:, self.order]  # what the shard has no component for adds nothing

    def join(self, y: np.ndarray, threshold: np.ndarray):
        """(anchor, row, score) of all pairs with score >= threshold[anchor]."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        if not len(self.ids) or not len(y):
            return out[0]
        self.prepare()
        squares = y.astype(np.float64) ** 2
        rest = np.stack([np.sqrt(squares[:, g * GROUP :].sum(1)) for g in range(len(self.lists))] + [np.zeros(len(y))], 1)
        # anchors of like thresholds, for their size, share a block
        turn = np.argsort(-threshold / np.maximum(rest[:, 0], 1e-300), kind="stable")
        kind = self.kind if rest[:, 0].max(initial=0.0) ** 2 < 1 << 24 else np.float64
        for a in range(0, len(y), STEP):
            q = turn[a : a + STEP]
            out.append(self._block(y[q], threshold[q], rest[q], q, kind))
        return tuple(np.concatenate(z) for z in zip(*out))

    def _block(self, y: np.ndarray, threshold: np.ndarray, rest: np.ndarray, q: np.ndarray, kind):
        n = len(self.ids)
        score = np.zeros((n, len(q)), kind)
        alive = np.ones(n, bool)
        least = threshold - SLACK * np.abs(threshold) - SLACK
        left = np.zeros(n, np.int64)  # groups that have been added to a row
        for g, rows in enumerate(self.lists):
            # in front of the list: rows that some anchor could still need
            need = (least / np.maximum(rest[:, g], 1e-300)).min()
            front = n if need <= 0 else int(np.searchsorted(-self.in_order[g], -need, side="right"))
            if not front:
                break
            part = y[:, g * GROUP : (g + 1) * GROUP].astype(kind).T
            rows = rows[:front]
            if g and not alive.all():
                live = np.flatnonzero(alive[rows])
                rows, values = rows[live], self.values[g][live]
            else:
                values = self.values[g][:front]
            score[rows] += values.astype(kind, copy=False) @ part
            left[rows] = g + 1
            if need > 0 and g + 1 < len(self.lists):
                # partial scores plus remaining norms
                ahead = (score[rows] + self.norms[g + 1][rows, None] * rest[:, g + 1] * (1 + SLACK) >= least).any(1)
                alive[rows[~ahead]] = False
        norms = np.stack([*self.norms, np.zeros(n)], 1) if self.norms else np.zeros((n, 1))
        over = norms[np.arange(n), left]
        known = np.flatnonzero(alive)
        tail = rest[:, left[known]].T  # the anchor's norm from where the row was left
        i, j = np.nonzero(score[known] + over[known, None] * tail * (1 + SLACK) >= least)
        i = known[i]
        exact = score[i, j].astype(np.int64)
        short = np.flatnonzero(left[i] < len(self.lists))
        for a in range(0, len(short), 1 << 16):
            s = short[a : a + (1 << 16)]
            exact[s] = np.einsum("kd,kd->k", self.x[i[s]].astype(np.int64), y[j[s]])
        good = exact >= threshold[j]
        return q[j[good]], i[good], exact[good]


def best(anchor: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int):
    """The first ``most`` rows of each anchor, by score, id and place."""
    turn = np.lexsort((row, ids[row], -score, anchor))
    anchor, row, score = anchor[turn], row[turn], score[turn]
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.empty(0, np.int64)
    rank = np.arange(len(anchor)) - np.repeat(start, np.diff(np.append(start, len(anchor))))
    keep = rank < most
    return anchor[keep], row[keep], score[keep]


def falling(top: np.ndarray, floor: np.ndarray):
    """Thresholds from ``top`` down: nine tenths, then steps twice as wide each
    time, then ``floor``."""
    share = 0.1
    while share < 1:
        yield np.maximum(np.floor(top - share * np.abs(top)), floor)
        share *= 2
    yield floor


def fill(index: Index, y: np.ndarray, top: np.ndarray, floor: np.ndarray, pick, full, lower: bool):
    """``pick`` of the joined pairs of each anchor; with ``lower`` the thresholds
    fall from ``top`` until ``full`` says that an anchor's window is full."""
    todo, got = np.arange(len(y)), []
    for threshold in falling(top, floor) if lower else [floor]:
        if not len(todo):
            break
        i, row, score = index.join(y[todo], threshold[todo])
        picked = pick(todo[i], row, score)
        done = (threshold[todo] <= floor[todo]) | full(picked, todo)
        got.append(tuple(c[np.isin(picked[0], todo[done])] for c in picked))
        todo = todo[~done]
    if not got:
        none = np.empty(0, np.int64)
        return pick(none, none, none)
    return tuple(np.concatenate(c) for c in zip(*got))


LOWEST = np.int64(-(1 << 62))


def positives_of(index: Index, y, labels, place, floor, most: int, lower: bool):
    """(anchor, row, score): each anchor's best other rows of its label.
    ``place`` is the anchor's row in this shard, -1 in another."""
    y = index.anchors(y)

    def pick(i, row, score):
        own = (index.labels[row] == labels[i]) & (row != place[i])
        return best(i[own], row[own], score[own], index.ids, most)

    def full(picked, todo):
        return np.isin(todo, np.flatnonzero(np.bincount(picked[0], minlength=len(y)) >= most))

    top = (y.astype(np.int64) ** 2).sum(1)
    return fill(index, y, top.astype(np.float64), floor.astype(np.float64), pick, full, lower)


def negatives_of(index: Index, y, labels, window, low, high, most: int, lower: bool):
    """(window, row, score): for each window of scores low..high of an anchor,
    the best rows of other labels.  ``window[w]`` is the anchor of window w."""
    y = index.anchors(y)
    floor = np.full(len(y), np.inf)
    np.minimum.at(floor, window, low)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, window, high)
    some = np.flatnonzero(np.isfinite(floor))
    at = np.zeros(len(y), np.int64)
    at[some] = np.arange(len(some))
    by_anchor = np.argsort(window, kind="stable")
    first = np.searchsorted(window[by_anchor], np.arange(len(y) + 1))

    def pick(i, row, score):
        anchor = some[i]
        other = index.labels[row] != labels[anchor]
        i, row, score, anchor = i[other], row[other], score[other], anchor[other]
        out = [(np.empty(0, np.int64),) * 4]
        for k in range(int(np.diff(first).max(initial=0))):  # the k-th window of each anchor
            has = first[anchor] + k < first[anchor + 1]
            w = by_anchor[np.minimum(first[anchor] + k, len(by_anchor) - 1)]
            fits = has & (score >= low[w]) & (score <= high[w])
            w, r, s = best(w[fits], row[fits], score[fits], index.ids, most)
            out.append((at[window[w]], r, s, w))
        return tuple(np.concatenate(c) for c in zip(*out))

    def full(picked, todo):
        number = np.bincount(picked[3], minlength=len(window))
        short = np.zeros(len(some), bool)
        np.logical_or.at(short, at[window], number < most)
        return ~short[todo]

    i, row, score, w = fill(index, y[some], top[some], floor[some], pick, full, lower)
    return w, row, score


def _rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).cast("long").alias("label"), anchor.alias("anchor")).where(
        "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"
    )


def _indexed(rows: DataFrame, shards: int, positives: int) -> DataFrame:
    """One row per shard and block of its anchors: (shard, index, anchors,
    bound).  The index stands in the first row of a shard alone; ``bound`` is
    each anchor's last positive of its own shard."""

    def run(batches):
        from pyspark import TaskContext

        got = []
        for b in batches:
            whole, x = whole_numbers(b.column(1), SCALE, LIMIT)
            id_, label, anchor = (b.column(k).to_numpy(zero_copy_only=False)[whole] for k in (0, 2, 3))
            got.append((narrow(x), id_, label, anchor.astype(bool)))
        if not sum(len(g[0]) for g in got):
            return
        wide = max(g[0].shape[1] for g in got)
        x = np.concatenate([np.pad(g[0], ((0, 0), (0, wide - g[0].shape[1]))) for g in got])
        ids, labels, anchor = (np.concatenate([g[k] for g in got]) for k in (1, 2, 3))
        index = Index(x, ids, labels)
        blob = pickle.dumps(index)
        index.prepare()
        shard = TaskContext.get().partitionId()
        place = np.flatnonzero(anchor)
        for a in range(0, max(1, len(place)), BLOCK):
            own = place[a : a + BLOCK]
            y, floor = x[own].astype(np.int64), np.full(len(own), LOWEST)
            i, _, score = positives_of(index, y, labels[own], own, floor, positives, True)
            bound = floor.copy()
            for k, s in zip(i.tolist(), score.tolist()):
                bound[k] = s if bound[k] == LOWEST else min(bound[k], s)
            bound[np.bincount(i, minlength=len(own)) < positives] = LOWEST
            mine = pickle.dumps((narrow(y), ids[own], labels[own], own, bound)) if len(own) else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([a // BLOCK], pa.int32()), pa.array([None if a else blob], pa.binary()), pa.array([mine], pa.binary())],
                names=["shard", "block", "index", "anchors"],
            )

    return rows.repartition(shards).mapInArrow(run, "shard int, block int, index binary, anchors binary")


_FOUND = "home int, place long, rank int, shard int, row long, id long, score long"


def _table(**cols) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in cols.items()})


def _found(home, place, rank, shard, row, ids, score) -> pa.Table:
    return _table(
        home=(home, pa.int32()), place=(place, pa.int64()), rank=(rank, pa.int32()), shard=(np.full(len(row), shard), pa.int32()),
        row=(row, pa.int64()), id=(ids, pa.int64()), score=(score, pa.int64()),
    )


def _none() -> pa.Table:
    e = np.empty(0, np.int64)
    return _found(e, e, e, 0, e, e, e)


def _search_positives(most: int):
    """A shard's index against one block of another shard's anchors."""

    def run(key, left, right):
        if not len(left) or not len(right):
            return _none()
        index, out = pickle.loads(left.column("index")[0].as_py()), []
        shard = key[0].as_py()
        for home, blob in zip(right.column("home").to_pylist(), right.column("anchors").to_pylist()):
            y, _, labels, place, bound = pickle.loads(blob)
            own = place if home == shard else np.full(len(place), -1)
            i, row, score = positives_of(index, y.astype(np.int64), labels, own, bound, most, False)
            out.append(_found(np.full(len(i), home), place[i], np.zeros(len(i), np.int64), shard, row, index.ids[row], score))
        return pa.concat_tables(out)

    return run


def _search_negatives(most: int, lower: bool):
    """A shard's index against blocks of anchors with their windows."""

    def run(key, left, right):
        if not len(left) or not len(right):
            return _none()
        index, out = pickle.loads(left.column("index")[0].as_py()), []
        shard = key[0].as_py()
        for home, blob, windows in zip(*(right.column(c).to_pylist() for c in ("home", "anchors", "windows"))):
            y, _, labels, place, _ = pickle.loads(blob)
            at = {p: k for k, p in enumerate(place.tolist())}
            window = np.array([at[w["place"]] for w in windows], np.int64)
            rank = np.array([w["rank"] for w in windows], np.int64)
            low, high = (np.array([w[c] for w in windows], np.float64) for c in ("low", "high"))
            w, row, score = negatives_of(index, y.astype(np.int64), labels, window, low, high, most, lower)
            out.append(_found(np.full(len(w), home), place[window[w]], rank[w], shard, row, index.ids[row], score))
        return pa.concat_tables(out)

    return run


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each (home, place, rank), numbered from 1.  Every
    shard has sent at most ``most`` rows for each."""
    from pyspark.sql import Window

    w = Window.partitionBy("home", "place", "rank").orderBy(F.desc("score"), "id", "shard", "row")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score: the first ``negatives`` rows of other labels for each of the
    first ``positives`` rows of the label of every row that ``anchor`` marks."""
    rows = _rows(vectors, id_col, vec_col, label_col, anchor)
    n, wanted = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1))).first()
    shards = max(SHARDS, -(-n // SHARD_ROWS))
    cells = max(1, -(-wanted // CELL))
    built = materialize(_indexed(rows, shards, positives))
    index = built.where("index IS NOT NULL").select("shard", "index")
    anchors = built.where("anchors IS NOT NULL").select(F.col("shard").alias("home"), "block", "anchors")

    def everywhere(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Every shard beside every block of anchors, about ``CELL`` of them a task."""
        cell = F.pmod(F.xxhash64("home", "block"), F.lit(cells)).cast("int")
        left = index.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        right = df.withColumn("cell", cell).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return left.groupBy("shard", "cell"), right.groupBy("shard", "cell")

    left, right = everywhere(anchors)
    best_rows = _merged(left.cogroup(right).applyInArrow(_search_positives(positives), _FOUND), positives)
    best_rows = materialize(best_rows.select("home", "place", F.col("n").cast("int").alias("rank"), "id", "score"))
    release(vectors.sparkSession)

    # low * positive <= 100 * negative <= high * positive, in whole numbers
    spans = best_rows.select("home", "place", "rank", (F.col("score") * low).alias("lo"), (F.col("score") * high).alias("hi"))
    spans = spans.selectExpr("home", "place", "rank", "(lo + pmod(-lo, 100L)) div 100 AS low", "(hi - pmod(hi, 100L)) div 100 AS high").where("low <= high")
    known = anchors.join(_numbered(built), ["home", "block"]).select("home", "block", "place")
    spans = spans.join(known, ["home", "place"])

    def windows(df: DataFrame) -> DataFrame:
        packed = df.groupBy("home", "block").agg(F.collect_list(F.struct("place", "rank", "low", "high")).alias("windows"))
        return anchors.join(packed, ["home", "block"])

    own = windows(spans).withColumn("shard", F.col("home"))
    local = index.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(_search_negatives(negatives, True), _FOUND)
    last = local.groupBy("home", "place", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).where(F.col("n") >= negatives)
    raised = spans.join(last.drop("n"), ["home", "place", "rank"], "left").withColumn("low", F.greatest("low", F.coalesce("last", "low")))
    raised = materialize(windows(raised))
    left, right = everywhere(raised)
    chosen = _merged(left.cogroup(right).applyInArrow(_search_negatives(negatives, False), _FOUND), negatives)
    chosen = chosen.select("home", "place", F.col("rank").alias("of"), F.col("n").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best_rows.select("home", "place", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = chosen.join(named, ["home", "place", "of"]).join(_numbered(built), ["home", "place"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _numbered(built: DataFrame) -> DataFrame:
    """(home, block, place, anchor id) of every anchor."""

    def run(batches):
        for b in batches:
            for shard, block, blob in zip(*(c.to_pylist() for c in b.columns)):
                _, ids, _, place, _ = pickle.loads(blob)
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * k, pa.int32()), pa.array([block] * k, pa.int32()), pa.array(place, pa.int64()), pa.array(ids, pa.int64())],
                    names=["home", "block", "place", "anchor"],
                )

    return built.where("anchors IS NOT NULL").select("shard", "block", "anchors").mapInArrow(run, "home int, block int, place long, anchor long")


ORACLE_SQL = f"""
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS MATERIALIZED (
  SELECT * FROM (SELECT anchor_id, other AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM s WHERE same) x WHERE n <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score) x
WHERE rank <= {NEGATIVES}
"""


@register("op13_hardneg", ORACLE_SQL)
def op13_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, a seventh of them relabelled."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(v.withColumn("label", label), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
