"""Second-order histogram boosting (inventory F5).

Trees for the log-loss, grown level by level on binned features:

- **Bins**: cut points of every feature from one mergeable quantile sketch
  (``percentile_approx``, one aggregate for all features), at most ``maxBins``
  of them; a value goes left of a cut when it is smaller.  NaN has a bin of its
  own and goes to the side where it gains more.
- **Rows** are kept as blocks (one per Arrow batch: a byte per feature, label,
  weight, key, margin) in the checkpoint folder.  Margins are brought up to date
  there every ``REPLAY`` trees, the trees since are replayed in the tasks, which
  is a few array look-ups per tree.
- **A level** is one job: every task adds up gradients and hessians by (node,
  feature, bin), Spark sums them (partial sums first), a window over the bins of
  a (node, feature) gives the gain of every split, and the best split of each
  node (at most 2^depth rows) reaches the driver.
- Gradients and hessians are whole multiples of 2^-24, so sums do not depend on
  their order: a model is the same under any partitioning and after retries.
- **Gain** = (GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda)) / 2 - gamma,
  leaf = -stepSize * G/(H+lambda); ties go to the first feature, then the
  smallest cut, then missing values to the right.
- Rows of a tree are drawn by hash of (seed, tree, row id), its features by a
  seeded permutation.
- **Early stopping** looks at the validation rows handed over (the fold's, see
  ``with_validation``): their unweighted log-loss is added up in the first level
  job of the next tree; ``stale`` rounds without a smaller one end the fit and
  the trees up to the best one stay.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.session import materialize

REPLAY = 16
MISSING = 255
UNIT = 1 << 24  # gradients are whole multiples of 1 / UNIT
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Tree:
    """Nodes numbered 1, 2 i, 2 i + 1; ``feature`` is -1 in a leaf."""

    def __init__(self, size: int):
        self.feature = np.full(size, -1, np.int32)
        self.bin = np.zeros(size, np.int32)  # largest bin that goes left
        self.missing_left = np.zeros(size, bool)
        self.value = np.zeros(size)
        self.gain = np.zeros(size)

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The node that each binned row has come to."""
        at = np.ones(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            here = at[rows]
            rows, here = rows[self.feature[here] >= 0], here[self.feature[here] >= 0]
            if not len(rows):
                break
            b = bins[rows, self.feature[here]]
            left = np.where(b == MISSING, self.missing_left[here], b <= self.bin[here])
            at[rows] = 2 * here + ~left
        return at

    def grown(self, size: int) -> "Tree":
        if size <= len(self.feature):
            return self
        out = Tree(size)
        for name in ("feature", "bin", "missing_left", "value", "gain"):
            getattr(out, name)[: len(self.feature)] = getattr(self, name)
        return out


def learn_cuts(rows: DataFrame, features: int, max_bins: int) -> list[np.ndarray]:
    """Cut points of each feature of ``rows`` (x array<double>), one aggregate."""
    if not features:
        return []
    shares = [i / max_bins for i in range(1, max_bins)]
    sketch = [F.percentile_approx(F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]), shares, 10_000).alias(f"q{i}") for i in range(features)]
    found = rows.agg(*sketch).first()
    return [np.unique(np.array(found[i] or [], np.float64)) for i in range(features)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(c, x[:, j], side="right"))
    return out


def drawn(key: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """The rows of a tree, by hash of (seed, tree, key)."""
    if share >= 1:
        return np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) ^ (np.uint64(seed & 0xFFFFFFFF) * _MIX[0] + np.uint64(tree + 1) * _MIX[2])
        h = (h ^ (h >> np.uint64(30))) * _MIX[1]
        h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return (h ^ (h >> np.uint64(31))) < np.uint64(int(share * (2.0**64 - 2048)))


_BLOCK = "n int, bins binary, y binary, w binary, key binary, valid boolean, margin binary"


def _to_blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """rows: x array<double>, y, w double, key long, valid boolean."""

    def run(batches):
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.float64).reshape(b.num_rows, len(cuts))
            y, w, key, valid = (b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
            for v in (False, True):
                own = valid.astype(bool) == v
                if own.any():
                    cols = [binned(x[own], cuts), y[own].astype(np.int8), w[own].astype(np.float64), key[own].astype(np.int64)]
                    blobs = [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (*cols, np.zeros(int(own.sum())))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(own.sum())], pa.int32()), *blobs[:4], pa.array([v]), blobs[4]], names=["n", "bins", "y", "w", "key", "valid", "margin"]
                    )

    return rows.mapInArrow(run, _BLOCK)


def _opened(row: dict, features: int):
    return (
        np.frombuffer(row["bins"], np.uint8).reshape(row["n"], features),
        np.frombuffer(row["y"], np.int8),
        np.frombuffer(row["w"], np.float64),
        np.frombuffer(row["key"], np.int64),
        np.frombuffer(row["margin"], np.float64),
    )


def _replayed(blocks: DataFrame, trees: Sequence[Tree], features: int) -> DataFrame:
    """The blocks with the trees added to their margins."""
    names = blocks.columns

    def run(batches):
        for b in batches:
            for k, row in enumerate(b.to_pylist()):
                bins, _, _, _, margin = _opened(row, features)
                margin = margin.copy()
                for t in trees:
                    margin += t.value[t.node(bins)]
                own = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in range(len(names) - 1)), pa.array([margin.tobytes()], pa.binary())], names=names)

    return blocks.mapInArrow(run, _BLOCK)


def _histograms(blocks: DataFrame, since: Sequence[Tree], tree: Tree, active: np.ndarray, chosen: np.ndarray, features: int, seed: int, number: int, share: float, first: bool):
    """(node, feature, bin, g, h) of the training rows in the active nodes; in
    the first level also a row (-1, -1, -1) with the validation log-loss and count."""
    place = np.full(len(tree.feature), -1, np.int64)
    place[active] = np.arange(len(active))

    def summed(parts):
        key, where = np.unique(np.concatenate([q[0] for q in parts]), return_inverse=True)
        total = np.zeros((2, len(key)), np.int64)
        for k in range(2):
            np.add.at(total[k], where, np.concatenate([q[1 + k] for q in parts]))
        return key, *total

    def run(batches):
        parts, held, loss, measured = [], 0, 0, 0
        for b in batches:
            for row in b.to_pylist():
                if row["valid"] and not first:
                    continue
                bins, y, w, key, margin = _opened(row, features)
                margin = margin.copy()
                for t in since:
                    margin += t.value[t.node(bins)]
                p = 1 / (1 + np.exp(-margin))
                if row["valid"]:
                    q = np.where(y > 0, p, 1 - p).clip(1e-15, 1)
                    loss, measured = loss + int(np.rint(-np.log(q) * UNIT).sum()), measured + len(y)
                    continue
                use = np.flatnonzero(drawn(key, seed, number, share))
                at = place[tree.node(bins[use])]
                use, at = use[at >= 0], at[at >= 0]
                g = np.rint(w[use] * (p[use] - y[use]) * UNIT)
                h = np.rint(w[use] * np.maximum(p[use] * (1 - p[use]), 1e-16) * UNIT)
                for k, f in enumerate(chosen.tolist()):
                    spot, where = np.unique((at * len(chosen) + k) * 256 + bins[use, f], return_inverse=True)
                    parts.append((spot, np.bincount(where, g, len(spot)).astype(np.int64), np.bincount(where, h, len(spot)).astype(np.int64)))
                    held += len(spot)
                if held > 1 << 20:
                    parts, held = [summed(parts)], 0
        if measured:
            yield _rows([[-1], [-1], [-1], [loss], [measured]])
        if parts:
            key, g, h = summed(parts)
            node, rest = np.divmod(key, len(chosen) * 256)
            yield _rows([active[node], chosen[rest >> 8], rest & 255, g, h])

    return blocks.mapInArrow(run, "node int, feature int, bin int, g long, h long")


def _rows(cols) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["node", "feature", "bin", "g", "h"])


def best_splits(histograms: DataFrame, reg_lambda: float, gamma: float, min_child: float) -> DataFrame:
    """The best split of each node: (node, g, h, gain, feature, bin, ml, gl, hl),
    ml = 1 where missing values go left; gain is null where nothing splits.
    Nodes below 0 pass through with their sums.  One exchange by (node, feature)
    serves the sums and the running sums over the bins."""
    half = lambda g, h: f"({g} / {UNIT}D) * ({g} / {UNIT}D) / ({h} / {UNIT}D + {float(reg_lambda)!r}D)"
    least = float(min_child) * UNIT
    return histograms.sparkSession.sql(
        f"""
        WITH sums AS (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h FROM (SELECT /*+ REPARTITION(node, feature) */ * FROM {{rows}}) GROUP BY node, feature, bin),
        running AS (
          SELECT node, feature, bin, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(g) OVER whole AS g, sum(h) OVER whole AS h,
                 sum(if(bin = {MISSING}, g, 0)) OVER whole AS gm, sum(if(bin = {MISSING}, h, 0)) OVER whole AS hm
          FROM sums WINDOW whole AS (PARTITION BY node, feature), upto AS (PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
        sided AS (SELECT node, feature, bin, g, h, ml, gl + ml * gm AS gl, hl + ml * hm AS hl FROM running LATERAL VIEW explode(array(0, 1)) AS ml),
        rated AS (
          SELECT *, CASE WHEN node >= 0 AND bin <> {MISSING} AND hl > 0 AND h > hl AND hl >= {least!r}D AND h - hl >= {least!r}D
                    THEN 0.5D * ({half("gl", "hl")} + {half("(g - gl)", "(h - hl)")} - {half("g", "h")}) - {float(gamma)!r}D END AS gain FROM sided)
        SELECT node, first(g) AS g, first(h) AS h,
               max_by(struct(gain, feature, bin, ml, gl, hl), CASE WHEN gain IS NOT NULL THEN struct(gain, -feature, -bin, -ml) END) AS t
        FROM rated GROUP BY node
        """,
        rows=histograms,
    ).select("node", "g", "h", "t.*")


def grow(blocks: DataFrame, since: Sequence[Tree], number: int, features: int, p: dict) -> tuple[Tree, float | None]:
    """One tree, and the validation log-loss before it (None without rows)."""
    rng = np.random.default_rng([p["seed"], number])
    chosen = np.sort(rng.permutation(features)[: max(1, round(features * p["colsample"]))])
    tree, active, loss = Tree(2), np.array([1]), None
    for level in range(p["max_depth"]):
        tree = tree.grown(2 ** (level + 2))
        found = best_splits(
            _histograms(blocks, since, tree, active, chosen, features, p["seed"], number, p["subsample"], level == 0),
            p["reg_lambda"], p["gamma"], p["min_child"],
        ).collect()
        nodes = []
        for r in sorted(found, key=lambda r: r["node"]):
            if r["node"] < 0:
                loss = r["g"] / UNIT / r["h"]
                continue
            i, g, h = r["node"], r["g"] / UNIT, r["h"] / UNIT
            tree.value[i] = -p["step"] * g / (h + p["reg_lambda"])
            if r["gain"] is None or r["gain"] <= 1e-9:
                continue
            tree.feature[i], tree.bin[i], tree.missing_left[i], tree.gain[i] = r["feature"], r["bin"], bool(r["ml"]), r["gain"]
            gl, hl = r["gl"] / UNIT, r["hl"] / UNIT
            tree.value[2 * i] = -p["step"] * gl / (hl + p["reg_lambda"])
            tree.value[2 * i + 1] = -p["step"] * (g - gl) / (h - hl + p["reg_lambda"])
            nodes += [2 * i, 2 * i + 1]
        if not nodes:
            break
        active = np.array(nodes)
    return tree, loss


def validation_loss(blocks: DataFrame, since: Sequence[Tree], features: int) -> float | None:
    rows = _histograms(blocks.where("valid"), since, Tree(2), np.array([], np.int64), np.array([], np.int64), features, 0, 0, 1.0, True)
    r = rows.agg(F.sum("g"), F.sum("h")).first()
    return r[0] / UNIT / r[1] if r[1] else None


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    posWeight = Param(Params._dummy(), "posWeight", "weight of positives", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "most rounds with validation rows", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "rounds without validation rows", TypeConverters.toInt)
    stale = Param(Params._dummy(), "stale", "rounds without a smaller validation loss", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature (at most 255)", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows per tree", TypeConverters.toFloat)
    featureSubset = Param(Params._dummy(), "featureSubset", "share of the features per tree", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty of leaf values", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least gain of a split", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian of a child", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of row and feature draws", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "unique row id", TypeConverters.toString)


class HistogramBoostingModel(Model, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Trees and cut points as one JSON parameter; scores in Arrow batches."""

    trees = Param(Params._dummy(), "trees", "cut points and trees as JSON", TypeConverters.toString)

    def __init__(self, trees: Sequence[Tree] = (), cuts: Sequence[np.ndarray] = ()):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="Class", predictionCol="prediction")
        text = {"cuts": [list(map(float, c)) for c in cuts], "trees": [[[int(i), int(t.feature[i]), int(t.bin[i]), int(t.missing_left[i]), float(t.value[i]), float(t.gain[i])] for i in np.flatnonzero((t.feature >= 0) | (t.value != 0))] for t in trees]}
        self._set(trees=json.dumps(text))

    def opened(self) -> tuple[list[Tree], list[np.ndarray]]:
        text = json.loads(self.getOrDefault(self.trees))
        trees = []
        for rows in text["trees"]:
            t = Tree(1 << (max([1, *(r[0] for r in rows)]).bit_length()))
            for i, f, b, m, v, g in rows:
                t.feature[i], t.bin[i], t.missing_left[i], t.value[i], t.gain[i] = f, b, bool(m), v, g
            trees.append(t)
        return trees, [np.array(c, np.float64) for c in text["cuts"]]

    def tree_table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, cut, missing_left, value, gain): splits have a
        cut (smaller values go left), leaves a value."""
        trees, cuts = self.opened()
        rows = []
        for k, t in enumerate(trees):
            for i in np.flatnonzero((t.feature >= 0) | (t.value != 0)).tolist():
                if t.feature[i] < 0:
                    rows.append((k, i, None, None, None, float(t.value[i]), None))
                    continue
                own = cuts[t.feature[i]]
                cut = float(own[t.bin[i]]) if t.bin[i] < len(own) else float("inf")  # all values, missing ones apart
                rows.append((k, i, int(t.feature[i]), cut, bool(t.missing_left[i]), None, float(t.gain[i])))
        return spark.createDataFrame(rows, "tree int, node int, feature int, cut double, missing_left boolean, value double, gain double")

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, cuts = self.opened()

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            bins = binned(np.array(x.tolist(), np.float64).reshape(len(x), len(cuts)), cuts)
            return pd.Series(sum((t.value[t.node(bins)] for t in trees), np.zeros(len(x))))

        m = F.col("_margin")
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
        out = df.withColumn("_margin", margin(vector_to_array(F.col(self.getFeaturesCol()))))
        return (
            out.withColumn("rawPrediction", array_to_vector(F.array(-m, m)))
            .withColumn("probability", array_to_vector(F.array(1 - p1, p1)))
            .withColumn(self.getPredictionCol(), (p1 > 0.5).cast("double"))
            .drop("_margin")
        )


class HistogramBoosting(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """F5 (see the module).  ``validation`` (set by :func:`with_validation`) are
    rows with features and label on which the fit stops, at most ``maxIter``
    rounds; without them it makes ``rounds`` trees.  ``cuts`` fixes cut points."""

    validation: DataFrame | None = None

    @keyword_only
    def __init__(self, posWeight=1.0, maxIter=5000, rounds=100, stale=50, maxDepth=6, maxBins=255, stepSize=0.3, subsamplingRate=1.0, featureSubset=1.0,
                 regLambda=1.0, gamma=0.0, minChildWeight=1.0, seed=42, labelCol="Class", featuresCol="features", idCol="row_id"):
        super().__init__()
        self._setDefault(posWeight=1.0, maxIter=5000, rounds=100, stale=50, maxDepth=6, maxBins=255, stepSize=0.3, subsamplingRate=1.0, featureSubset=1.0,
                         regLambda=1.0, gamma=0.0, minChildWeight=1.0, seed=42, labelCol="Class", featuresCol="features", idCol="row_id", predictionCol="prediction")
        self.cuts = None
        self._set(**self._input_kwargs)

    def _rows(self, df: DataFrame, valid: bool) -> DataFrame:
        idc, label = self.getOrDefault(self.idCol), F.col(self.getLabelCol()).cast("int")
        keys = [c for c in (idc, "syn_seq") if c in df.columns]  # rows made from one source share its id
        x = vector_to_array(F.col(self.getFeaturesCol()))
        key = F.xxhash64(*keys) if keys else F.xxhash64(x)
        weight = F.when(label > 0, F.lit(self.getOrDefault(self.posWeight))).otherwise(F.lit(1.0))
        return df.select(x.alias("x"), label.alias("y"), weight.alias("w"), key.alias("key"), F.lit(valid).alias("valid"))

    def _fit(self, df: DataFrame) -> HistogramBoostingModel:
        get = self.getOrDefault
        rows = self._rows(df, False)
        p = {"seed": get(self.seed), "colsample": get(self.featureSubset), "subsample": get(self.subsamplingRate), "max_depth": get(self.maxDepth),
             "reg_lambda": get(self.regLambda), "gamma": get(self.gamma), "min_child": get(self.minChildWeight), "step": get(self.stepSize)}
        cuts = self.cuts
        if cuts is None:
            features = rows.select(F.max(F.size("x"))).first()[0] or 0
            cuts = learn_cuts(rows, features, min(255, get(self.maxBins)))
        cuts = [np.asarray(c, np.float64) for c in cuts]
        stops = self.validation is not None
        both = rows.unionByName(self._rows(self.validation, True)) if stops else rows
        blocks = materialize(_to_blocks(both, cuts))
        trees, since, losses = [], [], []
        for k in range(get(self.maxIter) if stops else get(self.rounds)):
            tree, loss = grow(blocks, since, k, len(cuts), p)
            if loss is not None:
                losses.append(loss)  # after the k trees before this one
                if len(losses) - 1 - int(np.argmin(losses)) >= get(self.stale):
                    break
            if not (tree.feature >= 0).any() and not tree.value.any():
                break
            trees.append(tree)
            since.append(tree)
            if len(since) == REPLAY:
                blocks, since = materialize(_replayed(blocks, since, len(cuts))), []
        if losses:
            if len(losses) == len(trees):  # not yet measured after the last tree
                losses.append(validation_loss(blocks, since, len(cuts)))
            trees = trees[: int(np.argmin(losses))] or trees[:1]
        model = HistogramBoostingModel(trees, cuts)
        model._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol())
        return model


def with_validation(estimator, rows: DataFrame):
    """``estimator`` with ``rows`` handed to the boosting stage it may contain
    (through pipelines and wrappers with an ``inner``); others stay as they are."""
    if isinstance(estimator, HistogramBoosting):
        out = estimator.copy()
        out.validation = rows
        return out
    if isinstance(estimator, Pipeline):
        stages = []
        for s in estimator.getStages():
            new = with_validation(s, rows)
            if new is s and isinstance(s, Transformer):
                rows = s.transform(rows)
            stages.append(new)
        return Pipeline(stages=stages) if any(a is not b for a, b in zip(stages, estimator.getStages())) else estimator
    inner = getattr(estimator, "inner", None)
    if inner is not None:
        new = with_validation(inner, rows)
        if new is not inner:
            out = estimator.copy()
            out.inner = new
            return out
    return estimator
