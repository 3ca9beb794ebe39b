"""Classifiers: fit and score (inventory F1-F6) on ``pyspark.ml``.

Every model is a ``Pipeline(VectorAssembler, estimator)`` so the fitted
``PipelineModel`` carries its feature list, can be saved/loaded as a directory
(A7) and scores a batch or a streaming DataFrame alike (F6).  Scores are the
class-1 probability (B8) or, for models without one, the sigmoid of the margin
(B9).

Deviations from the reference's libraries, stated:
- logistic regression: sklearn sums the losses, Spark averages them, so
  ``regParam = 1 / (C * sum of weights)``; no standardisation (as sklearn);
  ``PenalisedLogistic`` takes that sum from the rows it is fitted on;
- Spark trees are at most 30 deep; deeper requests raise;
- mini-batch SGD is one pass per step; a mini-batch is the rows whose hash of
  (seed, step, id) is below the fraction, so it does not depend on partitioning;
- boosting stops early on a validation indicator column, like the reference's
  50-stale-rounds rule on a validation fold.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.functions.hashing import uniform
from raresift.operators.knn import KNNClassifier
from raresift.operators.networks import gradient
from raresift.operators.stats import balanced_class_weight, positive_weight

MAX_TREE_DEPTH = 30
SCHEDULES = ("invscaling", "constant", "optimal", "adaptive")
PATIENCE, TOLERANCE = 5, 1e-4


def assembler(features: Sequence[str], out_col: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out_col, handleInvalid="keep")


def checked_depth(depth: int) -> int:
    if int(depth) > MAX_TREE_DEPTH:
        raise ValueError(f"Spark trees are at most {MAX_TREE_DEPTH} deep, not {depth}")
    return int(depth)


def random_forest(
    label_col: str = "Class", num_trees: int = 100, max_depth: int = 5, max_bins: int = 32,
    weight_col: str | None = None, seed: int = 42, **params,
) -> RandomForestClassifier:
    """F1.  CPU defaults of the reference: 100 trees, balanced class weights
    (pass ``weight_col`` from :func:`stats.balanced_class_weight`); GPU: 200
    trees, depth 15, 128 bins.  Spark's deepest tree has depth 30."""
    kw = dict(
        labelCol=label_col, numTrees=num_trees, maxDepth=checked_depth(max_depth), maxBins=max_bins,
        seed=seed, bootstrap=True,
    )
    if weight_col:
        kw["weightCol"] = weight_col
    kw.update(params)
    return RandomForestClassifier(**kw)


def logistic_regression(
    label_col: str = "Class", C: float = 1.0, n_train: int | None = None, penalty: str = "l2",
    max_iter: int = 200, weight_col: str | None = None, **params,
) -> LogisticRegression:
    """F3.  sklearn's ``C`` maps to ``regParam = 1 / (C * n_train)`` (sum of
    weights); ``penalty`` l1 -> elasticNet 1, l2 -> 0, none -> no penalty."""
    reg = 0.0
    if penalty != "none":
        if not n_train:
            raise ValueError("n_train (sum of training weights) is needed to map C to regParam")
        reg = 1.0 / (float(C) * float(n_train))
    kw = dict(
        labelCol=label_col, maxIter=max_iter, regParam=reg, elasticNetParam=1.0 if penalty == "l1" else 0.0,
        standardization=False, family="binomial",
    )
    if weight_col:
        kw["weightCol"] = weight_col
    kw.update(params)
    return LogisticRegression(**kw)


def boosted_trees(
    label_col: str = "Class", max_iter: int = 100, max_depth: int = 6, step_size: float = 0.3,
    subsampling_rate: float = 1.0, feature_subset: str = "all", weight_col: str | None = None,
    validation_col: str | None = None, seed: int = 42, **params,
) -> GBTClassifier:
    """log-loss boosting; positives weighted via ``weight_col``
    (:func:`stats.positive_weight`, 5 by default in the reference); with
    ``validation_col`` the fit stops when the validation loss stalls."""
    kw = dict(
        labelCol=label_col, maxIter=max_iter, maxDepth=checked_depth(max_depth), stepSize=step_size,
        subsamplingRate=subsampling_rate, featureSubsetStrategy=feature_subset, seed=seed, lossType="logistic",
    )
    if weight_col:
        kw["weightCol"] = weight_col
    if validation_col:
        kw["validationIndicatorCol"] = validation_col
    kw.update(params)
    return GBTClassifier(**kw)


def linear_svc(label_col: str = "Class", reg_param: float = 0.0, max_iter: int = 100, **params) -> LinearSVC:
    return LinearSVC(labelCol=label_col, regParam=reg_param, maxIter=max_iter, **params)


# ---------------------------------------------------------------- SGD logistic


class _SGDParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    iterations = Param(Params._dummy(), "iterations", "number of SGD iterations", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "initial step size", TypeConverters.toFloat)
    miniBatchFraction = Param(Params._dummy(), "miniBatchFraction", "fraction of rows per step", TypeConverters.toFloat)
    regParam = Param(Params._dummy(), "regParam", "L2 regularisation", TypeConverters.toFloat)


class SGDLogisticModel(Model, _SGDParams, DefaultParamsReadable, DefaultParamsWritable):
    """Scores ``probability`` (a 2-vector, like Spark's classifiers),
    ``rawPrediction`` and ``prediction`` with JVM-side column expressions."""

    coefficients = Param(Params._dummy(), "coefficients", "weights", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    def __init__(self, coefficients=None, intercept=0.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction")
        if coefficients is not None:
            self._set(coefficients=list(map(float, coefficients)), intercept=float(intercept))

    def _transform(self, df: DataFrame) -> DataFrame:
        w = self.getOrDefault(self.coefficients)
        b = self.getOrDefault(self.intercept)
        x = vector_to_array(F.col(self.getFeaturesCol()))
        margin = F.lit(b)
        for i, wi in enumerate(w):
            margin = margin + x[i] * F.lit(wi)
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return df.withColumn("rawPrediction", array_to_vector(F.array(-margin, margin))).withColumn(
            "probability", array_to_vector(F.array(1 - p1, p1))
        ).withColumn(self.getPredictionCol(), (p1 > 0.5).cast("double"))


class SGDLogistic(Estimator, _SGDParams, DefaultParamsReadable, DefaultParamsWritable):
    """log-loss mini-batch SGD from zero weights.

    Each step is one pass of Arrow batches (:func:`networks.gradient`): the
    weights go out with the task function, so nothing is compiled anew, and only
    the added gradient reaches the driver.  L2 on the weights, not on the
    intercept.  ``schedule`` of the learning rate: invscaling (step / t^power),
    constant, optimal (1 / (regParam (t0 + t))) or adaptive (a fifth whenever the
    loss stalls)."""

    seed = Param(Params._dummy(), "seed", "of the mini-batches", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "unique row id (needed for mini-batches)", TypeConverters.toString)
    schedule = Param(Params._dummy(), "schedule", "invscaling | constant | optimal | adaptive", TypeConverters.toString)
    power = Param(Params._dummy(), "power", "exponent of invscaling", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 iterations=1000, step=0.01, miniBatchFraction=1.0, regParam=0.0, seed=42, idCol="row_id",
                 schedule="invscaling", power=0.5):
        super().__init__()
        self._setDefault(iterations=1000, step=0.01, miniBatchFraction=1.0, regParam=0.0, seed=42, idCol="row_id",
                         schedule="invscaling", power=0.5)
        self._set(**self._input_kwargs)

    def _rates(self, alpha: float):
        """A function (step number from 1, mean loss) -> learning rate."""
        eta, kind = self.getOrDefault(self.step), self.getOrDefault(self.schedule)
        if kind == "constant":
            return lambda t, loss: eta
        if kind == "invscaling":
            return lambda t, loss: eta / t ** self.getOrDefault(self.power)
        if kind == "optimal":
            # 1 / (alpha (t0 + t)); t0 makes the first rate fit weights of the expected size
            size = math.sqrt(1.0 / math.sqrt(alpha)) if alpha else 1.0
            first = size / max(1.0, 1.0 / (1.0 + math.exp(-size)))
            return lambda t, loss: 1.0 / (alpha * (1.0 / (first * alpha) + t)) if alpha else first
        if kind != "adaptive":
            raise ValueError(f"schedule must be one of {', '.join(SCHEDULES)}")
        best, stale, now = math.inf, 0, eta

        def adaptive(t, loss):
            # a fifth of the rate after PATIENCE steps that gain less than TOLERANCE
            nonlocal best, stale, now
            stale = 0 if loss < best - TOLERANCE else stale + 1
            best = min(best, loss)
            if stale >= PATIENCE:
                now, stale = now / 5.0, 0
            return now

        return adaptive

    def _fit(self, df: DataFrame) -> SGDLogisticModel:
        fraction, reg = self.getOrDefault(self.miniBatchFraction), self.getOrDefault(self.regParam)
        x = vector_to_array(F.col(self.getFeaturesCol()))
        cols = [x.alias("x"), F.array(F.col(self.getLabelCol()).cast("double")).alias("y")]
        if fraction < 1.0:
            cols.append(F.col(self.getOrDefault(self.idCol)).alias("id"))
            if "syn_seq" in df.columns:  # rows made from one source share its id
                cols.append(F.col("syn_seq").alias("copy"))
        rows = df.select(*cols).persist()
        rate = self._rates(reg)

        def log_loss(w, b):
            def fn(x, y):
                margin = x @ w + b
                error = 1.0 / (1.0 + np.exp(-margin.clip(-700.0, 700.0))) - y[:, 0]
                return np.append(error @ x, error.sum()), float(np.logaddexp(0.0, np.where(y[:, 0] > 0, -margin, margin)).sum())

            return fn

        try:
            d = rows.select(F.max(F.size("x"))).first()[0] or 0
            w, b = np.zeros(d), 0.0
            for t in range(1, self.getOrDefault(self.iterations) + 1):
                batch = rows
                if fraction < 1.0:
                    key = [F.col(c) for c in ("id", "copy") if c in rows.columns]
                    batch = rows.where(uniform(self.getOrDefault(self.seed), "sgd", t, *key) < F.lit(float(fraction)))
                g, loss, n = gradient(batch.select("x", "y"), log_loss(w, b))
                if not n:
                    continue
                eta = rate(t, loss)
                if eta < 1e-6 and self.getOrDefault(self.schedule) == "adaptive":
                    break
                w = w * (1.0 - eta * reg) - eta * g[:-1]
                b -= eta * float(g[-1])
        finally:
            rows.unpersist()
        model = SGDLogisticModel(w, b)
        model._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol())
        return model


def sgd_logistic(label_col: str = "Class", iterations: int = 1000, step: float = 0.01,
                 mini_batch_fraction: float = 1.0, reg_param: float = 0.0, seed: int = 42,
                 schedule: str = "invscaling") -> SGDLogistic:
    return SGDLogistic(labelCol=label_col, iterations=iterations, step=step,
                       miniBatchFraction=mini_batch_fraction, regParam=reg_param, seed=seed, schedule=schedule)


# ---------------------------------------------------------------- estimators that depend on the rows fitted


class PenalisedLogistic(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """F3 with the usual ``C``: ``regParam = 1 / (C * sum of weights)`` of the rows
    (original or resampled) that each fit really sees, classes balanced by
    weight unless ``balanced`` is off."""

    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l1 | l2 | none", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    balanced = Param(Params._dummy(), "balanced", "balanced class weights", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, C=1.0, penalty="l2", maxIter=200, balanced=True, labelCol="Class", featuresCol="features"):
        super().__init__()
        self._setDefault(C=1.0, penalty="l2", maxIter=200, balanced=True, labelCol="Class", featuresCol="features", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        label = self.getLabelCol()
        weight = None
        if self.getOrDefault(self.balanced):
            weight = "_class_weight"
            df = balanced_class_weight(df, label, weight)
        total = df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
        est = logistic_regression(
            label, C=self.getOrDefault(self.C), n_train=total, penalty=self.getOrDefault(self.penalty),
            max_iter=self.getOrDefault(self.maxIter), weight_col=weight, featuresCol=self.getFeaturesCol(),
        )
        return est.fit(df)


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """F5 with the weight of positives and early stopping inside the fit, so
    trials that differ in them share one (resampled) training table.

    A hashed tenth of the ids is the validation part on which boosting stops;
    ``maxIter`` is the upper bound."""

    posWeight = Param(Params._dummy(), "posWeight", "weight of positives", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "most rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "rows per tree", TypeConverters.toFloat)
    featureSubset = Param(Params._dummy(), "featureSubset", "features per split", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique row id", TypeConverters.toString)

    @keyword_only
    def __init__(self, posWeight=5.0, maxIter=5000, maxDepth=6, stepSize=0.3, subsamplingRate=1.0, featureSubset="all",
                 labelCol="Class", featuresCol="features", idCol="row_id"):
        super().__init__()
        self._setDefault(posWeight=5.0, maxIter=5000, maxDepth=6, stepSize=0.3, subsamplingRate=1.0, featureSubset="all",
                         labelCol="Class", featuresCol="features", idCol="row_id", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        get, label = self.getOrDefault, self.getLabelCol()
        df = positive_weight(df, get(self.posWeight), label, "_weight")
        df = df.withColumn("_validation", uniform(42, "validation", F.col(get(self.idCol))) < F.lit(0.1))
        est = boosted_trees(
            label, max_iter=get(self.maxIter), max_depth=get(self.maxDepth), step_size=get(self.stepSize),
            subsampling_rate=get(self.subsamplingRate), feature_subset=get(self.featureSubset), weight_col="_weight",
            validation_col="_validation", featuresCol=self.getFeaturesCol(),
        )
        return est.fit(df)


# ---------------------------------------------------------------- fit / score


class _Prefix:
    """The stages before the last one, applied once to a table that many models score."""

    def __init__(self, model: PipelineModel):
        self.model, self.lock, self.last = model, threading.Lock(), (None, None)

    def __call__(self, df: DataFrame) -> DataFrame:
        with self.lock:
            if self.last[0] is not df:
                self.last = df, self.model.transform(df)
            return self.last[1]


class _PrefixedModel(PipelineModel):
    """A pipeline model whose first stages are shared with the other fits."""

    def __init__(self, prefix: _Prefix, last):
        super().__init__([*prefix.model.stages, last])
        self.prefix = prefix

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.stages[-1].transform(self.prefix(dataset))


class SharedPipeline(Pipeline):
    """A pipeline that hands many points to its last stage at once, so that stage
    may share work between them; the stages before run once."""

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        *first, last = self.getStages()
        if any(p.parent != last.uid for m in paramMaps for p in m):
            return super().fitMultiple(dataset, paramMaps)
        prefix = _Prefix(Pipeline(stages=first).fit(dataset))
        fits = last.fitMultiple(prefix.model.transform(dataset), paramMaps)
        return map(lambda fit: (fit[0], _PrefixedModel(prefix, fit[1])), fits)


def make_pipeline(estimator, features: Sequence[str]) -> Pipeline:
    stages = [assembler(features), estimator]
    return SharedPipeline(stages=stages) if isinstance(estimator, KNNClassifier) else Pipeline(stages=stages)


def fit(estimator, df: DataFrame, features: Sequence[str]) -> PipelineModel:
    return make_pipeline(estimator, features).fit(df)


def with_score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """``df`` plus the score of class 1 in ``name``; no other column is added."""
    out = model.transform(df)
    return out.withColumn(name, _score_column(out)).select(*df.columns, name)


def _score_column(out: DataFrame):
    if "probability" in out.columns:
        return vector_to_array(F.col("probability"))[1]
    if "rawPrediction" in out.columns:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array(F.col("rawPrediction"))[1]))
    return F.col("prediction").cast("double")


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("row_id",), label_col: str = "Class") -> DataFrame:
    """(keep..., label, score, prediction) with score = P(class 1) (B8), or
    the sigmoid of the margin for margin-only models (B9)."""
    out = model.transform(df)
    return out.select(*keep, F.col(label_col).alias("label"), _score_column(out).alias("score"), F.col("prediction").cast("int").alias("prediction"))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """hard labels for a whole table (or a stream)."""
    return model.transform(df)
