"""Model selection and the experiment matrix (inventory J1-J6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.operators import curves, metrics


def experiment_matrix(
    scored: DataFrame,
    methods: Sequence[str] = ("pr_curve", "cost_based", "percentile", "default"),
    group_cols: Sequence[str] = ("model", "oversampling"),
    label_col: str = "label",
    score_col: str = "score",
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    percentile: float = 99,
) -> DataFrame:
    """One metrics row per (group..., threshold method).

    ``scored`` holds the test-split scores of every experiment, keyed by
    ``group_cols``; the cumulative score table is built once and shared by all
    methods (the union reuses its exchanges), so the scored rows are scanned
    once however many experiments and methods there are (one aggregate
    serves every method, see :func:`metrics.evaluate_many`)."""
    gcols = list(group_cols)
    return metrics.evaluate_many(
        scored, methods=methods, cost_fp=cost_fp, cost_fn=cost_fn, percentile=percentile,
        label_col=label_col, score_col=score_col, group_cols=gcols,
    )


# ---------------------------------------------------------------- J1: search space

import math as _math

import numpy as _np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol, Param, Params, TypeConverters

from raresift.operators.boosting import with_validation
from raresift.session import materialize

# Search ranges of the reference, per model (fixed values); tree depth ends at
# Spark's 30, and SGD batches are row counts that become fractions of the rows.
# kind: ("int", lo, hi, step) | ("log", lo, hi) | ("float", lo, hi) | ("choice", [..])
SEARCH_RANGES = {
    "knn": {"k": ("int", 3, 20, 1), "metric": ("choice", ["euclidean", "manhattan"])},
    "lr": {"C": ("log", 1e-4, 1e4), "max_iter": ("int", 100, 1000, 100), "penalty": ("choice", ["l1", "l2"])},
    "rf": {"num_trees": ("int", 50, 500, 50), "max_depth": ("int", 5, 30, 5), "max_bins": ("int", 32, 256, 32)},
    "sgd": {"reg_param": ("log", 1e-6, 1e-2), "batch_size": ("choice", [512, 1024, 2048]),
            "iterations": ("int", 500, 5000, 500), "step": ("log", 1e-6, 1e-2),
            "schedule": ("choice", ["constant", "optimal", "invscaling", "adaptive"])},
    "xgboost": {"max_depth": ("int", 3, 15, 1), "step_size": ("log", 0.01, 0.3), "subsampling_rate": ("float", 0.5, 1.0),
                "feature_subset": ("float", 0.5, 1.0), "pos_weight": ("float", 1.0, 10.0)},
    "ae": {"latent_dim": ("int", 4, 16, 1)},
    "vae": {"latent_dim": ("int", 4, 16, 1)},
}


def param_space(model: str, trials: int = 30, seed: int = 42) -> list[dict]:
    """``trials`` points drawn from the model's ranges with a seeded
    generator (uniform, log-uniform, stepped ints, choices).  A driver-side
    list of a few dozen dicts; each becomes a ``ParamMap`` or call kwargs."""
    if model not in SEARCH_RANGES:
        raise ValueError(f"unknown model {model!r}")
    rng = _np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        p = {}
        for name, spec in SEARCH_RANGES[model].items():
            kind = spec[0]
            if kind == "int":
                lo, hi, step = spec[1:]
                p[name] = int(lo + step * rng.integers(0, (hi - lo) // step + 1))
            elif kind == "log":
                p[name] = float(_math.exp(rng.uniform(_math.log(spec[1]), _math.log(spec[2]))))
            elif kind == "float":
                p[name] = float(rng.uniform(spec[1], spec[2]))
            else:
                p[name] = spec[1][int(rng.integers(0, len(spec[1])))]
        out.append(p)
    return out


# ---------------------------------------------------------------- E7 + evaluator


class ResampledEstimator(Estimator):
    """Resample the TRAINING data only, then fit the inner estimator.

    Inside ``CrossValidator`` this runs per training fold, so validation rows
    never see synthetic rows.  ``fitMultiple`` resamples once per fold and
    reuses the result for every ParamMap (the sampler is deterministic, so
    the answers are the same as resampling per map), cutting lineage with a
    reliable checkpoint so a lost executor does not redo the resampling."""

    def __init__(self, inner=None, sampler=None, checkpoint: bool = True):
        super().__init__()
        self.inner = inner
        self.sampler = sampler
        self.use_checkpoint = checkpoint

    def _resampled(self, df):
        if self.sampler is None:
            return df
        out = self.sampler(df)
        if self.use_checkpoint:
            out = materialize(out)
        return out

    def _fit(self, df):
        return self.inner.fit(self._resampled(df))

    def fitMultiple(self, dataset, paramMaps):
        data = self._resampled(dataset)
        return self.inner.fitMultiple(data, paramMaps)

    def copy(self, extra=None):
        that = ResampledEstimator(self.inner.copy(extra) if extra else self.inner, self.sampler, self.use_checkpoint)
        return that


class MetricEvaluator(Evaluator, HasLabelCol):
    """H10 as a ``pyspark.ml`` Evaluator: prauc, f1, precision, recall, cost;
    cost is minimised."""

    metric = Param(Params._dummy(), "metric", "prauc|f1|precision|recall|cost", TypeConverters.toString)

    def __init__(self, metric: str = "prauc", labelCol: str = "Class", cost_fp: float = 1.0, cost_fn: float = 5.0):
        super().__init__()
        self._set(metric=metric, labelCol=labelCol)
        self.cost_fp, self.cost_fn = cost_fp, cost_fn

    def _evaluate(self, dataset) -> float:
        s = dataset.select(
            F.col(self.getLabelCol()).alias("label"),
            (vector_to_array(F.col("probability"))[1] if "probability" in dataset.columns else F.col("prediction")).alias("score"),
        )
        v = metrics.evaluate_metric(s, self.getOrDefault(self.metric), self.cost_fp, self.cost_fn).first()["value"]
        return float(v if v is not None else 0.0)

    def isLargerBetter(self) -> bool:
        return metrics.is_larger_better(self.getOrDefault(self.metric))


# ---------------------------------------------------------------- J2-J4


def cross_validate(
    train: DataFrame,
    estimator,
    param_maps: list,
    metric: str = "prauc",
    label_col: str = "Class",
    fold_col: str = "fold",
    parallelism: int = 2,
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
):
    """Every trial on every fold of a precomputed stratified ``fold`` column
    (D2): one ``fitMultiple`` per fold, so the training rows of a fold are
    resampled once for all trials, and no fit on the whole table (the caller
    refits the winner).  The folded rows are kept in the shared checkpoint folder,
    so folds and features are not computed anew for every trial.  Boosting is
    handed the validation fold and stops on it.  Returns (scores by trial and fold, trial table)."""
    from multiprocessing.pool import ThreadPool

    train = materialize(train)
    n_folds = int(train.agg(F.max(fold_col)).first()[0]) + 1
    evaluator = MetricEvaluator(metric, label_col, cost_fp, cost_fn)
    scores = _np.zeros((len(param_maps), n_folds))
    for f in range(n_folds):
        valid = train.where(F.col(fold_col) == f)
        fits = with_validation(estimator, valid).fitMultiple(train.where(F.col(fold_col) != f), param_maps)

        def measure(_, fits=fits, valid=valid):
            i, model = next(fits)
            return i, evaluator.evaluate(model.transform(valid))

        with ThreadPool(parallelism) as pool:
            for i, value in pool.imap_unordered(measure, range(len(param_maps))):
                scores[i, f] = value
    rows = []
    for i, pm in enumerate(param_maps):
        params = ", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name))
        rows.append((i, params, float(scores[i].mean()), float(scores[i].std())))
    trials = train.sparkSession.createDataFrame(rows, "trial int, params string, value double, std double")
    return scores, trials


def best_trial(trials: DataFrame, larger_is_better: bool = True) -> DataFrame:
    """Best mean score and its parameters; ties -> lowest trial number."""
    key = F.col("value").desc() if larger_is_better else F.col("value").asc()
    return trials.orderBy(key, F.col("trial").asc()).limit(1)


def refit_best(estimator, train: DataFrame, best_params, sampler=None):
    """Fit the winner on the whole training split (resampled like the
    folds unless ``sampler`` is None) and return (model, seconds)."""
    import time

    data = sampler(train) if sampler is not None else train
    t0 = time.time()
    model = estimator.fit(data, best_params) if best_params else estimator.fit(data)
    return model, time.time() - t0


def latent_sizes(n_features: int) -> range:
    """The search range of the latent size, below the number of features."""
    lo, hi = SEARCH_RANGES["ae"]["latent_dim"][1:3]
    return range(min(lo, max(1, n_features - 1)), min(hi, max(1, n_features - 1)) + 1)


def reconstruction_search(
    normal: DataFrame,
    features,
    ks=range(4, 17),
    k_folds: int = 5,
    seed: int = 42,
    id_col: str = "row_id",
) -> DataFrame:
    """Choose the latent size of the linear auto-encoder (PCA) by the
    lowest mean validation error over ``k_folds`` unstratified folds (D3).

    One PCA fit per fold with the largest k (a prefix of its axes gives every
    smaller k); the validation errors of all k are computed in one pass, each
    row scored with its own fold's axes.  Returns (k, mean_error, best)."""
    from pyspark.sql import types as T

    from raresift.operators import anomaly, splits

    ks = [k for k in ks]
    folded = splits.kfold(normal, k_folds, id_col=id_col, seed=seed)
    d = len(features) if not isinstance(features, str) else None
    kmax = max(ks)
    axes = {}
    for f in range(k_folds):
        axes[f] = anomaly.fit_pca(folded.where(F.col("fold") != f), features, kmax)
    projs = {f: [V[:, :k] @ V[:, :k].T for k in ks] for f, V in axes.items()}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def errs(x: pd.Series, fold: pd.Series) -> pd.Series:
        X = _np.stack(x.to_numpy()).astype(float) if len(x) else _np.zeros((0, 1))
        fo = fold.to_numpy()
        E = _np.zeros((len(X), len(ks)))
        for f in _np.unique(fo):
            m = fo == f
            for j, P in enumerate(projs[int(f)]):
                E[m, j] = _np.mean((X[m] - X[m] @ P) ** 2, axis=1)
        return pd.Series(list(E))

    x = anomaly.features_array(features)
    scored = folded.select("fold", F.posexplode(errs(x, F.col("fold"))).alias("ki", "err"))
    per_fold = scored.groupBy("ki", "fold").agg(F.avg("err").alias("fe"))
    per_k = per_fold.groupBy("ki").agg(F.avg("fe").alias("mean_error"))
    kmap = F.element_at(F.array(*[F.lit(k) for k in ks]), F.col("ki") + 1)
    res = per_k.select(kmap.alias("k"), "mean_error")
    best = res.agg(F.min(F.struct("mean_error", "k")).alias("b")).select(F.col("b.k").alias("best_k"))
    return res.join(F.broadcast(best), F.col("k") == F.col("best_k"), "left").select(
        "k", "mean_error", F.col("best_k").isNotNull().alias("best")
    )
