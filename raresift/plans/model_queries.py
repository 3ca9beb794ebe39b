"""Registered queries that fit models (inventory F1, F3-F6, B8, B9, E7,
J2-J4, J6 over fitted models) -- rows-only checks, each backed by unit
tests -- and the reporting queries (K1-K3) with DuckDB oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from raresift.functions.hashing import sql_uniform
from raresift.operators import boosting, classify, networks, report, resample, select, splits, stats
from raresift.operators.knn import KNNClassifier
from raresift.operators.relational import minority_rows
from raresift.plans import flows
from raresift.plans.catalog import R, register, rounded
from raresift.plans.evaluation_queries import _MATRIX_METHODS, COST_FN, COST_FP, experiment_matrix_sql
from raresift.plans.flagged import flagged_at_cost, prepared_split
from raresift.session import materialize
from raresift.sources import fixtures as fx

FEATS = fx.FEATURES
SEED = 42


@register("flagged_at_cost")
def q_flagged(spark, sf):
    return rounded(flagged_at_cost(spark, sf))


def _scores(spark, sf, est_fn):
    train, test = prepared_split(spark, sf)
    model = classify.fit(est_fn(train), train, FEATS)
    return rounded(classify.score(model, test))


@register("logistic_regression")
def q_lr(spark, sf):
    return _scores(spark, sf, lambda tr: classify.logistic_regression(C=1.0, n_train=tr.count()))


@register("random_forest")
def q_rf(spark, sf):
    def est(tr):
        return classify.random_forest(num_trees=100, max_depth=8, weight_col="weight")

    train, test = prepared_split(spark, sf)
    train = stats.balanced_class_weight(train)
    model = classify.fit(est(train), train, FEATS)
    return rounded(classify.score(model, test))


_SHARE_SQL = fx.with_ctes(
    ["txn"],
    f"SELECT row_id, \"Class\" AS label, {R('avg(CAST(\"Class\" AS DOUBLE)) OVER (PARTITION BY V2 >= 12)')} AS score FROM txn",
)


def _late(spark, sf):
    """One binary feature: a model that fits it gives each half its class share."""
    return fx.txn(spark, sf).select("row_id", (F.col("V2") >= 12).cast("double").alias("late"), "Class")


@register("logistic_regression_closed_form", _SHARE_SQL)
def q_lr_closed(spark, sf):
    """F3 where the solution has a closed form."""
    t = _late(spark, sf)
    est = classify.logistic_regression(penalty="none", max_iter=500, tol=1e-14)
    return rounded(classify.score(classify.fit(est, t, ["late"]), t).select("row_id", "label", "score"))


@register(
    "random_forest_stump",
    fx.with_ctes(["txn"], f"SELECT row_id, CAST(V3 >= 50 AS INTEGER) AS label, {R('avg(CAST(V3 >= 50 AS DOUBLE)) OVER (PARTITION BY V3 >= 45)')} AS score FROM txn"),
)
def q_rf_stump(spark, sf):
    """F1 where the tree has a closed form: one split, leaves are class shares."""
    t = fx.txn(spark, sf).select("row_id", (F.col("V3") >= 45).cast("double").alias("x"), (F.col("V3") >= 50).cast("int").alias("Class"))
    est = classify.random_forest(num_trees=1, max_depth=1, featureSubsetStrategy="all").setBootstrap(False)
    return rounded(classify.score(classify.fit(est, t, ["x"]), t).select("row_id", "label", "score"))


@register("boosted_trees")
def q_gbt(spark, sf):
    train, test = prepared_split(spark, sf)
    train = stats.positive_weight(train, 5.0)
    # early stopping on a validation part of the training split
    train = splits.kfold(train, 5, seed=SEED).withColumn("is_val", F.col("fold") == 0).drop("fold")
    est = classify.boosted_trees(max_iter=100, max_depth=4, step_size=0.1, weight_col="weight", validation_col="is_val")
    model = classify.fit(est, train, FEATS)
    return rounded(classify.score(model, test))


# ---------------------------------------------------------------- second-order boosting

_BOOST = {"posWeight": 5.0, "rounds": 2, "maxDepth": 2, "stepSize": 0.3}
_BOOST_FEATURES = ["Amount", "V3"]
_BOOST_CUTS = [[1.0, 25.0, 50.0, 100.0, 150.0, 200.0, 300.0], [10.0, 25.0, 50.0, 75.0, 90.0]]


def _boost_sql() -> str:
    """Two rounds of depth two with given cut points, split by split."""
    u, eta = boosting.UNIT, _BOOST["stepSize"]
    cuts = ", ".join(f"({f}, {j}, {c!r})" for f, own in enumerate(_BOOST_CUTS) for j, c in enumerate(own))
    value = "CASE f WHEN 0 THEN x0 ELSE x1 END"
    ctes = [
        ("cuts", f"SELECT * FROM (VALUES {cuts}) AS t(f, j, c)"),
        ("m0", f'SELECT row_id, Amount AS x0, V3 AS x1, "Class" AS y, CASE WHEN "Class" = 1 THEN {_BOOST["posWeight"]!r} ELSE 1.0 END::DOUBLE AS w, 0.0::DOUBLE AS m FROM txn'),
    ]
    score = lambda g, h: f"(({g}) / {u}.0) * (({g}) / {u}.0) / (({h}) / {u}.0 + 1.0)"
    for r in range(_BOOST["rounds"]):
        ctes.append((f"n{r}_0", f"SELECT *, round_even(w * (p - y) * {u}, 0) AS g, round_even(w * greatest(p * (1 - p), 1e-16) * {u}, 0) AS h, 1 AS node FROM (SELECT *, 1 / (1 + exp(-m)) AS p FROM m{r}) q"))
        for level in range(_BOOST["maxDepth"]):
            rows = f"n{r}_{level}"
            ctes.append(
                (
                    f"b{r}_{level}",
                    f"SELECT node AS at, f, c FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, j) AS k FROM ("
                    f"SELECT node, f, j, c, 0.5 * ({score('gl', 'hl')} + {score('ga - gl', 'ha - hl')} - {score('ga', 'ha')}) AS gain, hl, ha FROM ("
                    f"SELECT node, f, j, any_value(c) AS c, coalesce(sum(g) FILTER ({value} < c), 0) AS gl, coalesce(sum(h) FILTER ({value} < c), 0) AS hl, sum(g) AS ga, sum(h) AS ha "
                    f"FROM {rows} CROSS JOIN cuts GROUP BY node, f, j) z WHERE hl >= {u} AND ha - hl >= {u}) y WHERE gain > 1e-9) x WHERE k = 1",
                )
            )
            ctes.append((f"n{r}_{level + 1}", f"SELECT s.* EXCLUDE (node), CASE WHEN f IS NULL THEN node WHEN {value} < c THEN 2 * node ELSE 2 * node + 1 END AS node FROM {rows} s LEFT JOIN b{r}_{level} b ON s.node = b.at"))
        last = f"n{r}_{_BOOST['maxDepth']}"
        ctes.append((f"v{r}", f"SELECT node AS leaf, -{eta} * (sum(g) / {u}.0) / (sum(h) / {u}.0 + 1.0) AS v FROM {last} GROUP BY node"))
        ctes.append((f"m{r + 1}", f"SELECT row_id, x0, x1, y, w, m + v AS m FROM {last} JOIN v{r} ON node = leaf"))
    return fx.with_ctes(["txn"], f"SELECT row_id, y AS label, {R('1 / (1 + exp(-m))')} AS score FROM m{_BOOST['rounds']}", ctes)


@register("boosted_trees_rounds", _boost_sql())
def q_boost_rounds(spark, sf):
    """gradients, histograms, gains and leaves of two rounds, equal to SQL."""
    est = boosting.HistogramBoosting(**_BOOST)
    est.cuts = _BOOST_CUTS
    t = fx.txn(spark, sf).select("row_id", *_BOOST_FEATURES, "Class")
    return rounded(classify.score(classify.fit(est, t, _BOOST_FEATURES), t).select("row_id", "label", "score"))


@register("boosted_trees_early_stop")
def q_boost_stop(spark, sf):
    """F5 with sketched bins, row and feature draws, stopped on a validation fold."""
    train, test = prepared_split(spark, sf)
    train = splits.stratified_kfold(train, 5, seed=SEED)
    est = boosting.HistogramBoosting(posWeight=5.0, maxIter=12, stale=3, maxDepth=3, subsamplingRate=0.8, featureSubset=0.75)
    est = boosting.with_validation(classify.make_pipeline(est, FEATS), train.where("fold = 0"))
    return rounded(classify.score(est.fit(train.where("fold <> 0")), test))


@register("sgd_logistic")
def q_sgd(spark, sf):
    return _scores(spark, sf, lambda tr: classify.sgd_logistic(iterations=100, step=0.1, mini_batch_fraction=0.5))


_SGD_STEPS, _SGD_RATE, _SGD_SHARE, _SGD_REG = 3, 0.5, 0.5, 0.01


def _sgd_sql() -> str:
    """Three mini-batch steps from zero weights over two scaled features."""
    ctes = [("w0", "SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS b")]
    for t in range(1, _SGD_STEPS + 1):
        p = "1 / (1 + exp(-(w.b + w.a * s.x1 + w.c * s.x2)))"
        batch = f"(SELECT * FROM s WHERE {sql_uniform(str(SEED), chr(39) + 'sgd' + chr(39), str(t), 'row_id')} < {_SGD_SHARE})"
        rate = f"({_SGD_RATE} / sqrt({t}))"
        ctes.append(
            (
                f"w{t}",
                f"SELECT any_value(w.a) * (1 - {rate} * {_SGD_REG}) - {rate} * avg(({p} - s.y) * s.x1) AS a, "
                f"any_value(w.c) * (1 - {rate} * {_SGD_REG}) - {rate} * avg(({p} - s.y) * s.x2) AS c, "
                f"any_value(w.b) - {rate} * avg({p} - s.y) AS b FROM {batch} s CROSS JOIN w{t - 1} w",
            )
        )
    last = f"w{_SGD_STEPS}"
    return fx.with_ctes(
        ["txn"],
        f"SELECT row_id, \"Class\" AS label, {R(f'1 / (1 + exp(-({last}.b + {last}.a * s.x1 + {last}.c * s.x2)))')} AS score "
        f"FROM s CROSS JOIN {last} JOIN txn USING (row_id)",
        [("s", 'SELECT row_id, Amount / 100 AS x1, V3 / 50 AS x2, CAST("Class" AS DOUBLE) AS y FROM txn'), *ctes],
    )


@register("sgd_logistic_steps", _sgd_sql())
def q_sgd_steps(spark, sf):
    """a few mini-batch steps, the same numbers as plain SQL."""
    t = fx.txn(spark, sf).select("row_id", (F.col("Amount") / 100).alias("x1"), (F.col("V3") / 50).alias("x2"), "Class")
    est = classify.sgd_logistic(iterations=_SGD_STEPS, step=_SGD_RATE, mini_batch_fraction=_SGD_SHARE, reg_param=_SGD_REG)
    return rounded(classify.score(classify.fit(est, t, ["x1", "x2"]), t).select("row_id", "label", "score"))


@register("linear_svc_margin_score")
def q_svc(spark, sf):
    return _scores(spark, sf, lambda tr: classify.linear_svc(max_iter=100))


@register("cross_validate")
def q_cv(spark, sf):
    """Five folds, each resampled once for all trials."""
    train, _ = prepared_split(spark, sf)
    train = splits.stratified_kfold(train, 5, seed=SEED)
    lr = classify.PenalisedLogistic()
    sampler = lambda d: resample.smote(d.drop("fold"), FEATS, seed=SEED).drop("syn_seq", "is_synthetic")
    est = select.ResampledEstimator(classify.make_pipeline(lr, FEATS), sampler)
    grid = [{lr.C: c, lr.penalty: p, lr.maxIter: 200} for c in (0.01, 1.0, 100.0) for p in ("l1", "l2")]
    _, trials = select.cross_validate(train, est, grid, metric="prauc", parallelism=2)
    return rounded(trials)


@register("cross_validate_knn")
def q_cv_knn(spark, sf):
    """J2 for kNN over its search space (k, metric), five folds."""
    train, _ = prepared_split(spark, sf)
    train = splits.stratified_kfold(train, 5, seed=SEED)
    knn_est = KNNClassifier()
    grid = [{knn_est.k: k, knn_est.metric: m} for k in (3, 7) for m in ("euclidean", "manhattan")]
    _, trials = select.cross_validate(train, classify.make_pipeline(knn_est, FEATS), grid, metric="prauc", parallelism=2)
    return rounded(trials)


@register(
    "best_trial",
    fx.with_ctes(
        ["scored"],
        "SELECT trial, 'point ' || trial AS params, value, std FROM ("
        f"SELECT CAST(row_id % 30 AS INTEGER) AS trial, {R('avg(score)')} AS value, {R('stddev_pop(score)')} AS std "
        "FROM scored GROUP BY 1) ORDER BY value DESC, trial LIMIT 1",
    ),
)
def q_best_trial(spark, sf):
    """J3 on a trial table of 30 points made from the scores."""
    trials = fx.scored(spark, sf).groupBy((F.col("row_id") % 30).cast("int").alias("trial")).agg(
        F.avg("score").alias("value"), F.stddev_pop("score").alias("std")
    )
    trials = rounded(trials.select("trial", F.concat(F.lit("point "), F.col("trial").cast("string")).alias("params"), "value", "std"))
    return select.best_trial(trials, larger_is_better=True)


def _generator(train, kind: str) -> list[dict]:
    """Layers of a generator trained on the scaled rare rows; a last layer puts
    what it makes back on the scale of ``train``."""
    scaler = stats.fit_scaler(train, FEATS)
    made, _, _ = networks.train_generator(minority_rows(stats.transform_with_scaler(train, scaler)), FEATS, kind, seed=SEED)
    by = {r["column"]: r for r in scaler.collect()}  # one row a feature
    return [*made, dict(w=np.diag([by[c]["std"] for c in FEATS]), b=np.array([by[c]["mean"] for c in FEATS]), activation="linear")]


def _resampled(train, ovs: str | None):
    if ovs is None:
        return train
    args = {}
    if ovs in flows.GENERATED:
        layers = _generator(train, ovs)
        args = {"layers": layers, "latent_dim": np.shape(layers[0]["w"])[1]}
    return materialize(flows.sampler_for(ovs, FEATS, SEED, **args)(train))


@register("experiment_matrix_models")
def q_matrix_models(spark, sf):
    """J6 over fitted models: all five x every sampler of the flows (none among
    them), the test split scored in one pass, thresholds by every rule, one
    metrics row each."""
    train, test = (materialize(part) for part in prepared_split(spark, sf))  # read by every fit
    rows, keys = test, []
    for ovs in flows.SAMPLERS:
        tr = _resampled(train, ovs)
        for name, est in (
            ("lr", classify.PenalisedLogistic()),
            ("rf", classify.random_forest(num_trees=100)),
            ("knn", KNNClassifier(k=5)),
            ("sgd", classify.sgd_logistic(iterations=100, step=0.1)),
            ("xgboost", classify.BoostedTrees()),
        ):
            column = f"_s{len(keys)}"
            rows = classify.with_score(classify.fit(est, tr, FEATS), rows, column)
            keys.append((name, ovs or "none", column))
    runs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), F.lit(o).alias("oversampling"), F.col(c).alias("score")) for m, o, c in keys])
    )
    scored = rows.select(F.col("Class").alias("label"), runs.alias("r")).select("label", "r.*")
    return rounded(select.experiment_matrix(scored, methods=_MATRIX_METHODS, group_cols=["model", "oversampling"]))


# ---------------------------------------------------------------- reports (K1-K3)


def _results(spark, sf):
    return select.experiment_matrix(
        fx.scored_groups(spark, sf), methods=_MATRIX_METHODS, group_cols=["model", "oversampling"],
        cost_fp=COST_FP, cost_fn=COST_FN
    )


def _summary_sql(by: str) -> str:
    res = experiment_matrix_sql(raw=True)
    body = (
        f"SELECT metric_name, {by}, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std, count(value) AS n, "
        f"{R('avg(value) - 1.959963984540054 * coalesce(stddev_samp(value), 0) / sqrt(count(value))')} AS ci_low, "
        f"{R('avg(value) + 1.959963984540054 * coalesce(stddev_samp(value), 0) / sqrt(count(value))')} AS ci_high "
        f"FROM (UNPIVOT ({res}) ON accuracy, precision, recall, f1_score, roc_auc INTO NAME metric_name VALUE value) "
        f"GROUP BY ALL"
    )
    return body


@register("metrics_by_oversampling", _summary_sql("oversampling, model"))
def q_k1(spark, sf):
    return rounded(report.metrics_by_oversampling(_results(spark, sf)))


@register("metrics_by_model", _summary_sql("model, oversampling"))
def q_k2(spark, sf):
    return rounded(report.metrics_by_model(_results(spark, sf)))


@register("leaderboard", f"SELECT * FROM ({experiment_matrix_sql()}) ORDER BY pr_auc DESC")
def q_k3(spark, sf):
    return rounded(report.leaderboard(_results(spark, sf), "pr_auc"))


# ---------------------------------------------------------------- B8 with fixed coefficients

FIXED_W, FIXED_B = [0.001, 0.01, 0.02, 0.05], -6.0


@register(
    "predict_positive_score",
    fx.with_ctes(
        ["txn"],
        "SELECT row_id, \"Class\" AS label, "
        + R("1 / (1 + exp(-(" + f"({FIXED_B!r})" + "".join(f" + {c} * ({w!r})" for c, w in zip(FEATS, FIXED_W)) + ")))")
        + " AS score, CAST(1 / (1 + exp(-("
        + f"({FIXED_B!r})" + "".join(f" + {c} * ({w!r})" for c, w in zip(FEATS, FIXED_W))
        + "))) > 0.5 AS INTEGER) AS prediction FROM txn",
    ),
)
def q_positive_score(spark, sf):
    """B8 through a PipelineModel whose logistic stage has fixed coefficients."""
    from pyspark.ml import PipelineModel

    model = PipelineModel(stages=[classify.assembler(FEATS), classify.SGDLogisticModel(FIXED_W, FIXED_B)])
    return rounded(classify.score(model, fx.txn(spark, sf)))


@register(
    "model_registry_roundtrip",
    fx.with_ctes(
        ["txn"],
        'SELECT row_id, "Class" AS label, '
        + R("1 / (1 + exp(-(" + f"({FIXED_B!r})" + "".join(f" + {c} * ({w!r})" for c, w in zip(FEATS, FIXED_W)) + ")))")
        + " AS score FROM txn",
    ),
)
def q_registry(spark, sf):
    """A pipeline with fixed coefficients saved under its key, loaded and
    applied; an absent key gives no model."""
    import uuid

    from pyspark.ml import PipelineModel

    from raresift.session import checkpoint_dir
    from raresift.sources import sinks

    root = f"{checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    model = PipelineModel(stages=[classify.assembler(FEATS), classify.SGDLogisticModel(FIXED_W, FIXED_B)])
    sinks.save_model(model, root, "sgd", None, "prauc")
    if sinks.load_model(root, "sgd", "smote", "prauc") is not None:
        raise AssertionError("a model under another key")
    back = sinks.load_model(root, "sgd", None, "prauc")
    return rounded(classify.score(back, fx.txn(spark, sf)).select("row_id", "label", "score"))
