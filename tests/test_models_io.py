"""Classifiers (rows-only, as the reference's own tests), anomaly scoring,
model selection, sources/sinks, streaming and the driver entry."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import anomaly, classify, select, splits, stats
from raresift.plans.flagged import prepared_split
from raresift.sources import fixtures as fx
from raresift.sources import readers, sinks

from paths import SF0001

FEATS = fx.FEATURES


@pytest.fixture(scope="module")
def split(spark):
    train, test = prepared_split(spark, SF0001)
    return train.cache(), test.cache()


@pytest.mark.parametrize("name", ["lr", "rf", "gbt", "sgd", "svc"])
def test_classifiers_one_score_per_row(spark, split, name):
    train, test = split
    est = {
        "lr": lambda: classify.logistic_regression(C=1.0, n_train=train.count()),
        "rf": lambda: classify.random_forest(num_trees=10, max_depth=30),
        "gbt": lambda: classify.boosted_trees(max_iter=5),
        "sgd": lambda: classify.sgd_logistic(iterations=20, step=0.1),
        "svc": lambda: classify.linear_svc(max_iter=10),
    }[name]()
    model = classify.fit(est, train, FEATS)
    s = classify.score(model, test)
    assert s.count() == test.count()
    assert s.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_model_registry_roundtrip(spark, split, tmpdir_path):
    train, test = split
    model = classify.fit(classify.logistic_regression(C=1.0, n_train=train.count()), train, FEATS)
    sinks.save_model(model, tmpdir_path, "lr", None, "prauc")
    assert os.path.isdir(sinks.model_path(tmpdir_path, "lr", None, "prauc"))
    back = sinks.load_model(tmpdir_path, "lr", None, "prauc")
    a = [r["score"] for r in classify.score(model, test).orderBy("row_id").collect()]
    b = [r["score"] for r in classify.score(back, test).orderBy("row_id").collect()]
    assert a == b
    assert sinks.load_model(tmpdir_path, "rf", "smote", "f1") is None


def test_resampling_stays_inside_training_folds(spark, split):
    from raresift.operators import resample

    train, _ = split
    folded = splits.stratified_kfold(train, 3)
    seen = []

    def sampler(d):
        seen.append({r["row_id"] for r in d.select("row_id").collect()})
        return resample.smote(d.drop("fold"), FEATS).drop("syn_seq", "is_synthetic")

    lr = classify.logistic_regression(C=1.0, n_train=1000, max_iter=10)
    est = select.ResampledEstimator(classify.make_pipeline(lr, FEATS), sampler, checkpoint=True)
    scores, trials = select.cross_validate(folded, est, [{lr.regParam: 0.01}, {lr.regParam: 0.1}], metric="f1", parallelism=1)
    folds = {f: {r["row_id"] for r in folded.where(F.col("fold") == f).collect()} for f in range(3)}
    # each fold's resampled set is exactly the union of the other folds:
    # validation rows never enter, and one resampling serves both trials
    assert set(map(frozenset, seen)) == {frozenset(folds[a] | folds[b]) for a, b in ((0, 1), (0, 2), (1, 2))}
    assert len(seen) == 3 and scores.shape == (2, 3)
    assert trials.count() == 2
    assert select.best_trial(trials).count() == 1


def test_param_space_deterministic():
    a, b = select.param_space("rf", 5, seed=1), select.param_space("rf", 5, seed=1)
    assert a == b and all(50 <= p["num_trees"] <= 500 for p in a)
    with pytest.raises(ValueError):
        select.param_space("nope")


def test_cost_is_minimised():
    from raresift.operators.metrics import is_larger_better

    assert not is_larger_better("cost") and is_larger_better("prauc")


def test_network_forward_matches_numpy(spark):
    from raresift.plans.anomaly_queries import AE_LAYERS

    df = spark.createDataFrame([(i, [float(i), 1.0, -1.0, 0.5]) for i in range(5)], "row_id long, x array<double>")
    out = {r["row_id"]: r["recon_error"] for r in anomaly.autoencoder_score(df, "x", AE_LAYERS).collect()}
    for i in range(5):
        x = np.array([[float(i), 1.0, -1.0, 0.5]])
        xh = anomaly.forward(AE_LAYERS, x)
        assert out[i] == pytest.approx(float(np.mean((x - xh) ** 2)))


def test_pca_full_rank_reconstructs(spark):
    t = stats.standard_scale_all(fx.txn(spark, SF0001).select("row_id", *FEATS, "Class"))
    V = anomaly.fit_pca(t, FEATS, 4)
    e = anomaly.pca_reconstruction(t, FEATS, V).agg(F.max("recon_error")).first()[0]
    assert e < 1e-18 or e == pytest.approx(0.0, abs=1e-12)


def test_vae_sample_mode_deterministic(spark):
    from raresift.plans.anomaly_queries import VAE, scaled_txn

    x = scaled_txn(spark, SF0001)
    a = [r["recon_error"] for r in anomaly.vae_score(x, FEATS, VAE, mode="sample").orderBy("row_id").collect()]
    b = [r["recon_error"] for r in anomaly.vae_score(x.repartition(5), FEATS, VAE, mode="sample").orderBy("row_id").collect()]
    assert a == b


def test_csv_roundtrip_and_missing(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w") as f:
        f.write("A,B\n1,x\n2,y\n3,z\n")
    df = readers.read_transactions(spark, p)
    assert [(r["A"], r["B"]) for r in df.orderBy("A").collect()] == [(1, "x"), (2, "y"), (3, "z")]
    with pytest.raises(FileNotFoundError):
        readers.read_transactions(spark, os.path.join(tmpdir_path, "missing.csv"))


def test_curves_written_and_read_back(spark, tmpdir_path):
    from raresift.operators import curves

    s = fx.scored(spark, SF0001)
    base = os.path.join(tmpdir_path, "curves_lr_smote.csv")
    assert sinks.write_curve(curves.pr_curve(s, closing_point=True), base, "pr_curve").endswith("_pr.csv")
    sinks.write_curve(curves.roc_curve(s), base, "roc_curve")
    assert sinks.write_curve(curves.roc_curve(s), base, "lift") is None
    back = readers.read_curves(spark, tmpdir_path)
    kinds = {(r["model"], r["oversampling"], r["curve_type"]) for r in back.select("model", "oversampling", "curve_type").distinct().collect()}
    assert kinds == {("lr", "smote", "pr_curve"), ("lr", "smote", "roc_curve")}


def test_run_log_append_and_summary(spark, tmpdir_path):
    import datetime as dt

    from raresift.operators.report import training_time_summary

    for v in (0.5, 0.7):
        sinks.append_run_log(spark, tmpdir_path, "cpu", "lr", "smote", "prauc", v, 1.5, ts=dt.datetime(2025, 3, 29, 10))
    r = training_time_summary(sinks.read_run_log(spark, tmpdir_path)).first()
    assert (r["runs"], r["best_value"], r["total_elapsed_sec"]) == (2, 0.7, 3.0)


def test_scaler_and_params_persist(spark, tmpdir_path):
    t = fx.txn(spark, SF0001)
    sc = stats.fit_scaler(t, ["Amount"])
    sinks.save_scaler(sc, tmpdir_path)
    assert sinks.load_scaler(spark, tmpdir_path).count() == 1
    sinks.write_best_params(spark, {"C": 0.1, "penalty": "l2"}, "lr", tmpdir_path, run_params={"trials": 30})
    got = spark.read.json(os.path.join(tmpdir_path, "best_params", "model=lr")).count()
    assert got == 2


def test_eval_results_partitioned(spark, tmpdir_path):
    df = spark.createDataFrame([("lr", "smote", "prauc", 0.9)], "model string, oversampling string, metric string, pr_auc double")
    sinks.write_eval_results(df, tmpdir_path, run_date="2025_03_29")
    assert os.path.isdir(os.path.join(tmpdir_path, "run_date=2025_03_29"))


def test_stream_scoring_equals_batch(spark):
    from raresift.plans.streaming_queries import q_stream_scored

    s = q_stream_scored(spark, SF0001)
    b = fx.scored(spark, SF0001)
    assert s.count() == b.count()
    assert s.where(F.col("prediction") != (F.col("score") >= 0.5).cast("int")).count() == 0


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and 0.0 <= rows[0]["accuracy"] <= 1.0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_approx_knn_subset_of_candidates(spark):
    from raresift.operators import knn

    v = fx.vec(spark, SF0001)
    a = knn.approx_knn_join(v, v, 3, "x", bucket_length=2.0)
    per = a.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert per is None or per <= 3
    assert a.where(F.col("query_id") == F.col("ref_id")).count() == 0


def test_model_scores_stream_like_batch(spark):
    import tempfile

    from raresift.operators.relational import drop_time
    from raresift.streaming import scoring

    train, test = splits.train_test(drop_time(fx.txn(spark, SF0001)))
    model = classify.fit(classify.logistic_regression(C=1.0, n_train=train.count()), train, FEATS)
    batch = {r["row_id"]: r["score"] for r in classify.score(model, test).collect()}
    src = fx.txn_from_events(scoring.read_stream(spark, f"{SF0001}/events.parq*", fx.table(spark, SF0001, "events")))
    sink = tempfile.mkdtemp(prefix="rs-stream-")
    scoring.write_stream(scoring.score_stream(drop_time(src), model), sink, sink + "-checkpoint").awaitTermination()
    got = {r["row_id"]: r["score"] for r in spark.read.parquet(sink).collect()}
    assert len(got) == 1000
    for rid, s in batch.items():
        assert got[rid] == pytest.approx(s)


POINTS = {
    "lr": [{"C": 0.1, "penalty": "l1", "max_iter": 20}, {"C": 1.0, "penalty": "l2", "max_iter": 20}],
    "knn": [{"k": 3, "metric": "euclidean"}, {"k": 5, "metric": "manhattan"}],
    "rf": [{"num_trees": 5, "max_depth": 3, "max_bins": 32}],
    "sgd": [{"iterations": 5, "step": 0.1, "reg_param": 0.0, "batch_size": 512}],
    "xgboost": [{"pos_weight": w, "max_depth": 2, "step_size": 0.3, "subsampling_rate": 1.0, "feature_subset": 1.0} for w in (1.0, 5.0)],
}


@pytest.mark.parametrize("model", sorted(POINTS))
def test_optimize_then_evaluate_registry(spark, tmpdir_path, monkeypatch, model):
    from raresift.operators import resample
    from raresift.operators.relational import drop_time
    from raresift.plans import flows

    if model == "xgboost":
        few = lambda *a, _f=flows.estimator_for: _f(*a)._set(maxIter=2, rounds=2)
        monkeypatch.setattr(flows, "estimator_for", few)
    train, test = splits.train_test(drop_time(fx.txn(spark, SF0001)))
    reg, log, calls = f"{tmpdir_path}/models", f"{tmpdir_path}/log", []

    def counted(df, method, *a, _f=resample.resample, **k):
        calls.append(method)
        return _f(df, method, *a, **k)

    monkeypatch.setattr(flows.resample, "resample", counted)
    fitted, trials = flows.optimize_model(
        spark, train, FEATS, model, "smote", "prauc", folds=2, registry=reg, run_log=log, parallelism=1, points=POINTS[model]
    )
    assert calls == ["smote"] * 3  # folds + 1
    assert trials.count() == len(POINTS[model])
    res = flows.evaluate_registry(reg, test, models=(model, "nothing"), samplers=("smote", None), metrics_=("prauc",))
    rows = res.collect()
    assert len(rows) == 1 and rows[0]["model"] == model  # absent keys are skipped
    assert rows[0]["selected_threshold"] == 0.5
    assert sinks.read_run_log(spark, log).count() == 1
    a = classify.score(fitted, test).select("row_id", "score").collect()
    b = classify.score(sinks.load_model(reg, model, "smote", "prauc"), test).select("row_id", "score").collect()
    assert {r[0]: r[1] for r in a} == pytest.approx({r[0]: r[1] for r in b})


@pytest.mark.parametrize("sampler", ["adasyn", "svmsmote", "gan"])
def test_optimize_with_other_samplers(spark, sampler):
    from raresift.operators.relational import drop_time
    from raresift.plans import flows
    from raresift.plans.sampling_queries import untrained_generator

    args = {}
    if sampler == "gan":
        layers = [{"w": [[0.1, 0.2]] * len(FEATS), "b": [0.0] * len(FEATS), "activation": "linear"}]
        args = {"layers": layers, "latent_dim": 2}
    assert untrained_generator is not None
    t = drop_time(fx.txn(spark, SF0001))
    fitted, trials = flows.optimize_model(
        spark, t, FEATS, "lr", sampler, "f1", folds=2, parallelism=1, points=POINTS["lr"][1:], sampler_args=args
    )
    assert trials.count() == 1 and classify.score(fitted, t).count() == t.count()


def test_corrupt_model_raises(spark, tmpdir_path):
    import os

    place = f"{tmpdir_path}/model=lr/ovs=no_ovs/metric=f1"
    os.makedirs(place)
    assert sinks.load_model(str(tmpdir_path), "lr", "smote", "f1") is None
    with pytest.raises(Exception):
        sinks.load_model(str(tmpdir_path), "lr", None, "f1")


def test_deep_trees_raise():
    with pytest.raises(ValueError):
        classify.random_forest(max_depth=31)


def test_sgd_does_not_depend_on_partitions(spark):
    from raresift.operators.relational import drop_time

    t = drop_time(fx.txn(spark, SF0001))
    est = classify.sgd_logistic(iterations=6, step=0.1, mini_batch_fraction=0.5)
    got = []
    for n in (1, 4, 16):
        m = classify.fit(est, t.repartition(n), ["Amount", "V3"]).stages[-1]
        got.append([*m.getOrDefault(m.coefficients), m.getOrDefault(m.intercept)])
    assert got[0] == pytest.approx(got[1], rel=1e-9) and got[0] == pytest.approx(got[2], rel=1e-9)


def test_reconstruction_flow(spark):
    from raresift.plans import flows

    t = fx.txn(spark, SF0001).select("row_id", *FEATS, "Class")
    flagged, m = flows.reconstruction_flow(t, FEATS, latent=[1, 2], method="percentile")
    assert flagged.count() == splits.stratified_split(t).where("is_test").count()
    assert m.count() == 1
