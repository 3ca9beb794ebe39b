"""The matrix of fitted models covers every model and every sampler."""

import numpy as np
from pyspark.sql import functions as F

from raresift.operators import classify, networks, resample
from raresift.plans import flows, model_queries
from raresift.sources import fixtures as fx

from paths import SF0001


def test_every_sampler_meets_every_model(spark, monkeypatch):
    svm, train_generator, seen = resample.svm_smote, networks.train_generator, []
    fixed = dict(svm_coefficients=[0.0] * len(fx.FEATURES), svm_intercept=0.0)  # the fits have tests of their own
    monkeypatch.setitem(resample.SAMPLERS, "svmsmote", lambda *a, **kw: svm(*a, **fixed, **kw))
    monkeypatch.setattr(networks, "train_generator", lambda *a, **kw: train_generator(*a, **{**kw, "rounds": 1}))

    def fit(est, df, features):
        if not any(df is d for _, d in seen[-1:]):
            seen.append((dict(df.groupBy("Class").count().collect()), df))
        return type(est).__name__

    monkeypatch.setattr(classify, "fit", fit)
    monkeypatch.setattr(classify, "with_score", lambda model, df, name: df.withColumn(name, F.round(F.col("Amount"), 1)))
    out = model_queries.q_matrix_models(spark, SF0001).collect()
    assert {(r["model"], r["oversampling"]) for r in out} == {(m, s or "none") for m in ("lr", "rf", "knn", "sgd", "xgboost") for s in flows.SAMPLERS}
    assert len(flows.SAMPLERS) == 6 and len(out) == 5 * 6 * len(model_queries._MATRIX_METHODS)
    counts = [c for c, _ in seen]
    assert len(counts) == 6 and counts[0][1] < counts[0][0] / 10
    assert all(c[0] == counts[0][0] and abs(c[1] - c[0]) <= counts[0][1] / 2 for c in counts[1:])  # ADASYN rounds


def test_made_rows_are_on_the_scale_of_the_training_rows(spark, monkeypatch):
    made = [dict(w=np.zeros((4, 10)), b=np.zeros(4), activation="tanh")]  # the centre of the scaled rows
    monkeypatch.setattr(networks, "train_generator", lambda *a, **kw: (made, None, None))
    t = fx.txn(spark, SF0001).select("row_id", *fx.FEATURES, "Class")
    new = model_queries._resampled(t, "gan").where("row_id < 0").agg(*[F.avg(c) for c in fx.FEATURES]).first()
    assert np.allclose(new, t.agg(*[F.avg(c) for c in fx.FEATURES]).first())
