"""k-nearest join against brute force; sampler invariants and determinism."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import knn, resample
from raresift.operators.relational import append_synthetic
from raresift.sources import fixtures as fx

from paths import SF0001

FEATS = fx.FEATURES


def brute_knn(pts, k, exclude_self=True):
    ids = sorted(pts)
    out = {}
    for q in ids:
        ds = []
        for r in ids:
            if exclude_self and r == q:
                continue
            d = round(float(np.sqrt(np.sum((np.asarray(pts[q]) - np.asarray(pts[r])) ** 2))), 9)
            ds.append((d, r))
        out[q] = [r for _, r in sorted(ds)[:k]]
    return out


def test_knn_matches_brute_force_with_ties(spark):
    # a grid: many equal distances, so the id tie rule is exercised
    pts = {i: [float(i % 4), float(i // 4)] for i in range(24)}
    df = spark.createDataFrame([(i, p) for i, p in pts.items()], "row_id long, x array<double>")
    want = brute_knn(pts, 3)
    for block in (4096, 5):  # one cell, and a 5x5 grid of cells
        got = {}
        for r in knn.knn_join(df, df, 3, "x", block_rows=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["ref_id"])
        assert got == want


def test_knn_classify_share(spark):
    pts = [(0, [0.0], 1), (1, [0.1], 1), (2, [0.2], 0), (3, [5.0], 0), (4, [5.1], 0)]
    df = spark.createDataFrame(pts, "row_id long, x array<double>, Class int")
    s = {r["row_id"]: r["score"] for r in knn.knn_classify(df, df, 2, "x").collect()}
    assert s[0] == pytest.approx(0.5) and s[2] == pytest.approx(1.0) and s[3] == 0.0


def _txn(spark):
    return fx.txn(spark, SF0001).select("row_id", *FEATS, "Class")


def test_smote_balances_and_stays_in_segment(spark):
    t = _txn(spark)
    out = resample.smote(t, FEATS)
    counts = {r["Class"]: r["count"] for r in out.groupBy("Class").count().collect()}
    assert counts[0] == counts[1]
    syn = out.where("is_synthetic")
    mins = {r["row_id"]: r for r in t.where("Class = 1").collect()}
    # every synthetic point lies inside the bounding box of its source and the minority set
    for r in syn.limit(50).collect():
        a = mins[r["row_id"]]
        for c in FEATS:
            lo = min(m[c] for m in mins.values())
            hi = max(m[c] for m in mins.values())
            assert lo - 1e-9 <= r[c] <= hi + 1e-9
            assert r[c] is not None and a[c] is not None


def test_smote_deterministic_under_partitioning(spark):
    t = _txn(spark)
    a = sorted(tuple(r) for r in resample.smote(t, FEATS, keep_original=False).collect())
    b = sorted(tuple(r) for r in resample.smote(t.repartition(7), FEATS, keep_original=False).collect())
    assert a == b


def test_adasyn_near_balance(spark):
    t = _txn(spark)
    out = resample.adasyn(t, FEATS)
    counts = {r["Class"]: r["count"] for r in out.groupBy("Class").count().collect()}
    n_min = t.where("Class = 1").count()
    assert abs(counts[0] - counts[1]) <= n_min / 2


def test_svm_smote_exact_balance(spark):
    out = resample.svm_smote(_txn(spark), FEATS, svm_coefficients=[0.0, 0.0, 0.0, 0.02], svm_intercept=-2.0)
    counts = {r["Class"]: r["count"] for r in out.groupBy("Class").count().collect()}
    assert counts[0] == counts[1]


def test_generator_and_density_counts(spark):
    from raresift.plans.sampling_queries import untrained_generator

    t = _txn(spark)
    g = resample.generator_oversample(t, FEATS, untrained_generator(10, 4), 10)
    d = resample.density_oversample(t, FEATS, n_components=2)
    for out in (g, d):
        counts = {r["Class"]: r["count"] for r in out.groupBy("Class").count().collect()}
        assert counts[0] == counts[1]
    # tanh output layer: generated values lie in [-1, 1]
    assert g.where("is_synthetic").agg(F.max(F.abs("Amount"))).first()[0] <= 1.0


def test_append_synthetic_marks_rows(spark):
    t = _txn(spark)
    syn = resample.smote(t, FEATS, keep_original=False)
    both = append_synthetic(t, syn)
    assert both.where("NOT is_synthetic").count() == t.count()


def test_resample_registry(spark):
    t = _txn(spark)
    assert resample.resample(t, None, FEATS) is t
    with pytest.raises(ValueError):
        resample.resample(t, "unknown", FEATS)
    with pytest.raises(ValueError):
        resample.resample(t, "gan", FEATS)


def test_expand_is_exact(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, 25)], "row_id long, g long")
    out = resample.expand(df, "g", chunk=7)
    got = sorted((r["row_id"], r["j"]) for r in out.collect())
    assert got == [(2, j) for j in range(1, 4)] + [(3, j) for j in range(1, 26)]


def test_approximate_smote_runs_and_stays_minority(spark):
    t = _txn(spark)
    out = resample.smote(t, FEATS, keep_original=False, approximate=True)
    n_min = t.where("Class = 1").count()
    deficit = t.count() - 2 * n_min
    n = out.count()
    assert 0 <= n <= deficit and out.where("Class != 1").count() == 0
