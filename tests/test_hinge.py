"""The support vector machine on rows that are mapped in every pass."""

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from raresift.operators import hinge, resample
from raresift.operators.kernel import FourierMap


def sample(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2]
    y = (x[:, 0] * x[:, 1] > 2).astype(float)
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(3)


def test_the_plane_is_that_of_the_library(spark):
    rng = np.random.default_rng(1)
    own = FourierMap(rng.normal(size=(20, 3)), rng.uniform(0, 6, 20))
    rows = sample(spark)
    for reg in (1 / 400, 0.1):
        w, b = hinge.fit(rows, 400, own.values, reg)
        svc = LinearSVC(labelCol="y", maxIter=100, regParam=reg, standardization=False).fit(rows.select(array_to_vector(own.mapped(F.col("x"))).alias("features"), "y"))
        assert np.allclose(w, svc.coefficients.toArray(), rtol=1e-7, atol=1e-8) and abs(b - svc.intercept) < 1e-8


def test_a_constant_feature_weighs_nothing(spark):
    own = FourierMap(np.array([[0.0, 0.0, 0.0], [1.0, 0.0, 0.3], [0.0, 0.5, 0.0]]), np.array([0.7, 0.0, 1.0]))
    w, b = hinge.fit(sample(spark), 400, own.values, 0.01)
    assert w[0] == 0.0 and np.isfinite(w).all() and np.isfinite(b)


def test_mapped_rows_are_never_stored(spark, monkeypatch):
    rows, kept = sample(spark, 3000), []
    monkeypatch.setattr(hinge, "materialize", lambda df: kept.append(df) or df)
    hinge.packed_blocks(rows, 3000)
    n, x = kept[0].agg(F.count(F.lit(1)), F.sum(F.length("x"))).first()
    assert x == 3000 * 3 * 8 and n <= 8  # the original features, a block a task


def test_no_rows_of_the_fit_reach_the_stored_blocks_of_the_library(spark, monkeypatch):
    import pyspark.ml.classification as ml

    monkeypatch.setattr(ml, "LinearSVC", None)  # would keep 128 numbers a row
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b), int(a + b > 2)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "row_id long, a double, b double, Class int")
    out = dict(resample.svm_smote(df, ["a", "b"]).groupBy("Class").count().collect())
    assert out[0] == out[1]
