"""Random Fourier features and the radial SVM-SMOTE."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import kernel, resample


def ring(n=900, seed=2):
    """The rare class is a disc inside the others: no plane parts them."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 2))
    r = np.hypot(*x.T)
    keep = (r < 0.8) | (r > 1.1)
    return x[keep], (r[keep] < 0.8).astype(int)


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))], "row_id long, a double, b double, Class int").repartition(3)


def test_products_approach_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    m = kernel.draw_map(spark, 4000, 3, 0.4, seed=3)
    z = m.values(x)
    want = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert abs(z @ z.T - want).max() < 0.1
    again = kernel.draw_map(spark, 4000, 3, 0.4, seed=3)
    assert (again.frequencies == m.frequencies).all() and (again.phases == m.phases).all()
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    assert kernel.scale_gamma(df, "x") == pytest.approx(1 / (3 * x.var()))
    w = rng.normal(size=4000)
    got = df.select("x", m.margin(F.col("x"), w, 0.5).alias("m"), m.mapped(F.col("x")).alias("z")).collect()
    for r in got:
        z = m.values(np.array([r["x"]]))[0]
        assert r["m"] == pytest.approx(z @ w + 0.5) and np.allclose(r["z"], z)


def test_support_vectors_of_a_disc(spark, monkeypatch):
    x, y = ring()
    df = frame(spark, x, y)
    seen = {}
    plain = kernel.FourierMap.margin

    def watched(self, vec, w, c):
        seen["margin"] = self.values(x) @ np.asarray(w) + c
        return plain(self, vec, w, c)

    monkeypatch.setattr(kernel.FourierMap, "margin", watched)
    syn = resample.svm_smote(df, ["a", "b"], keep_original=False, gamma=1.0)
    margin = seen["margin"]
    assert ((margin > 0) == (y == 1)).mean() > 0.97  # a plane would leave the disc out
    support = (y == 1) & (margin <= 1)
    r = np.hypot(*x.T)
    assert 3 <= support.sum() < (y == 1).sum() / 2
    assert r[support].min() > np.median(r[(y == 1) & ~support])  # they lie on the rim
    rows = syn.collect()
    assert len(rows) == (y == 0).sum() - (y == 1).sum()
    assert {s["row_id"] for s in rows} <= set(np.flatnonzero(support).tolist())
    assert all(math.hypot(s["a"], s["b"]) < 1.5 for s in rows)


def test_linear_kernel_stays_available(spark):
    x, y = ring(400)
    x = x + np.where(y == 1, 3, 0)[:, None]
    df = frame(spark, x, y)
    out = resample.svm_smote(df, ["a", "b"], kernel="linear")
    n = {r["Class"]: r["count"] for r in out.groupBy("Class").count().collect()}
    assert n[0] == n[1]
    with pytest.raises(ValueError):
        resample.svm_smote(df, ["a", "b"], kernel="cubic")
