"""Reconstruction-error anomaly scoring (inventory G1-G7).

Training the reference's torch auto-encoders is a one-device loop and is not
rebuilt (see README).  What a Spark user needs at scale is:

- G1 ``pca_reconstruction``: a *linear* auto-encoder spans the principal
  subspace (Baldi & Hornik 1989), so the latent-k model is a PCA fitted on the
  scaled normal rows (``pyspark.ml.feature.PCA``, a distributed fit);
- G2/G3 batch inference of supplied network weights (auto-encoder, VAE): the
  weights are a small fixed-size table shipped with the task, the forward
  pass is numpy over Arrow batches (pandas UDF);
- G4-G6 errors and losses as JVM-side array expressions and aggregates;
- G7 threshold and flag with the curve rules of :mod:`curves`.

Weights format: a list of layers ``{"w": out x in, "b": out, "activation":
"relu" | "tanh" | "sigmoid" | "linear"}``; a VAE is ``{"encoder": layers,
"mu": layer, "logvar": layer, "decoder": layers}``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift.functions.hashing import gaussian
from raresift.operators import curves
from raresift.operators.relational import apply_threshold

ACTIVATIONS = {
    "relu": lambda v: np.maximum(v, 0.0),
    "tanh": np.tanh,
    "sigmoid": lambda v: 1.0 / (1.0 + np.exp(-v)),
    "linear": lambda v: v,
}


def forward(layers: Sequence[dict], X: np.ndarray) -> np.ndarray:
    """Dense forward pass: X (n x in) through every layer."""
    h = np.asarray(X, dtype=np.float64)
    for layer in layers:
        W = np.asarray(layer["w"], dtype=np.float64)
        b = np.asarray(layer["b"], dtype=np.float64)
        h = ACTIVATIONS[layer.get("activation", "linear")](h @ W.T + b)
    return h


def _stack(s: pd.Series, width: int | None = None) -> np.ndarray:
    if len(s) == 0:
        return np.zeros((0, width or 0))
    return np.stack(s.to_numpy()).astype(np.float64)


def network_udf(layers: Sequence[dict]):
    """pandas UDF array<double> -> array<double> applying ``layers``."""
    layers = [dict(w=np.asarray(l["w"]).tolist(), b=np.asarray(l["b"]).tolist(), activation=l.get("activation", "linear")) for l in layers]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(x: pd.Series) -> pd.Series:
        out = forward(layers, _stack(x))
        return pd.Series(list(out))

    return apply


def vae_udf(weights: dict):
    """pandas UDF (x, eps) -> struct(xh, mu, logvar); eps = 0 gives the mean
    reconstruction."""
    enc, dec = weights["encoder"], weights["decoder"]
    mu_l, lv_l = weights["mu"], weights["logvar"]
    schema = T.StructType(
        [
            T.StructField("xh", T.ArrayType(T.DoubleType())),
            T.StructField("mu", T.ArrayType(T.DoubleType())),
            T.StructField("logvar", T.ArrayType(T.DoubleType())),
        ]
    )

    @F.pandas_udf(schema)
    def apply(x: pd.Series, eps: pd.Series) -> pd.DataFrame:
        X = _stack(x)
        h = forward(enc, X)
        mu = forward([mu_l], h)
        lv = forward([lv_l], h)
        E = _stack(eps, mu.shape[1]) if len(eps) else np.zeros_like(mu)
        z = mu + E * np.exp(0.5 * lv)
        xh = forward(dec, z)
        return pd.DataFrame({"xh": list(xh), "mu": list(mu), "logvar": list(lv)})

    return apply


def squared_error(x: Column, xh: Column) -> Column:
    """Per-row mean over features of (x - x_hat)^2 (G4), JVM-side."""
    sq = F.zip_with(x, xh, lambda a, b: (a - b) * (a - b))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def features_array(features: Sequence[str] | str) -> Column:
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def autoencoder_score(
    df: DataFrame, features: Sequence[str] | str, layers: Sequence[dict], out_col: str = "recon_error"
) -> DataFrame:
    """G2 + G4: reconstruction error of supplied auto-encoder weights
    (encoder and decoder layers in one list)."""
    x = features_array(features)
    staged = df.withColumn("_x", x)
    scored = staged.withColumn("_xh", network_udf(layers)(F.col("_x")))
    return scored.withColumn(out_col, squared_error(F.col("_x"), F.col("_xh"))).drop("_x", "_xh")


def vae_score(
    df: DataFrame,
    features: Sequence[str] | str,
    weights: dict,
    mode: str = "mean",
    seed: int = 42,
    id_col: str = "row_id",
    out_col: str = "recon_error",
    keep_latent: bool = False,
) -> DataFrame:
    """G3 + G4: VAE reconstruction error.  ``mode="mean"`` uses z = mu
    (deterministic); ``mode="sample"`` draws eps per row from hash normals of
    (seed, row id), so it is still reproducible (the reference draws fresh
    noise at every scoring)."""
    latent = len(weights["mu"]["b"])
    x = features_array(features)
    if mode == "sample":
        eps = F.array(*[gaussian(seed, "vae", F.col(id_col), i) for i in range(latent)])
    elif mode == "mean":
        eps = F.array(*[F.lit(0.0) for _ in range(latent)])
    else:
        raise ValueError("mode must be 'mean' or 'sample'")
    staged = df.withColumn("_x", x).withColumn("_o", vae_udf(weights)(F.col("_x"), eps))
    out = staged.withColumn(out_col, squared_error(F.col("_x"), F.col("_o.xh")))
    if keep_latent:
        out = out.withColumn("mu", F.col("_o.mu")).withColumn("logvar", F.col("_o.logvar")).withColumn(
            "xh", F.col("_o.xh")
        )
    return out.drop("_x", "_o")


def vae_loss(df: DataFrame, x_col: str = "x", xh_col: str = "xh", mu_col: str = "mu", logvar_col: str = "logvar") -> DataFrame:
    """Mean over all cells of (x - x_hat)^2 plus
    KL = -0.5 * sum(1 + logvar - mu^2 - exp(logvar)) / n_rows, one aggregate."""
    sq = F.aggregate(F.zip_with(F.col(x_col), F.col(xh_col), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    kl = F.aggregate(
        F.zip_with(F.col(mu_col), F.col(logvar_col), lambda m, lv: F.lit(1.0) + lv - m * m - F.exp(lv)),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    agg = df.agg(
        F.sum(sq).alias("_sq"), F.sum(F.size(F.col(x_col))).alias("_cells"), F.sum(kl).alias("_kl"), F.count(F.lit(1)).alias("_n")
    )
    return agg.select(
        (F.col("_sq") / F.col("_cells")).alias("recon_loss"),
        (F.lit(-0.5) * F.col("_kl") / F.col("_n")).alias("kl_div"),
        (F.col("_sq") / F.col("_cells") + F.lit(-0.5) * F.col("_kl") / F.col("_n")).alias("loss"),
    )


# ---------------------------------------------------------------- PCA (linear AE)


def fit_pca(normal: DataFrame, features: Sequence[str] | str, k: int) -> np.ndarray:
    """Principal axes (d x k) of the rows, fitted by ``pyspark.ml.feature.PCA``.
    Rows should be centred first (scaled by :func:`stats.standard_scale_all`):
    Spark's PCA does not centre."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    vecs = normal.select(array_to_vector(features_array(features)).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(vecs)
    return model.pc.toArray()  # d x k, tiny: only the axes reach the driver


def projection_udf(V: np.ndarray):
    """pandas UDF x -> x V V^T (reconstruction from the first k axes)."""
    P = np.asarray(V, dtype=np.float64) @ np.asarray(V, dtype=np.float64).T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(x: pd.Series) -> pd.Series:
        X = _stack(x, P.shape[0])
        return pd.Series(list(X @ P))

    return apply


def pca_reconstruction(
    df: DataFrame, features: Sequence[str] | str, V: np.ndarray, k: int | None = None, out_col: str = "recon_error"
) -> DataFrame:
    """G1 + G4: error of reconstructing each row from the first k principal axes."""
    Vk = V if k is None else V[:, :k]
    staged = df.withColumn("_x", features_array(features))
    out = staged.withColumn("_xh", projection_udf(Vk)(F.col("_x")))
    return out.withColumn(out_col, squared_error(F.col("_x"), F.col("_xh"))).drop("_x", "_xh")


def mean_reconstruction_error(df: DataFrame, error_col: str = "recon_error", fold_col: str = "fold") -> DataFrame:
    """Mean error per fold, then the mean over folds (one row)."""
    per_fold = df.groupBy(fold_col).agg(F.avg(error_col).alias("fold_error"))
    return per_fold.agg(F.avg("fold_error").alias("mean_error"), F.count(F.lit(1)).alias("n_folds"))


def detect_anomalies(
    scores: DataFrame,
    method: str = "pr_curve",
    error_col: str = "recon_error",
    label_col: str | None = "Class",
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    percentile: float = 99,
) -> DataFrame:
    """Pick the threshold on the errors -- ``pr_curve``, ``roc_curve`` or
    ``cost_based`` when labels are given, else the ``percentile`` -- and flag
    ``error > threshold`` (strict, as the reference's anomaly flag).  Adds
    ``threshold`` and ``predicted_fraud``."""
    if method in ("pr_curve", "roc_curve", "cost_based") and label_col is not None:
        t = curves.best_threshold(
            scores, method, cost_fp, cost_fn, label_col=label_col, score_col=error_col
        ).first()["threshold"]
    else:
        t = curves.threshold_percentile(scores, percentile, score_col=error_col).first()["threshold"]
    flagged = apply_threshold(scores, float(t), score_col=error_col, out_col="predicted_fraud", inclusive=False)
    return flagged.withColumn("threshold", F.lit(float(t)))
