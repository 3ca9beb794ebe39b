"""Registered queries for reconstruction-error anomaly scoring (inventory
G1-G7, J5).  Network inference is checked against DuckDB with small networks
whose weights follow a fixed rule (the forward pass is then plain SQL); PCA
fits have rows-only checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from raresift.operators import anomaly, metrics, networks, select, splits, stats
from raresift.operators.relational import normal_only
from raresift.plans.catalog import R, register, rounded
from raresift.sources import fixtures as fx

FEATS = fx.FEATURES
SEED = 42


def rule_layer(n_in: int, n_out: int, act: str, salt: int = 0) -> dict:
    """Weights from a fixed rule: w[o][i] = ((7o + 3i + salt) mod 11 - 5) / 10."""
    w = [[((7 * o + 3 * i + salt) % 11 - 5) / 10.0 for i in range(n_in)] for o in range(n_out)]
    b = [((5 * o + salt) % 7 - 3) / 10.0 for o in range(n_out)]
    return dict(w=w, b=b, activation=act)


AE_LAYERS = [
    rule_layer(4, 3, "relu", 1), rule_layer(3, 2, "linear", 2), rule_layer(2, 3, "relu", 3), rule_layer(3, 4, "linear", 4),
]
VAE = dict(
    encoder=[rule_layer(4, 3, "relu", 5)],
    mu=rule_layer(3, 2, "linear", 6),
    logvar=rule_layer(3, 2, "linear", 7),
    decoder=[rule_layer(2, 3, "relu", 8), rule_layer(3, 4, "linear", 9)],
)


# ---------------------------------------------------------------- Spark side


def scaled_txn(spark, sf):
    """txn features scaled with statistics of the normal rows."""
    t = fx.txn(spark, sf).select("row_id", *FEATS, "Class")
    scaler = stats.fit_scaler(normal_only(t), FEATS)
    return stats.transform_with_scaler(t, scaler)


def ae_errors(spark, sf):
    return anomaly.autoencoder_score(scaled_txn(spark, sf), FEATS, AE_LAYERS).select("row_id", "Class", "recon_error")


# ---------------------------------------------------------------- SQL side


def _dense_sql(layer: dict, ins: list[str], prefix: str) -> list[str]:
    outs = []
    for o, (wrow, b) in enumerate(zip(layer["w"], layer["b"])):
        s = " + ".join(f"({w!r}) * {x}" for w, x in zip(wrow, ins)) + f" + ({b!r})"
        act = layer["activation"]
        if act == "relu":
            s = f"greatest({s}, 0.0)"
        elif act != "linear":
            raise ValueError(act)
        outs.append(f"{s} AS {prefix}{o}")
    return outs


def _net_ctes(layers, src: str, ins: list[str], keep: str, tag: str) -> tuple[list[tuple[str, str]], list[str], str]:
    ctes, cur, cur_src = [], ins, src
    for li, layer in enumerate(layers):
        name = f"{tag}{li}"
        outs = _dense_sql(layer, cur, f"{name}_")
        ctes.append((name, f"SELECT {keep}, {', '.join(outs)} FROM {cur_src}"))
        cur = [f"{name}_{o}" for o in range(len(layer["b"]))]
        keep = keep + ", " + ", ".join(cur)
        cur_src = name
    return ctes, cur, cur_src


_SCALED = (
    "SELECT row_id, \"Class\", "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS x{i}" for i, c in enumerate(FEATS))
    + " FROM txn CROSS JOIN (SELECT "
    + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
        for c in FEATS
    )
    + " FROM txn WHERE \"Class\" = 0)"
)
_X = [f"x{i}" for i in range(4)]
_KEEP = "row_id, \"Class\", " + ", ".join(_X)


def _err(outs: list[str]) -> str:
    return "(" + " + ".join(f"pow({x} - {o}, 2)" for x, o in zip(_X, outs)) + f") / {len(_X)}"


def ae_error_ctes() -> tuple[list[tuple[str, str]], str]:
    ctes, outs, last = _net_ctes(AE_LAYERS, "xs", _X, _KEEP, "ae")
    ctes = [("xs", _SCALED)] + ctes + [("err", f"SELECT row_id, \"Class\", {_err(outs)} AS recon_error FROM {last}")]
    return ctes, "err"


def vae_ctes() -> tuple[list[tuple[str, str]], str]:
    enc, h, last = _net_ctes(VAE["encoder"], "xs", _X, _KEEP, "enc")
    keep = _KEEP + ", " + ", ".join(h)
    mu = _dense_sql(VAE["mu"], h, "mu_")
    lv = _dense_sql(VAE["logvar"], h, "lv_")
    lat = ("lat", f"SELECT {keep}, {', '.join(mu + lv)} FROM {last}")
    keep2 = _KEEP + ", mu_0, mu_1, lv_0, lv_1"
    dec, outs, dlast = _net_ctes(VAE["decoder"], "lat", ["mu_0", "mu_1"], keep2, "dec")
    fin = ("verr", f"SELECT row_id, \"Class\", mu_0, mu_1, lv_0, lv_1, {', '.join(outs)}, {_err(outs)} AS recon_error, "
           f"{' + '.join(f'pow({x} - {o}, 2)' for x, o in zip(_X, outs))} AS sq FROM {dlast}")
    return [("xs", _SCALED)] + enc + [lat] + dec + [fin], "verr"


def _sql_gaussian(i: int) -> str:
    """DuckDB text of hashing.gaussian(42, 'vae', row_id, i)."""
    from raresift.functions.hashing import sql_uniform

    u1 = sql_uniform("42", "'vae'", "row_id", str(i), "'bm1'")
    u2 = sql_uniform("42", "'vae'", "row_id", str(i), "'bm2'")
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos({2.0 * 3.141592653589793!r} * {u2}))"


def vae_sampled_ctes() -> tuple[list[tuple[str, str]], str]:
    enc, h, last = _net_ctes(VAE["encoder"], "xs", _X, _KEEP, "senc")
    keep = _KEEP + ", " + ", ".join(h)
    mu = _dense_sql(VAE["mu"], h, "mu_")
    lv = _dense_sql(VAE["logvar"], h, "lv_")
    lat = ("slat", f"SELECT {keep}, {', '.join(mu + lv)} FROM {last}")
    z = ("sz", "SELECT " + _KEEP + ", " + ", ".join(
        f"mu_{j} + {_sql_gaussian(j)} * exp(0.5 * lv_{j}) AS z_{j}" for j in range(2)) + " FROM slat")
    dec, outs, dlast = _net_ctes(VAE["decoder"], "sz", ["z_0", "z_1"], _KEEP + ", z_0, z_1", "sdec")
    fin = ("serr", f"SELECT row_id, \"Class\", {_err(outs)} AS recon_error FROM {dlast}")
    return [("xs", _SCALED)] + enc + [lat, z] + dec + [fin], "serr"


_AE_CTES, _AE = ae_error_ctes()
_VAE_CTES, _VAE = vae_ctes()
_SVAE_CTES, _SVAE = vae_sampled_ctes()


# ---------------------------------------------------------------- queries


@register(
    "autoencoder_score",
    fx.with_ctes(["txn"], f"SELECT row_id, \"Class\", {R('recon_error')} AS recon_error FROM {_AE}", _AE_CTES),
)
def q_ae(spark, sf):
    return rounded(ae_errors(spark, sf))


@register(
    "vae_score",
    fx.with_ctes(["txn"], f"SELECT row_id, \"Class\", {R('recon_error')} AS recon_error FROM {_VAE}", _VAE_CTES),
)
def q_vae(spark, sf):
    out = anomaly.vae_score(scaled_txn(spark, sf), FEATS, VAE, mode="mean")
    return rounded(out.select("row_id", "Class", "recon_error"))


@register(
    "vae_score_sampled",
    fx.with_ctes(["txn"], f"SELECT row_id, \"Class\", {R('recon_error')} AS recon_error FROM {_SVAE}", _SVAE_CTES),
)
def q_vae_sample(spark, sf):
    out = anomaly.vae_score(scaled_txn(spark, sf), FEATS, VAE, mode="sample", seed=SEED)
    return rounded(out.select("row_id", "Class", "recon_error"))


@register(
    "vae_loss",
    fx.with_ctes(
        ["txn"],
        f"SELECT {R('sum(sq) / (4.0 * count(*))')} AS recon_loss, "
        f"{R('-0.5 * sum(1 + lv_0 - mu_0 * mu_0 - exp(lv_0) + 1 + lv_1 - mu_1 * mu_1 - exp(lv_1)) / count(*)')} AS kl_div, "
        f"{R('sum(sq) / (4.0 * count(*)) - 0.5 * sum(1 + lv_0 - mu_0 * mu_0 - exp(lv_0) + 1 + lv_1 - mu_1 * mu_1 - exp(lv_1)) / count(*)')} AS loss "
        f"FROM {_VAE}",
        _VAE_CTES,
    ),
)
def q_vae_loss(spark, sf):
    out = anomaly.vae_score(scaled_txn(spark, sf), FEATS, VAE, mode="mean", keep_latent=True)
    out = out.withColumn("x", F.array(*[F.col(c) for c in FEATS]))
    return rounded(anomaly.vae_loss(out))


@register(
    "detect_anomalies_percentile",
    fx.with_ctes(
        ["txn"],
        f"SELECT row_id, {R('recon_error')} AS recon_error, CAST(recon_error > t AS INTEGER) AS predicted_fraud, "
        f"{R('t')} AS threshold FROM {_AE} CROSS JOIN (SELECT quantile_cont(recon_error, 0.99) AS t FROM {_AE})",
        _AE_CTES,
    ),
)
def q_detect_pct(spark, sf):
    out = anomaly.detect_anomalies(ae_errors(spark, sf), "percentile", label_col=None, percentile=99)
    return rounded(out.select("row_id", "recon_error", "predicted_fraud", "threshold"))


_F1_SEL = (
    "SELECT threshold AS t FROM (SELECT threshold, "
    "sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, "
    "sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp, "
    "sum(pos) OVER () AS p FROM (SELECT recon_error AS threshold, count_if(\"Class\" = 1) AS pos, "
    f"count_if(\"Class\" <> 1) AS neg FROM {_AE} GROUP BY 1)) "
    "ORDER BY coalesce(2 * tp / nullif(tp + fp + p, 0), 0) DESC, threshold ASC LIMIT 1"
)


@register(
    "detect_anomalies_pr_curve",
    fx.with_ctes(
        ["txn"],
        f"SELECT row_id, {R('recon_error')} AS recon_error, CAST(recon_error > t AS INTEGER) AS predicted_fraud, "
        f"{R('t')} AS threshold FROM {_AE} CROSS JOIN ({_F1_SEL})",
        _AE_CTES,
    ),
)
def q_detect_pr(spark, sf):
    out = anomaly.detect_anomalies(ae_errors(spark, sf), "pr_curve", label_col="Class")
    return rounded(out.select("row_id", "recon_error", "predicted_fraud", "threshold"))


def _eval_ae_sql() -> str:
    from raresift.plans.evaluation_queries import eval_sql

    body = eval_sql("pr_curve", "aes")
    # eval_sql starts with WITH; splice the network CTEs in front
    ctes = ",\n".join(f"{n} AS ({q})" for n, q in [("txn", fx.TXN_SQL), *_AE_CTES])
    ctes += f",\naes AS (SELECT row_id, \"Class\" AS label, recon_error AS score FROM {_AE})"
    return body.replace("WITH ", "WITH " + ctes + ",\n", 1)


@register("evaluate_autoencoder", _eval_ae_sql())
def q_eval_ae(spark, sf):
    e = ae_errors(spark, sf).select("row_id", F.col("Class").alias("label"), F.col("recon_error").alias("score"))
    return rounded(metrics.evaluate(e, method="pr_curve"))


@register(
    "mean_reconstruction_error",
    fx.with_ctes(
        ["txn"],
        f"SELECT {R('avg(fe)')} AS mean_error, count(*) AS n_folds FROM (SELECT floor(u * 5) AS fold, avg(recon_error) AS fe "
        f"FROM (SELECT recon_error, (('0x' || substr(md5(concat_ws('|', '42', 'kfold', CAST(row_id AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0) AS u "
        f"FROM {_AE} WHERE \"Class\" = 0) GROUP BY 1)",
        _AE_CTES,
    ),
)
def q_mean_err(spark, sf):
    e = splits.kfold(normal_only(ae_errors(spark, sf)), 5, seed=SEED)
    return rounded(anomaly.mean_reconstruction_error(e))


@register("pca_reconstruction")
def q_pca(spark, sf):
    x = scaled_txn(spark, sf)
    V = anomaly.fit_pca(normal_only(x), FEATS, 2)
    return rounded(anomaly.pca_reconstruction(x, FEATS, V).select("row_id", "Class", "recon_error"))


_AXES = [[0.5, 0.5], [0.5, -0.5], [0.5, 0.5], [0.5, -0.5]]
_PARTS = {"x1": ("V1", 97), "x2": ("V2", 23), "x3": ("V3", 101), "x4": ("Amount", 503)}


def _axes_sql() -> str:
    names = list(_PARTS)
    p = [" + ".join(f"({v[k]!r}) * {n}" for n, v in zip(names, _AXES)) for k in range(2)]
    error = " + ".join(f"pow({n} - (({v[0]!r}) * p1 + ({v[1]!r}) * p2), 2)" for n, v in zip(names, _AXES))
    cols = ", ".join(f"{c} / {d} AS {n}" for n, (c, d) in _PARTS.items())
    body = f"SELECT row_id, {R(f'({error}) / 4')} AS recon_error FROM (SELECT *, {p[0]} AS p1, {p[1]} AS p2 FROM s)"
    return fx.with_ctes(["txn"], body, [("s", f"SELECT row_id, {cols} FROM txn")])


@register("pca_reconstruction_fixed_axes", _axes_sql())
def q_pca_axes(spark, sf):
    """G1 with given axes: projection, reconstruction and error, equal to SQL."""
    t = fx.txn(spark, sf).select("row_id", *[(F.col(c) / d).alias(n) for n, (c, d) in _PARTS.items()])
    return rounded(anomaly.pca_reconstruction(t, list(_PARTS), np.array(_AXES)).select("row_id", "recon_error"))


def vec_columns(spark, sf):
    """The 64-d vectors as scalar columns f0..f63 (the latent range 4..16 fits)."""
    names = [f"f{i}" for i in range(64)]
    return fx.vec(spark, sf).select("row_id", *[F.col("x")[i].alias(c) for i, c in enumerate(names)], "Class"), names


@register("reconstruction_search")
def q_recon_search(spark, sf):
    """J5 over the whole range of latent sizes, 4 to 16."""
    v, names = vec_columns(spark, sf)
    return rounded(select.reconstruction_search(normal_only(v), names, ks=select.latent_sizes(len(names)), k_folds=5, seed=SEED))


@register("reconstruction_flow")
def q_recon_flow(spark, sf):
    """Entry 3 end to end: PCA latent search over 4 to 16, test errors, F1
    threshold, flags; the metrics row (rows-only: the PCA fit is not SQL)."""
    from raresift.plans.flows import reconstruction_flow

    v, names = vec_columns(spark, sf)
    _, m = reconstruction_flow(v, names, method="pr_curve")
    return rounded(m)


# ---------------------------------------------------------------- trained networks

_STEP_RATE, _STEPS = 0.2, 3
_STEP_NET = [dict(w=[[0.5, -0.3]], b=[0.1], activation="relu"), dict(w=[[0.7], [-0.2]], b=[0.05, 0.0], activation="linear")]


def _steps_sql() -> str:
    """Gradient steps of a 2-1-2 auto-encoder, written out."""
    names = ["w1", "w2", "b", "v1", "v2", "c1", "c2"]
    start = [0.5, -0.3, 0.1, 0.7, -0.2, 0.05, 0.0]
    ctes = [
        ("s", 'SELECT row_id, Amount / 100 AS x1, V3 / 50 AS x2 FROM txn'),
        ("n0", "SELECT " + ", ".join(f"({v!r})::DOUBLE AS {n}" for n, v in zip(names, start))),
    ]
    for t in range(_STEPS):
        ctes.append((f"h{t}", f"SELECT s.*, n.*, w1 * x1 + w2 * x2 + b AS a, greatest(w1 * x1 + w2 * x2 + b, 0.0) AS h FROM s CROSS JOIN n{t} n"))
        ctes.append((f"d{t}", f"SELECT *, v1 * h + c1 - x1 AS e1, v2 * h + c2 - x2 AS e2, CASE WHEN a > 0 THEN (v1 * h + c1 - x1) * v1 + (v2 * h + c2 - x2) * v2 ELSE 0.0 END AS da FROM h{t}"))
        slopes = ["da * x1", "da * x2", "da", "e1 * h", "e2 * h", "e1", "e2"]
        ctes.append((f"n{t + 1}", "SELECT " + ", ".join(f"any_value({n}) - {_STEP_RATE} * avg({g}) AS {n}" for n, g in zip(names, slopes)) + f" FROM d{t}"))
    h = "greatest(w1 * x1 + w2 * x2 + b, 0.0)"
    error = f"(pow(v1 * {h} + c1 - x1, 2) + pow(v2 * {h} + c2 - x2, 2)) / 2"
    return fx.with_ctes(["txn"], f"SELECT row_id, {R(error)} AS recon_error FROM s CROSS JOIN n{_STEPS}", ctes)


@register("autoencoder_steps", _steps_sql())
def q_ae_steps(spark, sf):
    """G2's training: three full-batch steps, then scoring, equal to SQL."""
    t = fx.txn(spark, sf).select("row_id", (F.col("Amount") / 100).alias("x1"), (F.col("V3") / 50).alias("x2"))
    layers, _ = networks.train_autoencoder(t, ["x1", "x2"], layers=_STEP_NET, epochs=_STEPS, optimiser=networks.SGD(_STEP_RATE))
    return rounded(anomaly.autoencoder_score(t, ["x1", "x2"], layers).select("row_id", "recon_error"))


@register("autoencoder_trained")
def q_ae_trained(spark, sf):
    """G2 trained here: scaled normal rows, mini-batches, all rows scored."""
    x = scaled_txn(spark, sf)
    layers, _ = networks.train_autoencoder(normal_only(x), FEATS, latent=2, epochs=4, batch_rows=max(64, x.count() // 4), lr=0.01, seed=SEED)
    return rounded(anomaly.autoencoder_score(x, FEATS, layers).select("row_id", "Class", "recon_error"))


@register("vae_trained")
def q_vae_trained(spark, sf):
    """G3 trained here: noise redrawn by hash in every step."""
    x = scaled_txn(spark, sf)
    weights, _ = networks.train_vae(normal_only(x), FEATS, latent=2, epochs=10, lr=0.01, seed=SEED)
    return rounded(anomaly.vae_score(x, FEATS, weights).select("row_id", "Class", "recon_error"))
