"""Registered queries for the k-nearest join, kNN classification and the
samplers (inventory E0-E6, F2, B7), with DuckDB oracles where SQL can
reproduce them (md5 uniforms make the draws reproducible)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from raresift.functions.hashing import sql_hash_key, sql_uniform
from raresift.operators import knn, networks, resample, stats
from raresift.operators.kernel import FourierMap
from raresift.operators.relational import append_synthetic, minority_rows
from raresift.plans.catalog import R, register, rounded
from raresift.sources import fixtures as fx

SEED = 42
K = 5
FEATS = fx.FEATURES  # V1, V2, V3, Amount


# ---------------------------------------------------------------- kNN on vec


def _knn_vec_sql(dist: str) -> str:
    return fx.with_ctes(
        ["vec"],
        f"SELECT query_id, ref_id, CAST(rnk AS INTEGER) AS rank, {R('distance')} AS distance FROM ("
        f"SELECT q.row_id AS query_id, r.row_id AS ref_id, round({dist}, 9) AS distance, "
        f"row_number() OVER (PARTITION BY q.row_id ORDER BY round({dist}, 9), r.row_id) AS rnk "
        f"FROM vec q JOIN vec r ON q.row_id <> r.row_id) WHERE rnk <= {K}",
    )


EUCLID_VEC = "list_distance(q.x, r.x)"
MANHATTAN_VEC = "list_sum(list_transform(list_zip(q.x, r.x), lambda p: abs(p[1] - p[2])))"


@register("knn_join", _knn_vec_sql(EUCLID_VEC))
def q_knn(spark, sf):
    v = fx.vec(spark, sf)
    return rounded(knn.knn_join(v, v, K, "x"))


@register("knn_join_manhattan", _knn_vec_sql(MANHATTAN_VEC))
def q_knn_l1(spark, sf):
    v = fx.vec(spark, sf)
    return rounded(knn.knn_join(v, v, K, "x", metric="manhattan"))


@register(
    "knn_classify",
    fx.with_ctes(
        ["vec"],
        f"SELECT row_id, {R('score')} AS score, CAST(score > 0.5 AS INTEGER) AS prediction FROM ("
        "SELECT query_id AS row_id, avg(CAST(rc = 1 AS DOUBLE)) AS score FROM ("
        f"SELECT q.row_id AS query_id, r.\"Class\" AS rc, row_number() OVER (PARTITION BY q.row_id "
        f"ORDER BY round({EUCLID_VEC}, 9), r.row_id) AS rnk FROM vec q JOIN vec r ON q.row_id <> r.row_id) "
        f"WHERE rnk <= {K} GROUP BY 1)",
    ),
)
def q_knn_classify(spark, sf):
    v = fx.vec(spark, sf)
    return rounded(knn.knn_classify(v, v, K, "x"))


# ---------------------------------------------------------------- samplers on txn

_DIST_TXN = "round(sqrt(" + " + ".join(f"pow(q.{c} - r.{c}, 2)" for c in FEATS) + "), 9)"
_BAL = (
    'SELECT arg_min(label, struct_pack(n := n, l := label)) AS minority, min(n) AS n_min, '
    'max(n) - min(n) AS deficit FROM (SELECT "Class" AS label, count(*) AS n FROM txn GROUP BY 1)'
)
_MINS = 'SELECT row_id, V1, V2, V3, Amount FROM txn WHERE "Class" = (SELECT minority FROM bal)'
_NBR = (
    "SELECT q.row_id AS qid, " + ", ".join(f"r.{c} AS b_{c}" for c in FEATS) + ", "
    f"row_number() OVER (PARTITION BY q.row_id ORDER BY {_DIST_TXN}, r.row_id) AS rnk "
    "FROM mins q JOIN mins r ON q.row_id <> r.row_id"
)


def _gen_sql(tag: str, src: str) -> list[tuple[str, str]]:
    keff = "(SELECT least(5, n_min - 1) FROM bal)"
    gen = f"SELECT *, unnest(generate_series(1, g)) AS j FROM {src}"
    gen2 = (
        f"SELECT *, CAST(floor({sql_uniform(str(SEED), repr(tag + '-nn'), 'row_id', 'j')} * {keff}) + 1 AS BIGINT) AS nn, "
        f"{sql_uniform(str(SEED), repr(tag + '-gap'), 'row_id', 'j')} AS gap FROM gen"
    )
    return [("gen", gen), ("gen2", gen2)]


def _syn_select() -> str:
    cols = ", ".join(f"{R(f'g.{c} + gap * (n.b_{c} - g.{c})')} AS {c}" for c in FEATS)
    return (
        f"SELECT g.row_id, CAST(j AS INTEGER) AS syn_seq, {cols}, (SELECT minority FROM bal) AS \"Class\", "
        "TRUE AS is_synthetic FROM gen2 g JOIN nbr n ON n.qid = g.row_id AND n.rnk = g.nn"
    )


def smote_sql() -> str:
    rk = f"SELECT row_id, row_number() OVER (ORDER BY {sql_hash_key(str(SEED), repr('smote'), 'row_id')}, row_id) AS rk FROM mins"
    src = (
        "SELECT m.*, (SELECT deficit // n_min FROM bal) + CAST(rk.rk <= (SELECT deficit % n_min FROM bal) AS BIGINT) AS g "
        "FROM mins m JOIN rk USING (row_id)"
    )
    extra = [("bal", _BAL), ("mins", _MINS), ("nbr", _NBR), ("rk", rk), ("src", src)] + _gen_sql("smote", "src")
    return fx.with_ctes(["txn"], _syn_select(), extra)


def adasyn_sql() -> str:
    hard = (
        'SELECT q.row_id AS qid, r."Class" AS rc, '
        f"row_number() OVER (PARTITION BY q.row_id ORDER BY {_DIST_TXN}, r.row_id) AS rnk "
        'FROM mins q JOIN txn r ON q.row_id <> r.row_id'
    )
    cnt = "SELECT qid AS row_id, count_if(rc <> (SELECT minority FROM bal)) AS cnt FROM hard WHERE rnk <= 5 GROUP BY 1"
    src = (
        "SELECT m.*, CAST(round_even(cnt * (SELECT deficit FROM bal) / (SELECT CAST(sum(cnt) AS DOUBLE) FROM cnt), 0) AS BIGINT) AS g "
        "FROM mins m JOIN cnt USING (row_id)"
    )
    extra = [("bal", _BAL), ("mins", _MINS), ("nbr", _NBR), ("hard", hard), ("cnt", cnt), ("src", src)] + _gen_sql(
        "adasyn", "src"
    )
    return fx.with_ctes(["txn"], _syn_select(), extra)


def _txn_clean(spark, sf):
    return fx.txn(spark, sf).select("row_id", *FEATS, "Class")


@register("smote", smote_sql())
def q_smote(spark, sf):
    return rounded(resample.smote(_txn_clean(spark, sf), FEATS, seed=SEED, keep_original=False))


@register("adasyn", adasyn_sql())
def q_adasyn(spark, sf):
    return rounded(resample.adasyn(_txn_clean(spark, sf), FEATS, seed=SEED, keep_original=False))


_BALANCED_COUNTS = fx.with_ctes(
    ["txn"],
    'SELECT "Class", is_synthetic, count(*) AS n FROM (SELECT "Class", FALSE AS is_synthetic FROM txn '
    'UNION ALL SELECT minority, TRUE FROM bal, generate_series(1, deficit)) GROUP BY ALL',
    [("bal", _BAL)],
)


@register("append_synthetic_smote_counts", _BALANCED_COUNTS)
def q_smote_counts(spark, sf):
    t = _txn_clean(spark, sf)
    syn = resample.smote(t, FEATS, seed=SEED, keep_original=False)
    both = append_synthetic(t, syn)
    return both.groupBy("Class", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("svm_smote_counts", _BALANCED_COUNTS)
def q_svm_counts(spark, sf):
    out = resample.svm_smote(_txn_clean(spark, sf), FEATS, seed=SEED)
    return out.groupBy("Class", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("svm_smote")
def q_svm(spark, sf):
    return rounded(resample.svm_smote(_txn_clean(spark, sf), FEATS, seed=SEED, keep_original=False))


def untrained_generator(latent_dim: int, out_dim: int, seed: int = 42) -> list[dict]:
    """A generator of the reference's shape (latent -> 128 -> 256 -> d; ReLU,
    ReLU, Tanh) with uniform(-1/sqrt(in), 1/sqrt(in)) initial weights -- the
    reference's GAN search saves such untrained generators."""
    rng = np.random.default_rng(seed)
    dims = [latent_dim, 128, 256, out_dim]
    acts = ["relu", "relu", "tanh"]
    layers = []
    for i, a in enumerate(acts):
        bound = 1.0 / np.sqrt(dims[i])
        layers.append(
            dict(w=rng.uniform(-bound, bound, (dims[i + 1], dims[i])), b=rng.uniform(-bound, bound, dims[i + 1]), activation=a)
        )
    return layers


@register("generator_oversample_counts", _BALANCED_COUNTS)
def q_gen_counts(spark, sf):
    out = resample.generator_oversample(_txn_clean(spark, sf), FEATS, untrained_generator(10, len(FEATS)), 10, seed=SEED)
    return out.groupBy("Class", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("density_oversample_counts", _BALANCED_COUNTS)
def q_gmm_counts(spark, sf):
    out = resample.density_oversample(_txn_clean(spark, sf), FEATS, n_components=3, seed=SEED)
    return out.groupBy("Class", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("density_oversample")
def q_gmm(spark, sf):
    return rounded(resample.density_oversample(_txn_clean(spark, sf), FEATS, n_components=3, seed=SEED, keep_original=False))


# ---------------------------------------------------------------- SVM-SMOTE, fixed hyperplane

SVM_W, SVM_B, SVM_M = [0.0, 0.0, 0.0, 0.02], -2.0, 10


def svm_smote_sql(margin: str | None = None) -> str:
    margin = margin or f"({SVM_B!r})" + "".join(f" + {c} * ({w!r})" for c, w in zip(FEATS, SVM_W))
    sv = f"SELECT * FROM mins WHERE {margin} <= 1"
    near = (
        'SELECT q.row_id AS qid, r."Class" AS rc, '
        f"row_number() OVER (PARTITION BY q.row_id ORDER BY {_DIST_TXN}, r.row_id) AS rnk "
        "FROM sv q JOIN txn r ON q.row_id <> r.row_id"
    )
    maj = f"SELECT qid AS row_id, count_if(rc <> (SELECT minority FROM bal)) AS maj FROM near WHERE rnk <= {SVM_M} GROUP BY 1"
    bases = f"SELECT sv.*, maj < {SVM_M / 2!r} AS extra FROM sv JOIN maj USING (row_id) WHERE maj < {SVM_M}"
    rk = f"SELECT row_id, row_number() OVER (ORDER BY {sql_hash_key(str(SEED), repr('svmsmote'), 'row_id')}, row_id) AS rk FROM bases"
    src = (
        "SELECT b.*, (SELECT deficit // (SELECT count(*) FROM bases) FROM bal) + "
        "CAST(rk.rk <= (SELECT deficit % (SELECT count(*) FROM bases) FROM bal) AS BIGINT) AS g "
        "FROM bases b JOIN rk USING (row_id)"
    )
    nbr = (
        "SELECT q.row_id AS qid, " + ", ".join(f"r.{c} AS b_{c}" for c in FEATS) + ", "
        f"row_number() OVER (PARTITION BY q.row_id ORDER BY {_DIST_TXN}, r.row_id) AS rnk "
        "FROM bases q JOIN mins r ON q.row_id <> r.row_id"
    )
    extra = [("bal", _BAL), ("mins", _MINS), ("sv", sv), ("near", near), ("maj", maj), ("bases", bases), ("rk", rk),
             ("src", src), ("nbr", nbr)] + _gen_sql("svmsmote", "src")
    cols = ", ".join(
        f"{R(f'CASE WHEN extra THEN g.{c} + gap * 0.5 * (g.{c} - n.b_{c}) ELSE g.{c} + gap * (n.b_{c} - g.{c}) END')} AS {c}"
        for c in FEATS
    )
    body = (
        f"SELECT g.row_id, CAST(j AS INTEGER) AS syn_seq, {cols}, (SELECT minority FROM bal) AS \"Class\", "
        "TRUE AS is_synthetic FROM gen2 g JOIN nbr n ON n.qid = g.row_id AND n.rnk = g.nn"
    )
    return fx.with_ctes(["txn"], body, extra)


@register("svm_smote_fixed_plane", svm_smote_sql())
def q_svm_fixed(spark, sf):
    out = resample.svm_smote(
        _txn_clean(spark, sf), FEATS, m_neighbors=SVM_M, seed=SEED, keep_original=False,
        svm_coefficients=SVM_W, svm_intercept=SVM_B,
    )
    return rounded(out)


# ---------------------------------------------------------------- SVM-SMOTE, fixed kernel map and plane

KERNEL = FourierMap(
    np.array([[0.01, 0.0, 0.02, 0.004], [0.0, 0.05, -0.01, 0.006], [0.003, -0.02, 0.0, 0.01], [-0.004, 0.01, 0.03, -0.002]]),
    np.array([0.0, 0.5, 1.0, 4.0]),
)
KERNEL_W, KERNEL_B = [0.9, -0.7, 1.1, 0.5], 0.6


def _kernel_margin_sql() -> str:
    terms = []
    for row, phase, w in zip(KERNEL.frequencies.tolist(), KERNEL.phases.tolist(), KERNEL_W):
        angle = " + ".join(f"{c} * ({f!r})" for c, f in zip(FEATS, row))
        terms.append(f"({w!r}) * sqrt(2.0 / {len(KERNEL_W)}) * cos({angle} + {phase!r})")
    return f"({' + '.join(terms)} + {KERNEL_B!r})"


@register("svm_smote_fixed_kernel", svm_smote_sql(_kernel_margin_sql()))
def q_svm_kernel(spark, sf):
    out = resample.svm_smote(
        _txn_clean(spark, sf), FEATS, m_neighbors=SVM_M, seed=SEED, keep_original=False,
        svm_coefficients=KERNEL_W, svm_intercept=KERNEL_B, kernel_map=KERNEL,
    )
    return rounded(out)


# ---------------------------------------------------------------- adversarial generators

_WGAN = {"rounds": 2, "critic_iterations": 2, "clip": 0.5, "lr": 0.1}
_WGAN_GEN, _WGAN_CRITIC = [0.3, -0.2, 0.5, 0.1], [0.2, -0.4, 0.0]


def _wgan_sql() -> str:
    """A linear generator (1 -> 2) against a linear critic (2 -> 1): clipped
    critic steps and generator steps, then one made row for each missing one."""
    lr, clip = _WGAN["lr"], _WGAN["clip"]

    def normal(t: int | str, tag: str, key: str, *more: str) -> str:
        parts = [str(SEED), repr(tag), key, *([str(t)] if tag == "wgan" else []), *more]
        return f"(sqrt(-2.0 * ln(1.0 - {sql_uniform(*parts, repr('bm1'))})) * cos(2.0 * 3.141592653589793 * {sql_uniform(*parts, repr('bm2'))}))"

    w = ["g1", "g2", "o1", "o2", "c1", "c2", "c0"]
    start = [*_WGAN_GEN, *_WGAN_CRITIC]
    ctes = [
        ("bal", _BAL),
        ("real", 'SELECT row_id, V3 / 100 AS x1, Amount / 500 AS x2 FROM txn WHERE "Class" = (SELECT minority FROM bal)'),
        ("p0", "SELECT " + ", ".join(f"({v!r})::DOUBLE AS {n}, 0.0::DOUBLE AS r_{n}" for n, v in zip(w, start))),
    ]
    at = 0

    def step(slopes: dict[str, str], source: str, clipped: bool) -> None:
        nonlocal at
        cols = []
        for n in w:
            if n not in slopes:
                cols += [n, f"r_{n}"]
                continue
            r = f"0.99 * r_{n} + 0.01 * ({slopes[n]}) * ({slopes[n]})"
            new = f"{n} - {lr} * ({slopes[n]}) / (sqrt({r}) + 1e-8)"
            cols += [f"greatest(-{clip}, least({clip}, {new})) AS {n}" if clipped else f"{new} AS {n}", f"{r} AS r_{n}"]
        ctes.append((f"p{at + 1}", f"SELECT {', '.join(cols)} FROM p{at} CROSS JOIN {source}"))
        at += 1

    for r in range(_WGAN["rounds"]):
        for k in range(_WGAN["critic_iterations"]):
            t = r * _WGAN["critic_iterations"] + k
            ctes.append((f"m{t}", f"SELECT avg(x1) AS mx1, avg(x2) AS mx2, avg({normal(t, 'wgan', 'row_id', '0')}) AS mz FROM real"))
            step({"c1": "g1 * mz + o1 - mx1", "c2": "g2 * mz + o2 - mx2", "c0": "0.0"}, f"m{t}", True)
        step({"g1": "-c1 * mz", "g2": "-c2 * mz", "o1": "-c1", "o2": "-c2"}, f"m{t}", False)
    z = normal(0, "gen", "id", "0")
    body = (
        f"SELECT -(id + 1) AS row_id, {R(f'g1 * {z} + o1')} AS x1, {R(f'g2 * {z} + o2')} AS x2 "
        f"FROM (SELECT unnest(range((SELECT deficit FROM bal))) AS id) ids CROSS JOIN p{at}"
    )
    return fx.with_ctes(["txn"], body, ctes)


@register("wgan_steps", _wgan_sql())
def q_wgan_steps(spark, sf):
    """E4 trained: clipped critic and generator steps, then the sampler, equal to SQL."""
    t = fx.txn(spark, sf).select("row_id", (F.col("V3") / 100).alias("x1"), (F.col("Amount") / 500).alias("x2"), "Class")
    g, c = np.array(_WGAN_GEN), np.array(_WGAN_CRITIC)
    generator = [dict(w=g[:2].reshape(2, 1), b=g[2:], activation="linear")]
    critic = [dict(w=c[:2].reshape(1, 2), b=c[2:], activation="linear")]
    made, _, _ = networks.train_generator(minority_rows(t), ["x1", "x2"], "wgan", seed=SEED, generator=generator, critic=critic, **_WGAN)
    out = resample.generator_oversample(t, ["x1", "x2"], made, 1, seed=SEED, keep_original=False)
    return rounded(out.select("row_id", "x1", "x2"))


@register("gan_trained_oversample")
def q_gan_trained(spark, sf):
    """E4 with a generator trained on the scaled rare rows."""
    t = stats.standard_scale_all(_txn_clean(spark, sf))
    made, _, _ = networks.train_generator(minority_rows(t), FEATS, "gan", rounds=10, seed=SEED)
    return rounded(resample.generator_oversample(t, FEATS, made, 10, seed=SEED, keep_original=False))
