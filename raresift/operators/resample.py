"""Over-sampling of the rare class (inventory E1-E7, B7).

Contract: ``sampler(df, features, label_col, id_col, seed) -> df`` returning
the original rows plus synthetic minority rows, with ``is_synthetic`` and
``syn_seq`` (0 for originals, 1..g for the g rows made from one source row;
``row_id`` of a synthetic row is its source row).  Features may be several
scalar columns or one ``array<double>`` column.

Randomness is md5 of (seed, tag, row_id, j) (see
:mod:`raresift.functions.hashing`), never ``rand()``, so a resample is the
same under any partitioning and after task retries, and SQL can reproduce it.

SMOTE (Chawla et al. 2002): until the classes balance, each minority row
makes ``floor(deficit / n_min)`` rows, the ``deficit mod n_min`` rows with the
smallest hashes one more; row j of source a takes neighbour number
``1 + floor(u1 * k')`` of a's k' = min(k, n_min - 1) nearest minority rows and
``x = a + u2 * (b - a)``.

ADASYN (He et al. 2008): r_i = share of majority rows among a minority row's
k nearest rows in the whole table; g_i = round_half_even(cnt_i * deficit /
sum cnt) rows interpolated toward its minority neighbours.  sum r = 0 raises.
Balance is approximate by rounding, as published.

SVM-SMOTE (Nguyen et al. 2011): bases are minority support vectors of an SVM
with a radial kernel (random Fourier features and a linear solver, see
:mod:`raresift.operators.kernel`) or a linear one (margin <= 1); bases whose
m nearest rows are all majority are dropped; bases with at least half
majority neighbours interpolate toward minority neighbours, the others
extrapolate ``a + u * out_step * (a - b)``.  Rows are spread over the kept
bases as in SMOTE, so the result is exactly balanced.

A missing feature or label raises (see :mod:`raresift.functions.missing`).

Generation is a two-level expand: a source row with a huge count is first
split into chunks of ``CHUNK`` rows, the chunks are redistributed, then each
chunk explodes -- no task makes all rows of a hot source row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.functions.hashing import gaussian, uniform
from raresift.operators import hinge
from raresift.operators.kernel import FourierMap, draw_map, scale_gamma
from raresift.operators.knn import knn_join, packed
from raresift.operators.splits import first_n
from raresift.operators.stats import class_balance
from raresift.session import materialize, shuffle_partitions

CHUNK = 10_000
FEATURE_VEC = "_fx"


def _balance(df: DataFrame, label_col: str) -> dict:
    row = class_balance(df, label_col).first()  # one row of scalars
    return row.asDict()


def _unpack(df: DataFrame, features: Sequence[str] | str, vec: str) -> list[Column]:
    if isinstance(features, str):
        return [F.col(vec).alias(features)]
    return [F.col(vec)[i].alias(c) for i, c in enumerate(features)]


def expand(df: DataFrame, count_col: str, out_col: str = "j", chunk: int = CHUNK) -> DataFrame:
    """One row per j in 1..count (two-level, skew-safe)."""
    if chunk < 1:
        raise ValueError("chunk must be positive")
    chunks = df.where(F.col(count_col) > 0).withColumn(
        "_c", F.explode(F.sequence(F.lit(0), (F.ceil(F.col(count_col) / chunk) - 1).cast("long")))
    )
    spread = chunks.repartition(F.col("_c"), *[F.col(c) for c in df.columns[:1]])
    lo = F.col("_c") * chunk + 1
    hi = F.least(F.col(count_col), (F.col("_c") + 1) * chunk)
    return spread.withColumn(out_col, F.explode(F.sequence(lo, hi))).drop("_c")


def _neighbours(queries, refs, k, id_col, sizes=None, metric="euclidean", ref_cols=(), approximate=False, lsh_bucket=1.0):
    """Exact blocked kNN, or (opt-in) LSH approximate neighbours; queries for
    which LSH finds none get their exact ones."""
    if not approximate:
        return knn_join(queries, refs, k, FEATURE_VEC, id_col, metric, ref_cols=ref_cols, sizes=sizes)
    from raresift.operators.knn import approx_knn_join

    near = materialize(approx_knn_join(queries, refs, k, FEATURE_VEC, id_col, bucket_length=lsh_bucket, ref_cols=ref_cols))
    alone = materialize(queries.join(near.select(F.col("query_id").alias(id_col)).distinct(), id_col, "left_anti"))
    if alone.limit(1).count() == 0:
        return near
    return near.unionByName(knn_join(alone, refs, k, FEATURE_VEC, id_col, metric, ref_cols=ref_cols))


def _generate(
    sources: DataFrame,
    neighbours: DataFrame,
    seed: int,
    tag: str,
    id_col: str,
    extrapolate_col: str | None = None,
    out_step: float = 0.5,
) -> DataFrame:
    """Synthetic rows: sources (id, _fx, g[, extrapolate]) x j in 1..g, each
    toward neighbour number 1 + floor(u1 * k'), gap u2, with k' the number of
    neighbours the source has.

    The neighbours bring their vectors from the search (``ref_cols``).  Every
    source meets its (at most k) neighbours *before* it is expanded, as one array
    of vectors in rank order, so nothing is joined or shuffled after generation
    and a source with very many rows is no hot key."""
    near = neighbours.groupBy(F.col("query_id").alias(id_col)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", FEATURE_VEC))), lambda s: s[FEATURE_VEC]).alias("_near")
    )
    gen = expand(sources.join(near, id_col), "g")
    number = (F.floor(uniform(seed, tag + "-nn", F.col(id_col), F.col("j")) * F.size("_near")) + 1).cast("int")
    gen = gen.withColumn("_gap", uniform(seed, tag + "-gap", F.col(id_col), F.col("j"))).withColumn(
        "_bx", F.element_at("_near", number)
    )
    new = F.zip_with(F.col(FEATURE_VEC), F.col("_bx"), lambda a, b: a + F.col("_gap") * (b - a))
    if extrapolate_col is not None:
        extra = F.zip_with(F.col(FEATURE_VEC), F.col("_bx"), lambda a, b: a + F.col("_gap") * F.lit(out_step) * (a - b))
        new = F.when(F.col(extrapolate_col), extra).otherwise(new)
    return gen.select(F.col(id_col), F.col("j").alias("syn_seq"), new.alias(FEATURE_VEC))


def _minority(df: DataFrame, features, label_col: str, id_col: str, minority) -> DataFrame:
    """The packed minority rows (n_min of them), read once and kept in the
    shared checkpoint folder."""
    rows = df.where(F.col(label_col) == F.lit(minority))
    return materialize(rows.select(F.col(id_col), packed(df, features).alias(FEATURE_VEC)))


def _finish(
    df: DataFrame, synthetic: DataFrame, features, label_col: str, id_col: str, minority, keep_original: bool
) -> DataFrame:
    syn = synthetic.select(
        F.col(id_col),
        F.col("syn_seq").cast("int").alias("syn_seq"),
        *_unpack(synthetic, features, FEATURE_VEC),
        F.lit(minority).cast(df.schema[label_col].dataType).alias(label_col),
        F.lit(True).alias("is_synthetic"),
    )
    if not keep_original:
        return syn
    feat_cols = [features] if isinstance(features, str) else list(features)
    orig = df.select(
        F.col(id_col), F.lit(0).alias("syn_seq"), *feat_cols, F.col(label_col), F.lit(False).alias("is_synthetic")
    )
    return orig.unionByName(syn)


def smote(
    df: DataFrame,
    features: Sequence[str] | str,
    label_col: str = "Class",
    id_col: str = "row_id",
    k: int = 5,
    seed: int = 42,
    keep_original: bool = True,
    metric: str = "euclidean",
    approximate: bool = False,
) -> DataFrame:
    """E1 (see module doc).  Exactly balances the two classes.
    ``approximate=True`` finds neighbours with LSH (opt-in): the draw is among
    those found, so the classes still balance; only the neighbours differ."""
    bal = _balance(df, label_col)
    m, n_min, deficit = bal["minority"], bal["n_min"], bal["deficit"]
    if n_min < 2:
        raise ValueError("SMOTE needs at least two minority rows")
    k_eff = min(k, n_min - 1)
    mins = _minority(df, features, label_col, id_col, m)
    base, rem = divmod(int(deficit), int(n_min))
    extra = first_n(mins, id_col, seed, "smote", rem)  # the rem smallest hashes get one more
    sources = mins.select(id_col, FEATURE_VEC, (F.lit(base) + extra.cast("int")).alias("g"))
    nbrs = _neighbours(mins, mins, k_eff, id_col, (n_min, n_min), metric, ref_cols=[FEATURE_VEC], approximate=approximate)
    syn = _generate(sources, nbrs, seed, "smote", id_col)
    return _finish(df, syn, features, label_col, id_col, m, keep_original)


def adasyn(
    df: DataFrame,
    features: Sequence[str] | str,
    label_col: str = "Class",
    id_col: str = "row_id",
    k: int = 5,
    seed: int = 42,
    keep_original: bool = True,
    metric: str = "euclidean",
    approximate: bool = False,
) -> DataFrame:
    """E2 (see module doc).  ``approximate=True``: LSH neighbours (opt-in)."""
    bal = _balance(df, label_col)
    m, n_min, deficit = bal["minority"], bal["n_min"], bal["deficit"]
    if n_min < 2:
        raise ValueError("ADASYN needs at least two minority rows")
    allx = df.select(F.col(id_col), packed(df, features).alias(FEATURE_VEC), F.col(label_col))
    mins = _minority(df, features, label_col, id_col, m)
    hard = _neighbours(mins, allx, k, id_col, (n_min, bal["n"]), metric, ref_cols=[label_col], approximate=approximate)
    cnt = hard.groupBy(F.col("query_id").alias(id_col)).agg(F.count_if(F.col(label_col) != F.lit(m)).alias("_cnt"))
    # n_min rows, used twice (the total and the generation): computed once and
    # kept in the shared checkpoint folder, so the kNN join is not redone
    cnt = materialize(cnt)
    total = cnt.agg(F.sum("_cnt")).first()[0] or 0  # scalar
    if total == 0:
        raise ValueError("no minority row has a majority row among its nearest; ADASYN has no weights")
    g = F.bround(F.col("_cnt") * F.lit(int(deficit)) / F.lit(float(total)), 0).cast("long")
    sources = mins.join(cnt, id_col).select(id_col, FEATURE_VEC, g.alias("g"))
    k_eff = min(k, n_min - 1)
    nbrs = _neighbours(mins, mins, k_eff, id_col, (n_min, n_min), metric, ref_cols=[FEATURE_VEC], approximate=approximate)
    syn = _generate(sources, nbrs, seed, "adasyn", id_col)
    return _finish(df, syn, features, label_col, id_col, m, keep_original)


def svm_smote(
    df: DataFrame,
    features: Sequence[str] | str,
    label_col: str = "Class",
    id_col: str = "row_id",
    k: int = 5,
    m_neighbors: int = 10,
    out_step: float = 0.5,
    seed: int = 42,
    keep_original: bool = True,
    svm_coefficients: Sequence[float] | None = None,
    svm_intercept: float = 0.0,
    kernel: str = "rbf",
    components: int = 128,
    gamma: float | None = None,
    C: float = 1.0,
    kernel_map: FourierMap | None = None,
) -> DataFrame:
    """E3 (see module doc).  ``kernel`` is "rbf" (``components`` Fourier features;
    ``gamma`` 1 / (d * variance) unless given) or "linear".  A ``LinearSVC`` with
    penalty ``C`` is fitted on the (mapped) rows; ``svm_coefficients`` and
    ``svm_intercept`` fix its plane instead, on the features of ``kernel_map`` if
    there is one, else on the rows themselves.  On mapped rows the same solver
    runs without storing them (:mod:`raresift.operators.hinge`)."""
    if kernel not in ("rbf", "linear"):
        raise ValueError("kernel must be rbf or linear")
    bal = _balance(df, label_col)
    mcls, n_min, deficit = bal["minority"], bal["n_min"], bal["deficit"]
    if n_min < 2:
        raise ValueError("SVM-SMOTE needs at least two minority rows")
    allx = df.select(F.col(id_col), packed(df, features).alias(FEATURE_VEC), F.col(label_col))
    if svm_coefficients is None:
        label = (F.col(label_col) == F.lit(mcls)).cast("double").alias("y")
        if kernel == "rbf" and kernel_map is None:
            d = allx.select(F.size(FEATURE_VEC)).first()[0]
            kernel_map = draw_map(df.sparkSession, components, d, gamma or scale_gamma(allx, FEATURE_VEC), seed)
        if kernel_map:
            # the solver averages the losses
            svm_coefficients, svm_intercept = hinge.fit(allx.select(F.col(FEATURE_VEC).alias("x"), label), int(bal["n"]), kernel_map.values, 1.0 / (C * bal["n"]))
        else:
            from pyspark.ml.classification import LinearSVC
            from pyspark.ml.functions import array_to_vector

            svc = LinearSVC(labelCol="y", maxIter=100).fit(allx.select(array_to_vector(FEATURE_VEC).alias("features"), label))
            svm_coefficients, svm_intercept = svc.coefficients.toArray().tolist(), float(svc.intercept)
    if kernel_map:
        margin = kernel_map.margin(F.col(FEATURE_VEC), svm_coefficients, svm_intercept)
    else:
        margin = F.lit(float(svm_intercept))
        for i, w in enumerate(svm_coefficients):
            margin = margin + F.col(FEATURE_VEC)[i] * F.lit(float(w))
    mins = _minority(df, features, label_col, id_col, mcls)
    # minority support vectors: on or inside the margin (y = +1 side)
    sv = mins.where(margin <= 1)
    near = knn_join(sv, allx, m_neighbors, FEATURE_VEC, id_col, ref_cols=[label_col])
    share = near.groupBy(F.col("query_id").alias(id_col)).agg(
        F.count_if(F.col(label_col) != F.lit(mcls)).alias("_maj")
    )
    bases = sv.join(share, id_col).where(F.col("_maj") < m_neighbors).withColumn(
        "_extra", F.col("_maj") < F.lit(m_neighbors / 2.0)
    )
    bases = materialize(bases)  # at most n_min rows; counted, ranked and joined
    n_base = bases.count()
    if n_base == 0:
        raise ValueError("SVM-SMOTE found no usable support vector")
    base, rem = divmod(int(deficit), int(n_base))
    extra = first_n(bases, id_col, seed, "svmsmote", rem)
    sources = bases.select(id_col, FEATURE_VEC, "_extra", (F.lit(base) + extra.cast("int")).alias("g"))
    k_eff = min(k, n_min - 1)
    nbrs = knn_join(bases, mins, k_eff, FEATURE_VEC, id_col, ref_cols=[FEATURE_VEC], sizes=(n_base, n_min))
    syn = _generate(sources, nbrs, seed, "svmsmote", id_col, "_extra", out_step)
    return _finish(df, syn, features, label_col, id_col, mcls, keep_original)


# ---------------------------------------------------------------- generator / density


def _synthetic_ids(df: DataFrame, label_col: str, deficit: int) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    nparts = max(1, min(shuffle_partitions(spark), math.ceil(deficit / 10_000)))
    return spark.range(0, deficit, 1, nparts), nparts


def _finish_drawn(df, drawn, feats, label_col, id_col, mcls, keep_original):
    syn = drawn.select(
        (-(F.col("id") + 1)).alias(id_col),
        F.lit(1).alias("syn_seq"),
        *[F.col("_x")[i].alias(c) for i, c in enumerate(feats)],
        F.lit(mcls).cast(df.schema[label_col].dataType).alias(label_col),
        F.lit(True).alias("is_synthetic"),
    )
    if not keep_original:
        return syn
    orig = df.select(F.col(id_col), F.lit(0).alias("syn_seq"), *feats, F.col(label_col), F.lit(False).alias("is_synthetic"))
    return orig.unionByName(syn)


def generator_oversample(
    df: DataFrame,
    features: Sequence[str],
    layers: Sequence[dict],
    latent_dim: int,
    label_col: str = "Class",
    id_col: str = "row_id",
    seed: int = 42,
    keep_original: bool = True,
) -> DataFrame:
    """``deficit`` rows from a supplied generator network (GAN or WGAN
    generator; same arithmetic).

    ``layers`` = [{"w": out x in, "b": out, "activation": relu|tanh|linear}]:
    a fixed-size weight table shipped with the task closure.  Rows come from
    ``spark.range(deficit)`` spread over partitions; z ~ N(0, I) is drawn
    JVM-side from hash uniforms of (seed, row, i) (Box-Muller), so it does not
    depend on partitioning; the forward pass is a numpy pandas UDF over Arrow
    batches.  Synthetic ids are negative (-(i+1))."""
    from raresift.operators.anomaly import network_udf

    bal = _balance(df, label_col)
    mcls, deficit = bal["minority"], int(bal["deficit"])
    ids, _ = _synthetic_ids(df, label_col, deficit)
    z = F.array(*[gaussian(seed, "gen", F.col("id"), i) for i in range(latent_dim)])
    drawn = ids.select("id", network_udf(layers)(z).alias("_x"))
    return _finish_drawn(df, drawn, list(features), label_col, id_col, mcls, keep_original)


def density_oversample(
    df: DataFrame,
    features: Sequence[str],
    label_col: str = "Class",
    id_col: str = "row_id",
    n_components: int = 3,
    seed: int = 42,
    keep_original: bool = True,
) -> DataFrame:
    """E5: fit a Gaussian mixture to the minority rows (``pyspark.ml``), then
    draw ``deficit`` rows: component by weight, ``mu + L z`` with L the
    Cholesky factor of the component covariance; component choice and z are
    hash-derived per synthetic row, the affine map is a JVM-side expression."""
    import numpy as np
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    bal = _balance(df, label_col)
    mcls, deficit = bal["minority"], int(bal["deficit"])
    feats = list(features)
    mins = df.where(F.col(label_col) == F.lit(mcls))
    vecs = VectorAssembler(inputCols=feats, outputCol="features").transform(mins)
    gm = GaussianMixture(k=n_components, seed=seed, maxIter=100).fit(vecs)
    weights = np.asarray(gm.weights, dtype=float)
    cdf = np.cumsum(weights / weights.sum())
    comps = []
    for row in gm.gaussiansDF.collect():  # n_components rows: fixed size
        cov = row["cov"].toArray() + np.eye(len(feats)) * 1e-9
        comps.append((row["mean"].toArray(), np.linalg.cholesky(cov)))
    ids, _ = _synthetic_ids(df, label_col, deficit)
    u = uniform(seed, "gmm-c", F.col("id"))
    comp = F.lit(len(comps) - 1)
    for c in range(len(comps) - 2, -1, -1):
        comp = F.when(u < F.lit(float(cdf[c])), F.lit(c)).otherwise(comp)
    zs = [gaussian(seed, "gmm-z", F.col("id"), i) for i in range(len(feats))]
    staged = ids.select("id", comp.alias("_c"), *[z.alias(f"_z{i}") for i, z in enumerate(zs)])
    outs = []
    for j in range(len(feats)):
        per_comp = None
        for c, (mu, L) in enumerate(comps):
            val = F.lit(float(mu[j]))
            for i in range(j + 1):  # L is lower triangular
                val = val + F.lit(float(L[j, i])) * F.col(f"_z{i}")
            per_comp = val if per_comp is None else F.when(F.col("_c") == c, val).otherwise(per_comp)
        outs.append(per_comp)
    drawn = staged.select("id", F.array(*outs).alias("_x"))
    return _finish_drawn(df, drawn, feats, label_col, id_col, mcls, keep_original)


# ---------------------------------------------------------------- registry

SAMPLERS: dict[str, Callable] = {
    "smote": smote,
    "adasyn": adasyn,
    "svmsmote": svm_smote,
    "gmm": density_oversample,
}


def resample(df: DataFrame, method: str | None, features, **kw) -> DataFrame:
    """Apply a sampler by name; None means no resampling.  Unknown names
    raise (the reference silently skipped them).  'gan'/'wgan' need weights:
    call :func:`generator_oversample` with them."""
    if method is None or method == "none":
        return df
    if method in ("gan", "wgan"):
        if "layers" not in kw:
            raise ValueError("generator sampling needs trained generator weights (layers=...)")
        return generator_oversample(df, features, **kw)
    if method not in SAMPLERS:
        raise ValueError(f"unknown sampler {method!r}; choose from {sorted(SAMPLERS) + ['gan', 'wgan']}")
    return SAMPLERS[method](df, features, **kw)
