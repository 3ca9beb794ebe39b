"""Deterministic train/test splits and folds (inventory D1-D3).

The reference's library RNG cannot be reproduced row for row, so the
contract is stratification + ratio + determinism.  Every row's place comes
from ``md5(seed | tag | row_id)`` (see :mod:`raresift.functions.hashing`), so
the split does not change with partitioning or task retries.

Two modes:
- ``exact``: the first ``ceil(test_size * n_class)`` rows of each class in
  (hash, id) order are the test part; folds are contiguous blocks of that
  order.  Cut rows are located by counting rows per 12-bit hash bucket, so
  the table is never sorted and splits/folds are projections
  (:func:`hash_cutoffs`);
- ``bernoulli``: ``u < test_size`` per row, no shuffle at all, ratio
  approximate.  The choice for very large tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raresift.functions.hashing import hash_key, uniform
from raresift.functions.missing import required


DIGITS = 3  # hex digits (12 bits) of the hash that each round resolves


def _any(conds):
    out = None
    for c in conds:
        out = c if out is None else out | c
    return out if out is not None else F.lit(False)


def hash_cutoffs(
    df: DataFrame, label_col: str, id_col: str, seed: int, tag: str, targets: dict
) -> dict:
    """For each class y and each target ``key -> position(n)`` in ``targets``
    (a function of the class size column, 1-based, in (md5(seed | tag | id),
    id) order within the class), the (hash, id) of the row at that position.
    Returns {y: {key: (hash, id)}}; positions <= 0 give no entry.

    Found without sorting the table: the leading hash bits are resolved 12 at
    a time, in two rounds.  The first counts rows per (class, 12-bit bucket) --
    at most classes x 4096 counts per task, map-side combined -- and, in the
    same job, derives each class size, each target position and the bucket that
    holds it (window over that bounded table); the second does the same inside
    the picked buckets.  Only the rows of the final buckets, one in 2^24 each, are
    ranked exactly, and only per-target scalars reach the driver.  Row ids must
    be unique."""
    spark = df.sparkSession
    ytype = dict(df.dtypes)[label_col]
    h = hash_key(seed, tag, F.col(id_col))
    base = df.select(required(F.col(label_col), f"label {label_col}").alias("_y"), F.col(id_col).alias("_id"), h.alias("_h"))

    def counts_for(cond, plen):
        counts = (
            (base.where(cond) if cond is not None else base)
            .groupBy("_y", F.substring("_h", 1, plen).alias("_pre"), F.substring("_h", plen + 1, DIGITS).alias("_b"))
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        w = Window.partitionBy("_y", "_pre").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("_cum", F.sum("_n").over(w))  # <= 4096 rows per (class, prefix)

    # round 1: class sizes, target positions and their buckets in one job
    cum = counts_for(None, 0).withColumn("_tot", F.sum("_n").over(Window.partitionBy("_y")))
    keys = list(targets)
    per_target = F.explode(
        F.array(*[F.struct(F.lit(i).alias("_p"), targets[key](F.col("_tot")).cast("long").alias("_r")) for i, key in enumerate(keys)])
    ).alias("_t")
    picks = (
        cum.select("*", per_target)
        .where((F.col("_t._r") > 0) & (F.col("_cum") >= F.col("_t._r")))
        .groupBy("_y", F.col("_t._p").alias("_p"))
        .agg(F.min(F.struct("_b", "_cum", "_n")).alias("k"), F.first("_t._r").alias("_r"))
        .collect()
    )
    state = {}
    for r in picks:
        k = r["k"]
        state[(r["_y"], r["_p"])] = (k["_b"], r["_r"] - (k["_cum"] - k["_n"]))
    plen = DIGITS

    def target_table():
        return spark.createDataFrame(
            [(y, pre, int(p), int(rem)) for (y, p), (pre, rem) in state.items()],
            f"_y {ytype}, _pre string, _p long, _r long",
        )

    def in_play():
        groups = sorted({(y, pre) for (y, _p), (pre, _r) in state.items()})
        return _any((F.col("_y") == F.lit(y)) & (F.substring("_h", 1, plen) == F.lit(pre)) for y, pre in groups)

    if state:  # round 2 inside the picked buckets
        cum2 = counts_for(in_play(), plen)
        picks = (
            cum2.join(F.broadcast(target_table()), ["_y", "_pre"])  # one row per target: bounded
            .where(F.col("_cum") >= F.col("_r"))
            .groupBy("_y", "_p")
            .agg(F.min(F.struct("_b", "_cum", "_n")).alias("k"), F.first("_pre").alias("_pre"), F.first("_r").alias("_r"))
            .collect()
        )
        for r in picks:
            k = r["k"]
            state[(r["_y"], r["_p"])] = (r["_pre"] + k["_b"], r["_r"] - (k["_cum"] - k["_n"]))
        plen = 2 * DIGITS
    out: dict = {}
    if state:
        w = Window.partitionBy("_y", "_pre").orderBy("_h", "_id")  # rows of the picked buckets only (bounded)
        ranked = base.where(in_play()).withColumn("_pre", F.substring("_h", 1, plen)).withColumn("_rn", F.row_number().over(w))
        rows = (
            ranked.join(F.broadcast(target_table()), ["_y", "_pre"])
            .where(F.col("_rn") == F.col("_r"))
            .select("_y", "_p", "_h", "_id")
            .collect()
        )
        for r in rows:
            out.setdefault(r["_y"], {})[keys[r["_p"]]] = (r["_h"], r["_id"])
    return out


def class_cutoffs(
    df: DataFrame, label_col: str, id_col: str, seed: int, tag: str, fraction: float | None = None,
    need: dict | None = None,
) -> dict:
    """Per class y, the (hash, id) of row ``ceil(fraction * n_y)`` (or the
    fixed position ``need`` for every class) in (md5, id) order."""
    if need is not None:
        pos = int(need)
        cuts = hash_cutoffs(df, label_col, id_col, seed, tag, {"cut": lambda n: F.lit(pos)})
    else:
        # same double arithmetic as SQL ceil(0.2 * n)
        cuts = hash_cutoffs(df, label_col, id_col, seed, tag, {"cut": lambda n: F.ceil(F.lit(float(fraction)) * n)})
    return {y: c["cut"] for y, c in cuts.items() if "cut" in c}


def _after(h: Column, id_col: str, cut: tuple) -> Column:
    hc, ic = cut
    return (h > F.lit(hc)) | ((h == F.lit(hc)) & (F.col(id_col) > F.lit(ic)))


def first_n(df: DataFrame, id_col: str, seed: int, tag: str, n: int) -> Column:
    """Boolean column: the row is among the first ``n`` rows of ``df`` in
    (md5(seed | tag | id), id) order -- found with :func:`class_cutoffs`,
    without sorting."""
    if n <= 0:
        return F.lit(False)
    cut = class_cutoffs(df.withColumn("_all", F.lit(0)), "_all", id_col, seed, tag, need=int(n))
    hc, ic = cut[0]
    h = hash_key(seed, tag, F.col(id_col))
    return (h < F.lit(hc)) | ((h == F.lit(hc)) & (F.col(id_col) <= F.lit(ic)))


def _before_cutoff(label_col: str, id_col: str, seed: int, tag: str, cut: dict):
    h = hash_key(seed, tag, F.col(id_col))
    cond = F.lit(False)
    for y, (hc, ic) in cut.items():
        cond = cond | (
            (F.col(label_col) == F.lit(y)) & ((h < F.lit(hc)) | ((h == F.lit(hc)) & (F.col(id_col) <= F.lit(ic))))
        )
    return cond


def stratified_split(
    df: DataFrame,
    label_col: str = "Class",
    id_col: str = "row_id",
    test_size: float = 0.2,
    seed: int = 42,
    mode: str = "exact",
    out_col: str = "is_test",
) -> DataFrame:
    """Add boolean ``is_test`` (D1): class ratio preserved in both parts."""
    if mode == "bernoulli":
        return df.withColumn(out_col, uniform(seed, "split", F.col(id_col)) < F.lit(float(test_size)))
    if mode != "exact":
        raise ValueError("mode must be 'exact' or 'bernoulli'")
    cut = class_cutoffs(df, label_col, id_col, seed, "split", test_size)
    return df.withColumn(out_col, _before_cutoff(label_col, id_col, seed, "split", cut))


def train_test(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(train, test) of :func:`stratified_split`."""
    s = stratified_split(df, **kw)
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")


def stratified_kfold(
    df: DataFrame,
    k: int = 5,
    label_col: str = "Class",
    id_col: str = "row_id",
    seed: int = 42,
    mode: str = "exact",
    out_col: str = "fold",
) -> DataFrame:
    """Add ``fold`` in [0, k) (D2), stratified.  Exact mode: inside each class,
    rows in (hash, id) order are cut into k contiguous blocks,
    ``fold = floor((rank - 1) * k / n_class)``, so every fold holds floor or
    ceil of n_class / k rows of each class.  The k - 1 block ends per class
    come from :func:`hash_cutoffs` (bucket counts, no sort) and the fold is
    then a projection.  ``mode="bernoulli"``: ``floor(u * k)``, no job at all."""
    if mode == "bernoulli":
        return df.withColumn(out_col, F.floor(uniform(seed, "fold", F.col(id_col)) * k).cast("int"))
    # end of block i: ((i+1) n + k - 1) // k, computed per class inside the job
    ends = {i: (lambda n, i=i: F.floor(((i + 1) * n + (k - 1)) / k)) for i in range(k - 1)}
    cuts = hash_cutoffs(df, label_col, id_col, seed, "fold", ends)
    h = hash_key(seed, "fold", F.col(id_col))
    fold = F.lit(0)
    for y, per in cuts.items():
        past = F.lit(0)
        for i in range(k - 1):
            if i in per:
                past = past + _after(h, id_col, per[i]).cast("int")
        fold = F.when(F.col(label_col) == F.lit(y), past).otherwise(fold)
    return df.withColumn(out_col, fold.cast("int"))


def kfold(df: DataFrame, k: int = 5, id_col: str = "row_id", seed: int = 42, out_col: str = "fold") -> DataFrame:
    """Unstratified ``fold`` in [0, k) from the hash uniform (D3); no shuffle."""
    return df.withColumn(out_col, F.floor(uniform(seed, "kfold", F.col(id_col)) * k).cast("int"))
