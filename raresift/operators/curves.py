"""Precision-recall, ROC and cost curves, and threshold rules.

All curves start from the *score table*: one row per (group, distinct score)
with the positive and negative counts.  The grouping is a map-side-combined
aggregate, so a score value holding a third of all rows is one row after it.
Thresholds are the distinct scores; the rule is ``score >= threshold``; running
totals go from high to low score (two-level prefix, :mod:`raresift.functions.prefix`).

Argmax / argmin rules are ``min(struct(...))`` aggregates, which are partially
aggregated per task; no sort of the curve and no single-task window.
Ties are broken exactly as the numpy ``argmax``/``argmin`` over the reference's
array order:
- F1 (PR curve, ascending thresholds): first = lowest threshold;
- Youden J (ROC curve, descending thresholds): first = highest threshold;
- cost (PR order): first = lowest threshold.
Ranking keys are never rounded: each is a whole number or one quotient of whole
numbers (F1 = 2tp/(tp+fp+P)), so equal values compare equal and different ones
stay apart on tables of any size.

A missing score or label raises, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.functions.missing import required, required_number
from raresift.functions.prefix import quantile_cuts, range_count, running_totals


KINDS = ("pr_curve", "roc_curve", "cost_based", "percentile")


def unknown_kind(name: str) -> ValueError:
    return ValueError(f"no curve or threshold rule named {name!r}; known: {', '.join(KINDS)}")


def score_table(
    df: DataFrame,
    label_col: str = "label",
    score_col: str = "score",
    group_cols: Sequence[str] = (),
    float32: bool = False,
) -> DataFrame:
    """(group..., threshold, pos, neg): counts per distinct score."""
    y = required(F.col(label_col), f"label {label_col}")
    return df.groupBy(*group_cols, _score(score_col, float32).alias("threshold")).agg(
        F.count_if(y == 1).alias("pos"),
        F.count_if(y != 1).alias("neg"),
    )


def _score(score_col: str, float32: bool = False) -> Column:
    s = required_number(F.col(score_col), f"score {score_col}")
    return s.cast("float").cast("double") if float32 else s


def cumulative_table(
    df: DataFrame,
    label_col: str = "label",
    score_col: str = "score",
    group_cols: Sequence[str] = (),
    float32: bool = False,
    n_ranges: int | None = None,
) -> DataFrame:
    """Score table plus tp, fp (rows with score >= threshold), P, N and idx
    (1-based position in descending threshold order)."""
    st = score_table(df, label_col, score_col, group_cols, float32).withColumn("one", F.lit(1))
    # range cut points from the raw scores: a map-only pass (the score table
    # would need its shuffle first); cuts only steer the work balance
    n = n_ranges if n_ranges is not None else range_count(df.sparkSession)
    cuts = quantile_cuts(df.select(_score(score_col, float32).alias("threshold")), "threshold", n)
    cum = running_totals(
        st,
        "threshold",
        ["pos", "neg", "one"],
        partition_by=group_cols,
        descending=True,
        cuts=cuts,
        next_cols=("pos", "neg"),
    )
    return cum.select(
        *group_cols,
        "threshold",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("tot_pos").alias("P"),
        F.col("tot_neg").alias("N"),
        F.col("cum_one").alias("idx"),
        F.col("tot_one").alias("n_thresholds"),
        F.col("next_pos").alias("pos_next"),
        F.col("next_neg").alias("neg_next"),
    )


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def _recall() -> Column:
    # sklearn sets recall to 1 at every threshold when there is no positive
    return F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0))


def pr_curve(
    df: DataFrame,
    label_col: str = "label",
    score_col: str = "score",
    group_cols: Sequence[str] = (),
    closing_point: bool = False,
    **kw,
) -> DataFrame:
    """(group..., threshold, precision, recall), thresholds ascending.

    ``closing_point=True`` adds the (precision 1, recall 0) point with threshold
    1.0, as in the saved-curve form; the compute form has no such row."""
    cum = cumulative_table(df, label_col, score_col, group_cols, **kw)
    out = cum.select(*group_cols, "threshold", _precision().alias("precision"), _recall().alias("recall"))
    if closing_point:
        closing = (
            cum.select(*group_cols).distinct()
            if group_cols
            else df.sparkSession.range(1).select()
        ).select(*group_cols, F.lit(1.0).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
        out = out.unionByName(closing)
    return out


def cost_curve(
    df: DataFrame,
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    label_col: str = "label",
    score_col: str = "score",
    group_cols: Sequence[str] = (),
    closing_point: bool = False,
    **kw,
) -> DataFrame:
    """(group..., threshold, cost_metric): cost_fp*(1-precision) + cost_fn*(1-recall)."""
    pr = pr_curve(df, label_col, score_col, group_cols, closing_point=closing_point, **kw)
    return pr.select(
        *group_cols,
        "threshold",
        (F.lit(float(cost_fp)) * (1 - F.col("precision")) + F.lit(float(cost_fn)) * (1 - F.col("recall"))).alias(
            "cost_metric"
        ),
    )


def roc_curve(
    df: DataFrame,
    label_col: str = "label",
    score_col: str = "score",
    group_cols: Sequence[str] = (),
    drop_intermediate: bool = True,
    **kw,
) -> DataFrame:
    """(group..., threshold, fpr, tpr), thresholds descending, starting at
    (+inf, 0, 0).  With ``drop_intermediate`` a point is dropped when it is
    collinear with equal steps on both sides (the first and last are kept).

    The collinearity test needs the next point's counts, which the running
    totals carry along (no self-join, no global ``lead`` window)."""
    cum = cumulative_table(df, label_col, score_col, group_cols, **kw)
    pts = cum
    if drop_intermediate:
        pts = cum.where(
            (F.col("idx") == 1)
            | (F.col("idx") == F.col("n_thresholds"))
            | (F.col("pos_next") != F.col("pos"))
            | (F.col("neg_next") != F.col("neg"))
        )
    fpr = F.when(F.col("N") > 0, F.col("fp") / F.col("N"))
    tpr = F.when(F.col("P") > 0, F.col("tp") / F.col("P"))
    body = pts.select(*group_cols, "threshold", fpr.alias("fpr"), tpr.alias("tpr"))
    start = cum.where(F.col("idx") == 1).select(
        *group_cols,
        F.lit(float("inf")).alias("threshold"),
        F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"),
        F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"),
    )
    return start.unionByName(body)


# ---------------------------------------------------------------- rankings


def _f1_key() -> Column:
    # 2PR/(P+R) == 2tp/(tp+fp+P); 0 where undefined (tp = 0)
    return F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")), F.lit(0.0))


def _cost_key(cost_fp: float, cost_fn: float) -> Column:
    """P times the cost of a threshold, as one quotient; without positives the
    recall is 1 and the cost itself is the key."""
    tp, fp, p = (F.col(c).cast("double") for c in ("tp", "fp", "P"))
    total = F.lit(float(cost_fp)) * fp * p + F.lit(float(cost_fn)) * (p - tp) * (tp + fp)
    return F.when(F.col("P") > 0, total / (tp + fp)).otherwise(F.lit(float(cost_fp)) * fp / (tp + fp))


def _youden_key() -> Column:
    """P * N times the J of a threshold, a whole number (J itself is tp / P or
    -fp / N where the other class is empty)."""
    tp, fp, p, n = (F.col(c).cast("decimal(19,0)") for c in ("tp", "fp", "P", "N"))
    return tp * F.greatest(n, F.lit(1).cast("decimal(19,0)")) - fp * F.greatest(p, F.lit(1).cast("decimal(19,0)"))


def rule_value(method: str, sel: Column, cost_fp: float = 1.0, cost_fn: float = 5.0) -> Column:
    """The F1, J or cost of a selected struct (k1, ..., P, N)."""
    p, n = sel["P"].cast("double"), sel["N"].cast("double")
    if method == "pr_curve":
        return -sel["k1"]
    if method == "roc_curve":
        return -sel["k1"].cast("double") / (F.greatest(p, F.lit(1.0)) * F.greatest(n, F.lit(1.0)))
    return F.when(p > 0, sel["k1"] / p).otherwise(sel["k1"])


def selection_struct(method: str, cost_fp: float = 1.0, cost_fn: float = 5.0) -> Column:
    """``min(struct(key..., threshold, tp, fp))`` for a threshold rule."""
    carry = [F.col("threshold").alias("t"), *[F.col(c).alias(c) for c in ("tp", "fp", "P", "N")]]
    if method == "pr_curve":
        return F.min(F.struct((-_f1_key()).alias("k1"), F.col("threshold").alias("k2"), *carry))
    if method == "roc_curve":
        # the (+inf) starting point has J = 0 and is a candidate as in sklearn
        return F.min(F.struct((-_youden_key()).alias("k1"), (-F.col("threshold")).alias("k2"), *carry))
    if method == "cost_based":
        return F.min(F.struct(_cost_key(cost_fp, cost_fn).alias("k1"), F.col("threshold").alias("k2"), *carry))
    raise unknown_kind(method)


def best_threshold(
    df: DataFrame,
    method: str = "pr_curve",
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    label_col: str = "label",
    score_col: str = "score",
    group_cols: Sequence[str] = (),
    percentile: float = 99,
    **kw,
) -> DataFrame:
    """(group..., threshold, value): the chosen threshold and its rule value."""
    if method == "percentile":
        return threshold_percentile(df, percentile, score_col, group_cols, **kw).withColumn(
            "value", F.lit(None).cast("double")
        )
    cum = cumulative_table(df, label_col, score_col, group_cols, **kw)
    if method == "roc_curve":
        # the starting point (threshold +inf, J = 0) competes like in sklearn
        start = cum.where(F.col("idx") == 1).select(
            *group_cols,
            F.lit(float("inf")).alias("threshold"),
            F.lit(0).cast("long").alias("tp"),
            F.lit(0).cast("long").alias("fp"),
            "P",
            "N",
        )
        cum = cum.select(*group_cols, "threshold", "tp", "fp", "P", "N").unionByName(start)
    sel = selection_struct(method, cost_fp, cost_fn).alias("best")
    agg = cum.groupBy(*group_cols).agg(sel)
    value = rule_value(method, F.col("best"), cost_fp, cost_fn)
    return agg.select(*group_cols, F.col("best.t").alias("threshold"), value.alias("value"))


def best_threshold_f1(df: DataFrame, **kw) -> DataFrame:
    return best_threshold(df, "pr_curve", **kw)


def best_threshold_youden(df: DataFrame, **kw) -> DataFrame:
    return best_threshold(df, "roc_curve", **kw)


def best_threshold_cost(df: DataFrame, cost_fp: float = 1.0, cost_fn: float = 5.0, **kw) -> DataFrame:
    return best_threshold(df, "cost_based", cost_fp=cost_fp, cost_fn=cost_fn, **kw)


def threshold_percentile(
    df: DataFrame,
    p: float = 99,
    score_col: str = "score",
    group_cols: Sequence[str] = (),
    n_ranges: int | None = None,
) -> DataFrame:
    """(group..., threshold): exact linearly interpolated percentile (numpy's
    default) of the scores, distributed: counts per distinct value, running
    counts in ascending order, then the two order statistics around
    ``p/100*(n-1)`` picked by an aggregate."""
    counts = df.groupBy(*group_cols, _score(score_col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n = n_ranges if n_ranges is not None else range_count(df.sparkSession)
    cuts = quantile_cuts(df.select(_score(score_col).alias("v")), "v", n)  # map-only pass
    cum = running_totals(counts, "v", ["c"], partition_by=group_cols, cuts=cuts)
    q = float(p) / 100.0
    pos = F.lit(q) * (F.col("tot_c") - 1)
    lo = F.floor(pos)
    hi = F.ceil(pos)
    agg = cum.groupBy(*group_cols).agg(
        F.min(F.when(F.col("cum_c") > lo, F.col("v"))).alias("v_lo"),
        F.min(F.when(F.col("cum_c") > hi, F.col("v"))).alias("v_hi"),
        F.first(pos - lo).alias("frac"),
    )
    return agg.select(*group_cols, lerp(F.col("v_lo"), F.col("v_hi"), F.col("frac")).alias("threshold"))


def percentile_structs(p: float) -> tuple[Column, Column, Column]:
    """Aggregates over a cumulative table for the exact interpolated percentile
    of the scores behind it: (lower, upper) ``struct(threshold, tp, fp)`` around
    ``p/100*(n-1)`` and the fraction between them.  The ascending running count
    at a distinct score is ``n - (tp + fp) + (pos + neg)``."""
    n = F.col("P") + F.col("N")
    asc = n - (F.col("tp") + F.col("fp")) + (F.col("pos") + F.col("neg"))
    pos = F.lit(float(p) / 100.0) * (n - 1)
    point = F.struct("threshold", "tp", "fp")
    return (
        F.min(F.when(asc > F.floor(pos), point)),
        F.min(F.when(asc > F.ceil(pos), point)),
        F.first(pos - F.floor(pos)),
    )


def lerp(a: Column, b: Column, t: Column) -> Column:
    # numpy lerp: a + (b-a)*t, computed from the upper end when t >= 0.5
    return F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)


def curve_values(df: DataFrame, kind: str = "pr_curve", cost_fp: float = 1.0, cost_fn: float = 10.0, **kw) -> DataFrame:
    """Dispatcher over the curve kinds; 'percentile' returns the scores themselves."""
    if kind == "pr_curve":
        return pr_curve(df, **kw)
    if kind == "roc_curve":
        return roc_curve(df, **kw)
    if kind == "cost_based":
        return cost_curve(df, cost_fp, cost_fn, **kw)
    if kind == "percentile":
        score_col = kw.get("score_col", "score")
        return df.select(*kw.get("group_cols", ()), F.col(score_col).alias("threshold"))
    raise unknown_kind(kind)
