"""Classification metrics as aggregates over (label, score) or (label, prediction).

Everything is one or two aggregations, grouped by optional experiment keys, so
a whole matrix of experiments is measured in one pass over the scored rows.
Zero-division rules follow the published sklearn definitions: precision,
recall and F1 are 0 when undefined; ROC AUC is NULL (undefined) with one class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.operators import curves


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion_counts(
    df: DataFrame, label_col: str = "label", pred_col: str = "prediction", group_cols: Sequence[str] = ()
) -> DataFrame:
    """(group..., tp, fp, tn, fn, n) from hard predictions."""
    y, p = F.col(label_col) == 1, F.col(pred_col) == 1
    return df.groupBy(*group_cols).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(y & ~p).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """accuracy, precision, recall, f1 from counts (0 when undefined)."""
    n = tp + fp + tn + fn
    return {
        "accuracy": F.try_divide(tp + tn, n),
        "precision": _z(F.try_divide(tp, tp + fp)),
        "recall": _z(F.try_divide(tp, tp + fn)),
        "f1_score": _z(F.try_divide(2 * tp, 2 * tp + fp + fn)),
    }


def classification_report(
    df: DataFrame, label_col: str = "label", pred_col: str = "prediction", group_cols: Sequence[str] = ()
) -> DataFrame:
    """(group..., tp, fp, tn, fn, accuracy, precision, recall, f1_score)."""
    cc = confusion_counts(df, label_col, pred_col, group_cols)
    r = rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return cc.select(*group_cols, "tp", "fp", "tn", "fn", *[v.alias(k) for k, v in r.items()])


def total_cost(
    df: DataFrame,
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    label_col: str = "label",
    score_col: str = "score",
    group_cols: Sequence[str] = (),
    threshold: float = 0.5,
    float32: bool = True,
) -> DataFrame:
    """FP*cost_fp + FN*cost_fn with predictions ``score >= threshold``."""
    s = F.col(score_col).cast("float") if float32 else F.col(score_col)
    pred = s >= F.lit(threshold)
    y = F.col(label_col) == 1
    return df.groupBy(*group_cols).agg(
        (F.count_if(~y & pred) * F.lit(float(cost_fp)) + F.count_if(y & ~pred) * F.lit(float(cost_fn))).alias("cost")
    )


def ranking_summary(cum: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., roc_auc, pr_auc, P, N) from a cumulative score table.

    roc_auc: trapezoid over the ROC points (ties count one half);
    pr_auc: average precision, sum over thresholds of (R_n - R_{n-1}) * P_n."""
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    agg = cum.groupBy(*group_cols).agg(
        F.sum(neg * (2 * tp - pos)).alias("_auc_num"),
        F.sum(pos * tp / (tp + fp)).alias("_ap_num"),
        F.max("P").alias("P"),
        F.max("N").alias("N"),
    )
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    return agg.select(
        *group_cols,
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_auc_num") / (2 * P * N)).alias("roc_auc"),
        F.when(F.col("P") > 0, F.col("_ap_num") / P).otherwise(F.lit(0.0)).alias("pr_auc"),
        "P",
        "N",
    )


def roc_auc(df: DataFrame, label_col="label", score_col="score", group_cols: Sequence[str] = (), **kw) -> DataFrame:
    cum = curves.cumulative_table(df, label_col, score_col, group_cols, **kw)
    return ranking_summary(cum, group_cols).select(*group_cols, "roc_auc")


def average_precision(
    df: DataFrame, label_col="label", score_col="score", group_cols: Sequence[str] = (), float32=False, **kw
) -> DataFrame:
    cum = curves.cumulative_table(df, label_col, score_col, group_cols, float32=float32, **kw)
    return ranking_summary(cum, group_cols).select(*group_cols, "pr_auc")


METRIC_COLUMNS = ["accuracy", "roc_auc", "pr_auc", "f1_score", "precision", "recall", "selected_threshold"]


THRESHOLD_METHODS = ("pr_curve", "cost_based", "roc_curve", "percentile")
TRAINING_METRICS = ("prauc", "f1", "precision", "recall", "cost")


def evaluate_many(
    df: DataFrame | None,
    methods: Sequence[str] = ("pr_curve",),
    threshold: float | None = None,
    cost_fp: float = 1.0,
    cost_fn: float = 3.0,
    percentile: float = 99,
    label_col: str = "label",
    score_col: str = "score",
    group_cols: Sequence[str] = (),
    n_ranges: int | None = None,
    cum: DataFrame | None = None,
) -> DataFrame:
    """Choose a threshold per method and measure at it: one row per
    (group..., metric) with accuracy, roc_auc, pr_auc, f1_score, precision,
    recall, selected_threshold.

    A manual ``threshold`` wins over every method; else ``pr_curve`` (best
    F1), ``cost_based`` (lowest cost), ``percentile``; any other name means
    0.5.  ``roc_curve`` (Youden J) is an extension over the inventory, where
    only curves and flags know that rule.  Predictions are
    ``score >= threshold``.

    One scan of the scored rows: the cumulative score table is built once
    (or passed in as ``cum``); ONE aggregate over it yields the AUCs and, for
    every method, the chosen threshold with its tp/fp (``min(struct)``
    selections and conditional maxima).  The per-group row is then exploded
    into one row per method -- no per-method re-scan, no join back to the rows.
    """
    gcols = list(group_cols)
    if cum is None:
        cum = curves.cumulative_table(df, label_col, score_col, gcols, n_ranges=n_ranges)
    pos, neg, tpd, fpd = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    aggs = [
        F.sum(neg * (2 * tpd - pos)).alias("_auc_num"),
        F.sum(pos * tpd / (tpd + fpd)).alias("_ap_num"),
        F.max("P").alias("P"),
        F.max("N").alias("N"),
    ]
    picks = {}
    for m in methods:
        if threshold is not None or m not in THRESHOLD_METHODS:
            t = float(0.5 if threshold is None else threshold)
            key = f"_fix_{len(picks)}"
            aggs += [
                F.coalesce(F.max(F.when(F.col("threshold") >= t, F.col("tp"))), F.lit(0)).alias(f"{key}_tp"),
                F.coalesce(F.max(F.when(F.col("threshold") >= t, F.col("fp"))), F.lit(0)).alias(f"{key}_fp"),
            ]
            picks[m] = (F.lit(t), F.col(f"{key}_tp"), F.col(f"{key}_fp"))
        elif m in ("pr_curve", "cost_based", "roc_curve"):
            aggs.append(curves.selection_struct(m, cost_fp, cost_fn).alias(f"_sel_{m}"))
            sel = F.col(f"_sel_{m}")
            if m == "roc_curve":
                # the (+inf, J = 0) starting point competes like in sklearn
                start = sel.isNull() | (sel["k1"] >= 0)
                picks[m] = tuple(
                    F.when(start, F.lit(zero)).otherwise(sel[c])
                    for c, zero in (("t", float("inf")), ("tp", 0), ("fp", 0))
                )
            else:
                picks[m] = (sel["t"], sel["tp"], sel["fp"])
        else:
            for name, agg in zip(("_lo", "_hi", "_frac"), curves.percentile_structs(percentile)):
                aggs.append(agg.alias(name))
            lo, hi = F.col("_lo"), F.col("_hi")
            t = curves.lerp(lo["threshold"], hi["threshold"], F.col("_frac"))
            # the first distinct score that reaches t is the lower or the upper one
            picks[m] = (t, *[F.when(t == lo["threshold"], lo[c]).otherwise(hi[c]) for c in ("tp", "fp")])
    base = cum.groupBy(*gcols).agg(*aggs) if gcols else cum.agg(*aggs)
    per_method = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("metric"), t.cast("double").alias("t"), tp.alias("tp"), fp.alias("fp"))
                for m, (t, tp, fp) in picks.items()
            ]
        )
    ).alias("_m")
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    rows = base.select(
        *gcols,
        per_method,
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_auc_num") / (2 * P * N)).alias("roc_auc"),
        F.when(F.col("P") > 0, F.col("_ap_num") / P).otherwise(F.lit(0.0)).alias("pr_auc"),
        "P",
        "N",
    )
    tp, fp = F.col("_m.tp"), F.col("_m.fp")
    r = rates(tp, fp, F.col("N") - fp, F.col("P") - tp)
    return rows.select(
        *gcols,
        F.col("_m.metric").alias("metric"),
        r["accuracy"].alias("accuracy"),
        "roc_auc",
        "pr_auc",
        r["f1_score"].alias("f1_score"),
        r["precision"].alias("precision"),
        r["recall"].alias("recall"),
        F.col("_m.t").alias("selected_threshold"),
    )


def evaluate(df: DataFrame, method: str = "default", **kw) -> DataFrame:
    """:func:`evaluate_many` for one method (no ``metric`` column)."""
    return evaluate_many(df, [method], **kw).drop("metric")


def compute_metrics(df: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """All metrics at a fixed threshold (``score >= threshold``)."""
    return evaluate(df, threshold=threshold, **kw)


def evaluate_metric(
    df: DataFrame,
    metric: str,
    cost_fp: float = 1.0,
    cost_fn: float = 5.0,
    label_col: str = "label",
    score_col: str = "score",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """One training metric per group: ``prauc`` on the scores, ``f1``,
    ``precision``, ``recall``, ``cost`` at ``score >= 0.5``.  Scores are first
    cast to float32, as the reference does before measuring."""
    if metric == "prauc":
        return average_precision(df, label_col, score_col, group_cols, float32=True).withColumnRenamed(
            "pr_auc", "value"
        )
    if metric == "cost":
        return total_cost(df, cost_fp, cost_fn, label_col, score_col, group_cols).withColumnRenamed("cost", "value")
    if metric not in ("f1", "precision", "recall"):
        raise ValueError(f"no training metric named {metric!r}; known: {', '.join(TRAINING_METRICS)}")
    pred = (F.col(score_col).cast("float") >= F.lit(0.5)).cast("int")
    rep = classification_report(df.withColumn("_pred", pred), label_col, "_pred", group_cols)
    col = {"f1": "f1_score", "precision": "precision", "recall": "recall"}[metric]
    return rep.select(*group_cols, F.col(col).alias("value"))


def is_larger_better(metric: str) -> bool:
    """Search direction: cost is minimised (the reference maximised it; see README)."""
    return metric != "cost"
