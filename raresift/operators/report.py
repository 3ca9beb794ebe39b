"""Reporting over results tables (inventory K1-K4).

The bar charts of the reference are not drawn; these operators return the
numbers behind them: per (metric, group) the mean, the spread and a
normal-theory 95 % interval (in place of seaborn's bootstrap interval).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.operators.relational import sort_results

PLOT_METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
Z95 = 1.959963984540054


def unpivot_metrics(results: DataFrame, id_cols: Sequence[str], metric_cols: Sequence[str] = PLOT_METRICS) -> DataFrame:
    """(id..., metric_name, value) long form; undefined (NULL) values are
    dropped, as a bar chart skips NaN."""
    long = results.unpivot(list(id_cols), list(metric_cols), "metric_name", "value")
    return long.where(F.col("value").isNotNull())


def metrics_summary(results: DataFrame, by: Sequence[str], metric_cols: Sequence[str] = PLOT_METRICS) -> DataFrame:
    """(metric_name, by..., mean, std, n, ci_low, ci_high)."""
    long = unpivot_metrics(results, by, metric_cols)
    agg = long.groupBy("metric_name", *by).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")
    )
    half = F.try_divide(F.lit(Z95) * F.coalesce(F.col("std"), F.lit(0.0)), F.sqrt(F.col("n")))
    return agg.select("metric_name", *by, "mean", "std", "n", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def metrics_by_oversampling(results: DataFrame, metric_cols: Sequence[str] = PLOT_METRICS) -> DataFrame:
    """K1: grouped by (oversampling, model)."""
    return metrics_summary(results, ["oversampling", "model"], metric_cols)


def metrics_by_model(results: DataFrame, metric_cols: Sequence[str] = PLOT_METRICS) -> DataFrame:
    """K2: grouped by (model, oversampling)."""
    return metrics_summary(results, ["model", "oversampling"], metric_cols)


def leaderboard(results: DataFrame, metric: str = "pr_auc", ascending: bool = False) -> DataFrame:
    """K3: the results table sorted by one of its columns."""
    return sort_results(results, metric, ascending)


def training_time_summary(run_log: DataFrame) -> DataFrame:
    """K4: value and elapsed seconds per (device, model, oversampling, metric)."""
    return run_log.groupBy("device", "model", "oversampling", "metric").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("value").alias("mean_value"),
        F.max("value").alias("best_value"),
        F.avg("elapsed_time_sec").alias("mean_elapsed_sec"),
        F.sum("elapsed_time_sec").alias("total_elapsed_sec"),
        F.max("ts").alias("last_run"),
    )
