"""Registered round-trip queries for the sinks and readers (A2, A3, A5, A6):
results are written with the library's sinks into the shared checkpoint
folder and read back with its readers; the oracle is the SQL of the data
that was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from raresift.operators import anomaly, curves
from raresift.plans.anomaly_queries import _AE, _AE_CTES, ae_errors
from raresift.plans.catalog import R, register, rounded
from raresift.plans.evaluation_queries import COST_FN, COST_FP, _cum_sql, experiment_matrix_sql
from raresift.session import checkpoint_dir
from raresift.sources import fixtures as fx
from raresift.sources import readers, sinks


def _scratch(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_PREC = R("tp / (tp + fp)")
_REC = R('CASE WHEN "P" > 0 THEN tp / "P" ELSE 1.0 END')
_CURVES_SQL = fx.with_ctes(
    ["scored"],
    "SELECT threshold, precision, recall, NULL::DOUBLE AS fpr, NULL::DOUBLE AS tpr, NULL::DOUBLE AS cost_metric, "
    "'fixed' AS model, 'none' AS oversampling, 'pr_curve' AS curve_type FROM ("
    f"SELECT threshold, {_PREC} AS precision, {_REC} AS recall FROM cum UNION ALL SELECT 1.0, 1.0, 0.0) "
    "UNION ALL "
    "SELECT threshold, NULL, NULL, fpr, tpr, NULL, 'fixed', 'none', 'roc_curve' FROM ("
    f"SELECT threshold, {R('fp / \"N\"')} AS fpr, {R('tp / \"P\"')} AS tpr FROM ("
    "SELECT *, lead(pos) OVER (ORDER BY threshold DESC) AS pn, lead(neg) OVER (ORDER BY threshold DESC) AS nn FROM cum) "
    "WHERE idx = 1 OR idx = nt OR pn <> pos OR nn <> neg UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0) "
    "UNION ALL "
    "SELECT threshold, NULL, NULL, NULL, NULL, cost_metric, 'fixed', 'none', 'cost_based' FROM ("
    f"SELECT threshold, {R(f'{COST_FP} * (1 - tp / (tp + fp)) + {COST_FN} * (1 - CASE WHEN \"P\" > 0 THEN tp / \"P\" ELSE 1.0 END)')} AS cost_metric FROM cum "
    f"UNION ALL SELECT 1.0, {R(f'{COST_FP} * (1 - 1.0) + {COST_FN} * (1 - 0.0)')})",
    _cum_sql(),
)


@register("saved_curves_roundtrip", _CURVES_SQL)
def q_curves_roundtrip(spark, sf):
    """A5 then A6: PR (saved form), ROC and cost curves written as CSV with
    the kind suffixes, read back with model/oversampling/kind from the names."""
    s = fx.scored(spark, sf)
    folder = _scratch(spark, "curves")
    base = f"{folder}/curves_fixed_none.csv"
    sinks.write_curve(rounded(curves.pr_curve(s, closing_point=True)), base, "pr_curve")
    sinks.write_curve(rounded(curves.roc_curve(s)), base, "roc_curve")
    sinks.write_curve(rounded(curves.cost_curve(s, COST_FP, COST_FN, closing_point=True)), base, "cost_based")
    back = readers.read_curves(spark, folder)
    cols = ["threshold", "precision", "recall", "fpr", "tpr", "cost_metric"]
    return back.select(*[F.col(c).cast("double").alias(c) for c in cols], "model", "oversampling", "curve_type")


@register(
    "write_flagged_roundtrip",
    fx.with_ctes(
        ["txn"],
        f"SELECT row_id, \"Class\", {R('recon_error')} AS recon_error, CAST(recon_error > t AS INTEGER) AS predicted_fraud "
        f"FROM {_AE} CROSS JOIN (SELECT quantile_cont(recon_error, 0.99) AS t FROM {_AE})",
        _AE_CTES,
    ),
)
def q_flagged_roundtrip(spark, sf):
    """A2: flagged rows (features' error and flag) written and read back."""
    flagged = anomaly.detect_anomalies(ae_errors(spark, sf), "percentile", label_col=None, percentile=99)
    path = _scratch(spark, "flagged")
    sinks.write_flagged(rounded(flagged.select("row_id", "Class", "recon_error", "predicted_fraud")), path)
    return spark.read.parquet(path)


@register(
    "eval_results_roundtrip",
    f"SELECT *, '2025_03_29' AS run_date FROM ({experiment_matrix_sql()})",
)
def q_eval_roundtrip(spark, sf):
    """A3: the experiment matrix written partitioned by run date, read back."""
    from raresift.operators.select import experiment_matrix
    from raresift.plans.evaluation_queries import _MATRIX_METHODS

    res = experiment_matrix(
        fx.scored_groups(spark, sf), methods=_MATRIX_METHODS, group_cols=["model", "oversampling"],
        cost_fp=COST_FP, cost_fn=COST_FN,
    )
    path = _scratch(spark, "results")
    sinks.write_eval_results(rounded(res), path, run_date="2025_03_29")
    back = spark.read.parquet(path)
    return back.withColumn("run_date", F.col("run_date").cast("string"))


_LOG = (
    "SELECT CAST(ts AS TIMESTAMP) AS ts, 'cpu' AS device, event_type AS model, 'o' || (user_id % 3) AS oversampling, "
    "'prauc' AS metric, value, CAST(event_id % 97 AS DOUBLE) AS elapsed_time_sec FROM events"
)


@register(
    "training_time_summary",
    "SELECT device, model, oversampling, metric, count(*) AS runs, "
    f"{R('avg(value)')} AS mean_value, {R('max(value)')} AS best_value, {R('avg(elapsed_time_sec)')} AS mean_elapsed_sec, "
    f"{R('sum(elapsed_time_sec)')} AS total_elapsed_sec FROM ({_LOG}) GROUP BY ALL",
)
def q_training_time(spark, sf):
    """A4 + K4: a run log with the values of ``events``, appended by day, read
    back and summarised."""
    from raresift.operators import report

    log = _scratch(spark, "runlog")
    fx.table(spark, sf, "events").createOrReplaceTempView("_run_events")
    sinks.append_run_rows(spark.sql(_LOG.replace("FROM events", "FROM _run_events")), log)
    return rounded(report.training_time_summary(sinks.read_run_log(spark, log)).drop("last_run"))


@register(
    "scaler_roundtrip",
    fx.with_ctes(
        ["txn"],
        f"SELECT row_id, {R('(Amount - (SELECT avg(Amount) FROM txn)) / (SELECT stddev_pop(Amount) FROM txn)')} AS Amount FROM txn",
    ),
)
def q_scaler_roundtrip(spark, sf):
    """A fitted scaler saved, loaded and applied."""
    from raresift.operators import stats

    t = fx.txn(spark, sf).select("row_id", "Amount")
    path = _scratch(spark, "scaler")
    sinks.save_scaler(stats.fit_scaler(t, ["Amount"]), path)
    return rounded(stats.transform_with_scaler(t, sinks.load_scaler(spark, path)))


@register(
    "best_params_roundtrip",
    fx.with_ctes(
        ["txn"],
        "SELECT 'knn' AS model, 'k' AS param, CAST(count(*) % 17 AS VARCHAR) AS value FROM txn "
        "UNION ALL SELECT 'knn', 'metric', '\"euclidean\"'",
    ),
)
def q_best_params(spark, sf):
    """Parameters (one of them from the table) written and read back."""
    path = _scratch(spark, "params")
    sinks.write_best_params(spark, {"k": fx.txn(spark, sf).count() % 17, "metric": "euclidean"}, "knn", path)
    return spark.read.json(f"{path}/best_params/model=knn").select("model", "param", "value")
