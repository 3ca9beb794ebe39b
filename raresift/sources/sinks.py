"""Sinks and persisted artefacts (inventory A2-A5, A7-A9).

Everything is written with Spark's committers (a job either commits all its
files or none), partitioned by the keys the reference put into file names,
so a re-run of one day or one experiment replaces only its own partition
(``partitionOverwriteMode=dynamic``).
"""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CURVE_SUFFIX = {"pr_curve": "pr", "roc_curve": "roc", "cost_based": "cost"}

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("device", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("oversampling", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("elapsed_time_sec", T.DoubleType()),
    ]
)


def _writer(df: DataFrame, fmt: str, mode: str):
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    return w


def write_flagged(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A2: feature columns + ``recon_error`` + ``predicted_fraud`` (no index)."""
    _writer(df, fmt, mode).save(path)


def write_eval_results(results: DataFrame, path: str, run_date: str | None = None, fmt: str = "parquet") -> None:
    """A3: one row per (model, oversampling, metric) run, partitioned by run
    date (the reference's ``_{YYYY_MM_DD}`` file suffix)."""
    day = run_date or dt.date.today().strftime("%Y_%m_%d")
    out = results.withColumn("run_date", F.lit(day))
    # dynamic: overwrite only this run date's partition
    _writer(out, fmt, "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").save(path)


def append_run_log(
    spark: SparkSession, path: str, device: str, model: str, oversampling: str, metric: str,
    value: float, elapsed_time_sec: float, ts: dt.datetime | None = None, fmt: str = "parquet",
) -> None:
    """A4: append one row to the run log, partitioned by day (a new
    partition plays the role of the new file with a header)."""
    ts = ts or dt.datetime.now()
    row = [(ts, device, model, oversampling or "", metric or "", float(value), float(elapsed_time_sec))]
    df = spark.createDataFrame(row, RUN_LOG_SCHEMA).withColumn("run_date", F.date_format("ts", "yyyy_MM_dd"))
    _writer(df, fmt, "append").partitionBy("run_date").save(path)


def append_run_rows(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A4 for many rows with the columns of the run log."""
    out = rows.select(*[F.col(f.name).cast(f.dataType) for f in RUN_LOG_SCHEMA.fields])
    _writer(out.withColumn("run_date", F.date_format("ts", "yyyy_MM_dd")), fmt, "append").partitionBy("run_date").save(path)


def read_run_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema(T.StructType([*RUN_LOG_SCHEMA.fields, T.StructField("run_date", T.StringType())]))
    return reader.load(path)


def write_curve(curve: DataFrame, output_file: str, kind: str, fmt: str = "csv") -> str | None:
    """A5: save a PR, ROC or cost curve next to ``output_file`` with suffix
    ``_pr`` / ``_roc`` / ``_cost``; any other kind saves nothing (None)."""
    suffix = CURVE_SUFFIX.get(kind)
    if suffix is None:
        return None
    base = output_file[:-4] if output_file.endswith(".csv") else output_file
    target = f"{base}_{suffix}.csv"
    _writer(curve, fmt, "overwrite").save(target)
    return target


def model_path(root: str, model: str, oversampling: str | None, metric: str) -> str:
    return f"{root.rstrip('/')}/model={model}/ovs={oversampling or 'no_ovs'}/metric={metric}"


def save_model(model: PipelineModel, root: str, name: str, oversampling: str | None, metric: str) -> str:
    """Registry keyed (model, oversampling or ``no_ovs``, metric)."""
    path = model_path(root, name, oversampling, metric)
    model.write().overwrite().save(path)
    return path


def load_model(root: str, name: str, oversampling: str | None, metric: str) -> PipelineModel | None:
    """The saved model, or None when the key is absent (the run is skipped).
    A model that is there but cannot be read raises."""
    path = model_path(root, name, oversampling, metric)
    spark = SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return PipelineModel.load(path)


def write_best_params(spark: SparkSession, params: dict, model: str, path: str, run_params: dict | None = None) -> None:
    """Best hyper-parameters as a long table (model, param, value); the
    run parameters, if given, as JSON text beside it."""
    rows = [(model, str(k), json.dumps(v)) for k, v in sorted(params.items())]
    df = spark.createDataFrame(rows, "model string, param string, value string")
    df.write.mode("overwrite").json(f"{path.rstrip('/')}/best_params/model={model}")
    if run_params is not None:
        spark.createDataFrame([(model, json.dumps(run_params, sort_keys=True, default=str))], "model string, params string").write.mode(
            "overwrite"
        ).json(f"{path.rstrip('/')}/run_params/model={model}")


def save_scaler(scaler: DataFrame, path: str) -> None:
    """The fitted scaler (one row per column) stored with the model."""
    scaler.write.mode("overwrite").parquet(os.path.join(path, "scaler"))


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, "scaler"))
