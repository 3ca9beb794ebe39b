"""Registered queries that run the scoring operators on Structured Streaming:
the events table is read as a file stream, scored and flagged, written to a
file sink with a checkpoint (``trigger(availableNow=True)``), and the sink is
read back as a table.  Same oracles as the batch versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from raresift.operators import anomaly, stats
from raresift.operators.relational import apply_threshold, normal_only
from raresift.plans.anomaly_queries import _AE, _AE_CTES, AE_LAYERS, FEATS, ae_errors
from raresift.plans.catalog import R, register, rounded
from raresift.session import checkpoint_dir
from raresift.sources import fixtures as fx
from raresift.streaming import scoring


def _events_stream(spark, sf):
    batch = fx.table(spark, sf, "events")
    # a glob: file streams read directories or patterns, not a bare file
    return scoring.read_stream(spark, f"{sf.rstrip('/')}/events.parq*", batch)


def _run(spark, df):
    sink = f"{checkpoint_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    q = scoring.write_stream(df, sink, f"{sink}-checkpoint")
    q.awaitTermination()
    return spark.read.parquet(sink)


@register(
    "stream_scored_flags",
    fx.with_ctes(
        ["scored"],
        "SELECT row_id, label, score, CAST(score >= 0.5 AS INTEGER) AS prediction, "
        "CAST(score > 0.5 AS INTEGER) AS flagged FROM scored",
    ),
)
def q_stream_scored(spark, sf):
    s = fx.scored_from_txn(fx.txn_from_events(_events_stream(spark, sf)))
    s = apply_threshold(s, 0.5)
    s = apply_threshold(s, 0.5, out_col="flagged", inclusive=False)
    return _run(spark, s)


@register(
    "stream_anomaly_flags",
    fx.with_ctes(
        ["txn"],
        f"SELECT row_id, {R('recon_error')} AS recon_error, CAST(recon_error > t AS INTEGER) AS predicted_fraud "
        f"FROM {_AE} CROSS JOIN (SELECT quantile_cont(recon_error, 0.99) AS t FROM {_AE})",
        _AE_CTES,
    ),
)
def q_stream_anomaly(spark, sf):
    # scaler and threshold come from the batch table (the "trained" state);
    # the stream applies them to arriving rows
    t = fx.txn(spark, sf).select("row_id", *FEATS, "Class")
    scaler = stats.fit_scaler(normal_only(t), FEATS)
    from raresift.operators import curves

    thr = curves.threshold_percentile(ae_errors(spark, sf), 99, score_col="recon_error").first()["threshold"]
    stream = fx.txn_from_events(_events_stream(spark, sf)).select("row_id", *FEATS, "Class")
    scaled = stats.transform_with_scaler(stream, scaler)
    flagged = scoring.anomaly_stream(scaled, FEATS, AE_LAYERS, float(thr))
    return rounded(_run(spark, flagged).select("row_id", "recon_error", "predicted_fraud"))
