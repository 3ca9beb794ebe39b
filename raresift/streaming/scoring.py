"""Scoring on Structured Streaming.

The reference scores saved test tables in batch.  Its scoring steps are
stateless per row -- fitted model or network forward pass, threshold, flag --
so the same operators run unchanged on a ``readStream`` source: new
transaction files are scored as they land, and the flagged rows are written
with a checkpoint in the cluster's shared checkpoint folder (exactly-once file
sink; a restarted query resumes where it stopped).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raresift.operators import anomaly
from raresift.operators.relational import apply_threshold


def score_stream(
    stream: DataFrame, model: PipelineModel, threshold: float = 0.5, keep: Sequence[str] = ("row_id",)
) -> DataFrame:
    """F6 + B8 + B10 on a stream: (keep..., score, prediction) with
    ``prediction = score >= threshold``."""
    out = model.transform(stream)
    from pyspark.ml.functions import vector_to_array

    s = vector_to_array(F.col("probability"))[1] if "probability" in out.columns else F.col("prediction").cast("double")
    scored = out.select(*keep, s.alias("score"))
    return apply_threshold(scored, threshold)


def flag_stream(stream: DataFrame, score: Column, threshold: float, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Flag rows of a stream whose score column expression passes ``threshold``
    (strict ``>``, the anomaly rule)."""
    scored = stream.select(*keep, score.alias("score"))
    return apply_threshold(scored, threshold, out_col="predicted_fraud", inclusive=False)


def anomaly_stream(
    stream: DataFrame, features: Sequence[str], layers: Sequence[dict], threshold: float, keep: Sequence[str] = ("row_id",)
) -> DataFrame:
    """G2 + G4 + flag on a stream (features already scaled)."""
    scored = anomaly.autoencoder_score(stream, features, layers).select(*keep, "recon_error")
    return apply_threshold(scored, threshold, score_col="recon_error", out_col="predicted_fraud", inclusive=False)


def write_stream(
    scored: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True, fmt: str = "parquet"
) -> StreamingQuery:
    """Start the file sink.  ``checkpoint`` names the query's own folder on
    shared storage; started again with it, the query resumes where it stopped."""
    writer = scored.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_stream(spark: SparkSession, path: str, like: DataFrame, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A file stream with the schema of a batch read of the same source."""
    reader = spark.readStream.format(fmt).schema(like.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
