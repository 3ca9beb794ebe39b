"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.session import materialize, shuffle_partitions

__all__ = ["crc_text", "fresh", "materialize", "read", "release", "shuffle_partitions", "slices"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The whole table, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_text(c: Column) -> Column:
    """Unsigned CRC-32 of a column written as text (a null counts as '')."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files that nothing refers to
    any more.  It does so when the driver's garbage is collected, which a driver
    with little to do may put off for many rounds of an iterative job."""
    gc.collect()
    # the bridge to the JVM hands over what Python let go of about once a second
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.2)  # the cleaner works beside


def slices(batch, rows: int = 512):
    """The rows of an Arrow batch a few at a time, so that not all of its texts
    are Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (extra input columns may clash)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
