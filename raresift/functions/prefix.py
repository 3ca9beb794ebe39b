"""Two-level running totals: cumulative sums without a single-task window.

A window with no ``partitionBy`` moves every row into one task.  Curves,
percentiles, exact stratified splits and the SMOTE remainder all need a running
total over a global order, so they share this helper:

1. cut the ordering key into ``R`` value ranges (cut points from
   ``approxQuantile``, or given; equal keys always land in the same range);
2. total each (group, range) -- a small table of ``groups x R`` rows;
3. exclusive prefix of those totals over the ranges (a window over the small
   table only);
4. join the offsets back and run the window *inside* each (group, range).

The result is exact whatever the cut points are; the cuts only decide how the
work is spread.  Nothing depends on ``spark_partition_id``, so a recomputed
task gives the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raresift.session import shuffle_partitions

RANGE_COL = "_rng"
# Ranges only spread the work, so their number is its own setting: the cut points
# sit on the driver and in the plan, and must not grow with the shuffle partitions.
MAX_RANGES = 512


def range_count(spark) -> int:
    """Ranges to cut an order into: one per shuffle partition, up to ``MAX_RANGES``."""
    return min(shuffle_partitions(spark), MAX_RANGES)


def quantile_cuts(df: DataFrame, col: str, n_ranges: int) -> list[float]:
    """Approximate ``n_ranges``-quantile cut points of ``col`` (scalars only reach the driver)."""
    if n_ranges <= 1:
        return []
    probs = [i / n_ranges for i in range(1, n_ranges)]
    cuts = df.approxQuantile(col, probs, 1.0 / (4 * n_ranges))
    return clean_cuts(cuts)


def clean_cuts(cuts: Sequence[float]) -> list[float]:
    return sorted({float(c) for c in cuts if c is not None and not math.isnan(c) and not math.isinf(c)})


def with_range(df: DataFrame, col: str, cuts: Sequence[float]) -> DataFrame:
    """Add ``_rng``: index of the value range of ``col``, monotone in ``col`` in
    Spark's order (NULL first, in range -1; NaN last)."""
    cuts = clean_cuts(cuts)
    if not cuts:
        return df.withColumn(RANGE_COL, F.lit(0))
    tmp = "_rng_in"
    bucketizer = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol=tmp, outputCol=RANGE_COL, handleInvalid="keep"
    )
    staged = df.withColumn(tmp, F.col(col).cast("double"))
    place = F.when(F.col(tmp).isNull(), F.lit(-1)).otherwise(F.coalesce(F.col(RANGE_COL).cast("int"), F.lit(-1)))
    return bucketizer.transform(staged).withColumn(RANGE_COL, place).drop(tmp)


def running_totals(
    df: DataFrame,
    order_col: str,
    value_cols: Sequence[str],
    partition_by: Sequence[str] = (),
    descending: bool = False,
    tiebreak: Sequence[Column] = (),
    cuts: Sequence[float] | None = None,
    range_col: str | None = None,
    n_ranges: int | None = None,
    next_cols: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<v>`` (inclusive running total in the given order, per
    ``partition_by`` group) and ``tot_<v>`` (group total) for each value column.

    ``order_col`` (plus ``tiebreak``) is the order; ``range_col`` (default
    ``order_col``) is the numeric key that is cut into ranges and must be
    monotone non-decreasing in that order.  Rows with equal order keys are
    ordered by ``tiebreak``; give a unique one when rows are not distinct.
    ``next_cols`` adds ``next_<v>``: the value of the next row in the order (NULL
    at the end), from the next row of the range or the first of the next range.
    The offsets table is broadcast explicitly only without groups (then it has
    one row per range).
    """
    pcols = list(partition_by)
    rcol = range_col or order_col
    if cuts is None:
        cuts = quantile_cuts(df, rcol, n_ranges if n_ranges is not None else range_count(df.sparkSession))
    # the range is never NULL, so both branches (totals and rows) keep
    # identical plans and Spark reuses the shared exchange
    ranged = with_range(df, rcol, cuts)

    firsts = []
    if next_cols:
        pick = F.max if descending else F.min
        firsts = [pick(F.struct(order_col, *next_cols)).alias("_first")]
    totals = ranged.groupBy(*pcols, RANGE_COL).agg(*[F.sum(v).alias(v) for v in value_cols], *firsts)
    rng_order = F.col(RANGE_COL).desc() if descending else F.col(RANGE_COL).asc()
    before = Window.partitionBy(*pcols).orderBy(rng_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*pcols)
    offsets = totals.select(
        *pcols,
        RANGE_COL,
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_off_{v}") for v in value_cols],
        *[F.sum(v).over(whole).alias(f"tot_{v}") for v in value_cols],
        *([F.lead("_first").over(Window.partitionBy(*pcols).orderBy(rng_order)).alias("_off_next")] if next_cols else []),
    )
    if not pcols:
        offsets = F.broadcast(offsets)  # one row per range; with groups AQE decides from measured sizes
    joined = ranged.join(offsets, on=[*pcols, RANGE_COL], how="inner")

    key = F.col(order_col).desc() if descending else F.col(order_col).asc()
    inside = (
        Window.partitionBy(*pcols, RANGE_COL)
        .orderBy(key, *tiebreak)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    following = Window.partitionBy(*pcols, RANGE_COL).orderBy(key, *tiebreak)
    out = joined.select(
        *[c for c in joined.columns if not c.startswith("_off_")],
        *[F.coalesce(F.lead(v).over(following), F.col("_off_next")[v]).alias(f"next_{v}") for v in next_cols],
        *[(F.col(f"_off_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}") for v in value_cols],
    )
    return out.drop(RANGE_COL)
