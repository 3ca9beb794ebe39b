"""Statistics and scaling (inventory C1-C7).

Scaling uses the *population* standard deviation and divides by 1 for a
constant column; ``pyspark.ml.feature.StandardScaler`` uses the sample
deviation, so it is not used.  Statistics are one aggregate over the table;
only the per-column (mean, std) scalars reach the driver, and they are applied
as literals, so the scaled table is a plain projection (whole-stage codegen,
no join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raresift.functions.missing import required
from raresift.functions.prefix import quantile_cuts, range_count, running_totals


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: (column, mean, std) with population std, std 0 -> 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `m_{c}`, `s_{c}`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column, mean, std)")
    return long.select(
        "column",
        "mean",
        F.when((F.col("std") == 0) | F.col("std").isNull(), F.lit(1.0)).otherwise(F.col("std")).alias("std"),
    )


def transform_with_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Apply a fitted scaler table to (possibly unseen) rows.

    The scaler has one row per column -- a size fixed by the schema -- so it
    is collected as scalars and applied as literals."""
    stats = {r["column"]: (r["mean"], r["std"]) for r in scaler.collect()}
    return df.select(
        *[
            ((F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c) if c in stats else F.col(c)
            for c in df.columns
        ]
    )


def standard_scale(df: DataFrame, cols: Sequence[str] = ("Amount",), fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std on the given columns (C1); fit on ``fit_on`` if given,
    else on ``df`` itself (the reference fits on the whole table)."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    return transform_with_scaler(df, fit_scaler(fit_on if fit_on is not None else df, cols))


def standard_scale_all(
    df: DataFrame, label_col: str = "Class", exclude: Sequence[str] = ("row_id",), fit_on: DataFrame | None = None
) -> DataFrame:
    """C1 over every numeric feature."""
    from raresift.operators.relational import feature_columns

    return standard_scale(df, feature_columns(df, label_col, exclude), fit_on)


# ---------------------------------------------------------------- describe


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75), n_ranges: int | None = None
) -> DataFrame:
    """(column, p, value): exact linearly interpolated quantiles of many
    columns in one distributed pass.

    ``percentile`` (exact) keeps every value of a group in one buffer; here the
    columns are unpivoted, counted per distinct value (map-side combined),
    and running counts per column pick the two order statistics around
    ``p*(n-1)`` -- the same rule as numpy / pandas ``describe``."""
    long = unpivot_values(df, cols)
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
    n = n_ranges if n_ranges is not None else range_count(df.sparkSession)
    cuts = quantile_cuts(long, "v", n)  # from the raw values: a map-only pass
    cum = running_totals(counts, "v", ["c"], partition_by=["column"], cuts=cuts)
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("tot_c") - 1)
        aggs += [
            F.min(F.when(F.col("cum_c") > F.floor(pos), F.col("v"))).alias(f"a{i}"),
            F.min(F.when(F.col("cum_c") > F.ceil(pos), F.col("v"))).alias(f"b{i}"),
            F.first(pos - F.floor(pos)).alias(f"t{i}"),
        ]
    agg = cum.groupBy("column").agg(*aggs)  # every probability in one aggregate

    def lerp(i):
        a, b, t = F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"t{i}")
        return F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)

    per_p = F.explode(
        F.array(*[F.struct(F.lit(float(p)).alias("p"), lerp(i).alias("value")) for i, p in enumerate(probs)])
    ).alias("q")
    return agg.select("column", per_p).select("column", "q.p", "q.value")


def unpivot_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, v) long form of the non-null values of ``cols``."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {stack}) AS (column, v)").where(F.col("v").isNotNull())


STATS = ("count", "mean", "std", "min", "max")
QUARTILES = (0.25, 0.5, 0.75)


def _is_number(dtype: str) -> bool:
    return dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal")


def _value(c: str, dtype: str):
    """The value of a column, NaN counted as missing."""
    return F.when(~F.isnan(c), F.col(c)) if dtype in ("double", "float") else F.col(c)


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long-form describe (C4): (column, dtype, non_null, stat, value) with
    count, mean, std (sample), min, 25%, 50%, 75%, max per numeric column (also
    decimals; a column without values counts 0 and has NULL statistics) and the
    count alone for any other column.

    The basic statistics of all columns are one wide aggregate."""
    dtypes = dict(df.dtypes)
    cols = list(cols) if cols is not None else df.columns
    numeric = [c for c in cols if _is_number(dtypes[c])]
    aggs = []
    for i, c in enumerate(cols):
        v = _value(c, dtypes[c])
        aggs.append(F.count(v).alias(f"n{i}"))
        if c in numeric:
            d = v.cast("double")
            aggs += [F.avg(d).alias(f"mean{i}"), F.stddev_samp(d).alias(f"std{i}"), F.min(d).alias(f"min{i}"), F.max(d).alias(f"max{i}")]
    wide = df.agg(*aggs)

    def entry(i, c, stat, value):
        return F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"), F.col(f"n{i}").alias("non_null"), F.lit(stat).alias("stat"), value.alias("value"))

    rows = []
    for i, c in enumerate(cols):
        rows.append(entry(i, c, "count", F.col(f"n{i}").cast("double")))
        if c in numeric:
            rows += [entry(i, c, stat, F.col(f"{stat}{i}")) for stat in STATS[1:]]
            rows += [entry(i, c, f"{int(100 * p)}%", F.lit(None).cast("double")) for p in QUARTILES]
    told = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if not numeric:
        return told
    number = df.select(*[_value(c, dtypes[c]).cast("double").alias(c) for c in numeric])
    q = exact_quantiles(number, numeric, QUARTILES).select(
        "column", F.concat((F.col("p") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"), F.col("value").alias("_q")
    )
    # a few rows per column on both sides
    return told.join(F.broadcast(q), ["column", "stat"], "left").select(
        "column", "dtype", "non_null", "stat", F.coalesce("value", "_q").alias("value")
    )


# ---------------------------------------------------------------- class balance


def class_counts(df: DataFrame, label_col: str = "Class") -> DataFrame:
    y = required(F.col(label_col), f"label {label_col}")
    return df.groupBy(y.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label_col: str = "Class") -> DataFrame:
    """One row: minority, majority, n_min, n_max, deficit = n_max - n_min,
    n_classes, n (C5).  argmin/argmax over sorted labels: ties -> smaller label,
    via ``min(struct(count, label))`` (``min_by`` is not tie-safe)."""
    cc = class_counts(df, label_col)
    agg = cc.agg(
        F.min(F.struct(F.col("n"), F.col("label"))).alias("lo"),
        F.min(F.struct((-F.col("n")).alias("nn"), F.col("label"))).alias("hi"),
        F.count(F.lit(1)).alias("n_classes"),
        F.sum("n").alias("n"),
    )
    return agg.select(
        F.col("lo.label").alias("minority"),
        F.col("hi.label").alias("majority"),
        F.col("lo.n").alias("n_min"),
        (-F.col("hi.nn")).alias("n_max"),
        ((-F.col("hi.nn")) - F.col("lo.n")).alias("deficit"),
        "n_classes",
        "n",
    )


def balanced_class_weight(df: DataFrame, label_col: str = "Class", out_col: str = "weight") -> DataFrame:
    """weight = n / (n_classes * n_class) per row (C6), for ``weightCol``.

    The per-class table has one row per class (2 here); it is broadcast."""
    cc = class_counts(df, label_col)
    n_all = F.sum("n").over(Window.partitionBy())
    k = F.count(F.lit(1)).over(Window.partitionBy())
    # window over the per-class table only (one row per class)
    weights = cc.select(F.col("label").alias("_lbl"), (n_all / (k * F.col("n"))).alias(out_col))
    return df.join(F.broadcast(weights), F.col(label_col) == F.col("_lbl"), "left").drop("_lbl")


def positive_weight(df: DataFrame, w: float = 5.0, label_col: str = "Class", out_col: str = "weight") -> DataFrame:
    """Positives weigh ``w``, others 1."""
    return df.withColumn(out_col, F.when(F.col(label_col) == 1, F.lit(float(w))).otherwise(F.lit(1.0)))
