"""Projections, filters, sort/limit and unions (inventory B1-B10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.operators.stats import class_balance

TIME_COL = "Time"


def drop_time(df: DataFrame, time_col: str = TIME_COL) -> DataFrame:
    """Drop the opaque ``Time`` column if present (B1)."""
    return df.drop(time_col) if time_col in df.columns else df


def feature_columns(df: DataFrame, label_col: str = "Class", exclude: Sequence[str] = ("row_id",)) -> list[str]:
    """All numeric columns except id, label and the excluded ones."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    return [
        n for n, t in df.dtypes if n != label_col and n not in exclude and t.split("(")[0] in numeric
    ]


def split_features_label(
    df: DataFrame,
    label_col: str = "Class",
    id_col: str = "row_id",
    float32: bool = False,
) -> DataFrame:
    """(id, features..., label): features = all but id and label (B2).

    ``float32=True`` casts features to FLOAT and the label to INT, as the GPU
    path of the reference does."""
    feats = feature_columns(df, label_col, exclude=(id_col,))
    fcast = "float" if float32 else "double"
    cols = [F.col(id_col)] if id_col in df.columns else []
    cols += [F.col(c).cast(fcast).alias(c) for c in feats]
    cols.append(F.col(label_col).cast("int").alias(label_col))
    return df.select(*cols)


def normal_only(df: DataFrame, label_col: str = "Class") -> DataFrame:
    """Rows of the normal class, the anomaly detectors' training set."""
    return df.where(F.col(label_col) == 0)


def minority_rows(df: DataFrame, label_col: str = "Class") -> DataFrame:
    """Rows of the rarest class (B4); ties go to the smaller label.

    The minority label comes from a one-row aggregate joined by broadcast (a
    one-row table has a proven size)."""
    bal = class_balance(df, label_col).select(F.col("minority").alias("_min"))
    return df.join(F.broadcast(bal), F.col(label_col) == F.col("_min"), "inner").drop("_min")


def head_records(df: DataFrame, n: int = 5, order_col: str = "row_id") -> DataFrame:
    """First ``n`` rows by an explicit order (B5); a top-n, merged per task."""
    return df.orderBy(order_col).limit(n)


def sort_results(df: DataFrame, col: str | None, ascending: bool = False) -> DataFrame:
    """Sort a results table (B6, K3); an unknown column leaves it unsorted."""
    if not col:
        return df
    match = [c for c in df.columns if c.lower() == col.lower()]
    if not match:
        import warnings

        warnings.warn(f"results have no column {col!r}; they stay in their order")
        return df
    c = F.col(match[0])
    return df.orderBy(c.asc() if ascending else c.desc())


def append_synthetic(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Original rows UNION ALL synthetic rows, by column name.

    Adds ``is_synthetic`` (false for originals) when missing."""
    if "is_synthetic" not in original.columns:
        original = original.withColumn("is_synthetic", F.lit(False))
    if "is_synthetic" not in synthetic.columns:
        synthetic = synthetic.withColumn("is_synthetic", F.lit(True))
    return original.unionByName(synthetic, allowMissingColumns=True)


def positive_score(df: DataFrame, probability_col: str = "probability", prediction_col: str = "prediction") -> Column:
    """Class-1 probability of a fitted Spark ML model, else its hard prediction."""
    if probability_col in df.columns:
        return vector_to_array(F.col(probability_col))[1]
    return F.col(prediction_col).cast("double")


def sigmoid(c: Column) -> Column:
    """1 / (1 + exp(-s))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def margin_score(df: DataFrame, raw_col: str = "rawPrediction") -> Column:
    """Sigmoid of the class-1 margin for models without probabilities (B9);
    applied to the margin, not to the predicted label."""
    return sigmoid(vector_to_array(F.col(raw_col))[1])


def apply_threshold(
    df: DataFrame,
    threshold: float | Column = 0.5,
    score_col: str = "score",
    out_col: str = "prediction",
    inclusive: bool = True,
) -> DataFrame:
    """Hard labels (B10): ``score >= t`` for classifiers, ``score > t`` for the
    anomaly flag (``inclusive=False``)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    cond = F.col(score_col) >= t if inclusive else F.col(score_col) > t
    return df.withColumn(out_col, cond.cast("int"))
