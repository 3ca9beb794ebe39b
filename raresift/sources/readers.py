"""Readers (inventory A1, A6)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_transactions(
    spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str | None = None
) -> DataFrame:
    """Read a labelled transaction table (A1).

    CSV with a header row (types inferred only when no schema is given --
    inference is an extra pass, so give a schema at scale) or parquet, chosen
    by ``fmt`` or the path suffix.  A missing path raises ``FileNotFoundError``
    instead of returning None."""
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    try:
        if fmt == "csv":
            reader = spark.read.option("header", True)
            reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
            return reader.csv(path)
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise


CURVE_COLUMNS = {
    "pr_curve": ("threshold", "precision", "recall"),
    "roc_curve": ("threshold", "fpr", "tpr"),
    "cost_based": ("threshold", "cost_metric"),
}


def read_curves(spark: SparkSession, folder: str) -> DataFrame | None:
    """Read saved curve CSVs (A6) from ``folder`` with model, oversampling and
    kind taken from the file name ``curves_{model}_{ovs}_...csv``: model = 1st
    and ovs = 2nd '_'-token after stripping ``curves_`` and ``.csv``; kind by
    presence of token pr, else roc, else cost, wherever it stands.  Names with
    fewer than two tokens or without a kind are dropped.

    The three kinds have known columns (``CURVE_COLUMNS``, in the order in which
    they are written), so the files are read as lines in one pass and no schema
    is inferred; columns that a kind does not have are NULL.  Returns None when
    there is no curve file."""
    try:
        lines = spark.read.text(f"{folder.rstrip('/')}/curves_*.csv")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise
    tagged = _tag_curve_file(lines)
    cells = F.split("value", ",")
    header = F.lower(F.trim("value")).startswith("threshold")
    rows = tagged.where(~header & (F.trim("value") != ""))
    out, kinds = [], list(CURVE_COLUMNS.items())
    for name in sorted({c for _, cols in kinds for c in cols}, key=lambda c: [c != "threshold", c]):
        value = F.lit(None).cast("double")
        for kind, cols in kinds:
            if name in cols:
                cell = F.element_at(cells, cols.index(name) + 1)
                number = F.when(F.lower(F.trim(cell)).isin("inf", "infinity"), F.lit(float("inf"))).otherwise(cell.try_cast("double"))
                value = F.when(F.col("curve_type") == kind, number).otherwise(value)
        out.append(value.alias(name))
    return rows.select(*out, "model", "oversampling", "curve_type")


def _tag_curve_file(raw: DataFrame) -> DataFrame:
    # the curves_*.csv component of the path: a plain file, or the directory
    # Spark wrote for it (then the file itself is a part-* file)
    stem = F.regexp_extract(F.input_file_name(), r"curves_([^/]*)\.csv", 1)
    tokens = F.split(stem, "_")
    kind = (
        F.when(F.array_contains(tokens, "pr"), F.lit("pr_curve"))
        .when(F.array_contains(tokens, "roc"), F.lit("roc_curve"))
        .when(F.array_contains(tokens, "cost"), F.lit("cost_based"))
    )
    out = raw.select(
        "*",
        F.element_at(tokens, 1).alias("model"),
        F.when(F.size(tokens) >= 2, F.element_at(tokens, 2)).alias("oversampling"),
        kind.alias("curve_type"),
    )
    return out.where((F.col("model") != "") & F.col("oversampling").isNotNull() & F.col("curve_type").isNotNull())
