"""Fixture views over the driver's read-only tables (see FIXTURES.md).

Each view has a Spark builder and the equivalent DuckDB text (a CTE body), so
oracle queries can inline the same definition.

- ``txn``    transactions from ``events``: row_id, Time, V1..V3, Amount, Class
- ``scored`` label and a fixed logistic score from ``txn`` (no model fit)
- ``vec``    64-d vectors from ``embeddings``: row_id, x, Class
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["V1", "V2", "V3", "Amount"]
LABEL = "Class"
ID = "row_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a rare, learnable label (2-3 % positive)."""
    return txn_from_events(table(spark, sf_dir, "events"))


def txn_from_events(ev: DataFrame) -> DataFrame:
    """The txn projection of an events frame (batch or stream)."""
    return ev.select(
        F.col("event_id").alias("row_id"),
        # whole seconds since 2024-01-01; `ts` is TIMESTAMP_NTZ, so no zone enters
        F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS DOUBLE)").alias("Time"),
        F.col("user_id").cast("double").alias("V1"),
        F.hour("ts").cast("double").alias("V2"),
        F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)").alias("V3"),
        F.col("value").alias("Amount"),
        ((F.col("event_type") == "error") & (F.col("value") >= 100)).cast("int").alias("Class"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, score) with a fixed logistic score rounded to 4 places (ties)."""
    return scored_from_txn(txn(spark, sf_dir))


def scored_from_txn(t: DataFrame) -> DataFrame:
    margin = (F.col("Amount") - 100) / 20 + (F.col("V3") - 50) / 50
    return t.select(
        "row_id",
        F.col("Class").alias("label"),
        F.round(1 / (1 + F.exp(-margin)), 4).alias("score"),
    )


def scored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored`` plus experiment keys: model = V1 % 3, oversampling = V2 % 4."""
    t = txn(spark, sf_dir)
    margin = (F.col("Amount") - 100) / 20 + (F.col("V3") - 50) / 50
    return t.select(
        "row_id",
        F.concat(F.lit("m"), F.pmod(F.col("V1").cast("long"), F.lit(3)).cast("string")).alias("model"),
        F.concat(F.lit("o"), F.pmod(F.col("V2").cast("long"), F.lit(4)).cast("string")).alias("oversampling"),
        F.col("Class").alias("label"),
        F.round(1 / (1 + F.exp(-margin)), 4).alias("score"),
    )


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 64-d vectors; positive = embeddings label 0 (about 10 %)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") == 0).cast("int").alias("Class"),
    )


# ---------------------------------------------------------------- DuckDB text

TXN_SQL = """SELECT event_id AS row_id,
       CAST(floor(epoch(ts)) - 1704067200 AS DOUBLE) AS "Time",
       CAST(user_id AS DOUBLE) AS V1,
       CAST(hour(ts) AS DOUBLE) AS V2,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS V3,
       value AS Amount,
       CAST(event_type = 'error' AND value >= 100 AS INTEGER) AS "Class"
FROM events"""

SCORED_SQL = """SELECT row_id, "Class" AS label,
       round(1 / (1 + exp(-((Amount - 100) / 20 + (V3 - 50) / 50))), 4) AS score
FROM txn"""

SCORED_GROUPS_SQL = """SELECT row_id,
       'm' || CAST(CAST(V1 AS BIGINT) % 3 AS VARCHAR) AS model,
       'o' || CAST(CAST(V2 AS BIGINT) % 4 AS VARCHAR) AS oversampling,
       "Class" AS label,
       round(1 / (1 + exp(-((Amount - 100) / 20 + (V3 - 50) / 50))), 4) AS score
FROM txn"""

VEC_SQL = """SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x,
       CAST(label = 0 AS INTEGER) AS "Class"
FROM embeddings"""

CTES = {
    "txn": TXN_SQL,
    "scored": SCORED_SQL,
    "scored_groups": SCORED_GROUPS_SQL,
    "vec": VEC_SQL,
}
_DEPS = {"scored": ["txn"], "scored_groups": ["txn"]}


def with_ctes(names: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """Prefix ``body`` with the fixture CTEs it needs (dependencies first)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in extra]
    return "WITH " + ",\n".join(parts) + "\n" + body
