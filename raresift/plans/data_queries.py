"""Registered queries for reading, relational steps, statistics and splits
(inventory A1, B1-B6, B9, B10, C1-C7, D1-D3) with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from raresift.functions.hashing import sql_hash_key, sql_uniform
from raresift.operators import relational as rel
from raresift.operators import splits, stats
from raresift.plans.catalog import R, register, rounded
from raresift.session import checkpoint_dir
from raresift.sources import fixtures as fx
from raresift.sources.readers import read_transactions

SEED = 42
TXN_COLS = '"row_id", "Time", V1, V2, V3, Amount, "Class"'


@register("read_transactions", fx.with_ctes(["txn"], "SELECT * FROM txn"))
def q_read(spark, sf):
    # A1 over the events table, then the txn projection (FIXTURES.md)
    return fx.txn_from_events(read_transactions(spark, f"{sf}/events.parquet"))


@register("read_transactions_csv", fx.with_ctes(["txn"], "SELECT * FROM txn"))
def q_read_csv(spark, sf):
    """A1 for CSV with a header and a given schema: the table written and read."""
    t = fx.txn(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/transactions-{uuid.uuid4().hex}"
    t.write.option("header", True).csv(path)
    return read_transactions(spark, path, schema=t.schema, fmt="csv")


@register("drop_time", fx.with_ctes(["txn"], "SELECT row_id, V1, V2, V3, Amount, \"Class\" FROM txn"))
def q_drop_time(spark, sf):
    return rel.drop_time(fx.txn(spark, sf))


@register(
    "split_features_label_float32",
    fx.with_ctes(
        ["txn"],
        'SELECT row_id, CAST(V1 AS FLOAT) AS V1, CAST(V2 AS FLOAT) AS V2, CAST(V3 AS FLOAT) AS V3, '
        'CAST(Amount AS FLOAT) AS Amount, CAST("Class" AS INTEGER) AS "Class" FROM txn',
    ),
)
def q_split_xy(spark, sf):
    return rel.split_features_label(rel.drop_time(fx.txn(spark, sf)), float32=True)


@register("normal_only", fx.with_ctes(["txn"], 'SELECT * FROM txn WHERE "Class" = 0'))
def q_normal(spark, sf):
    return rel.normal_only(fx.txn(spark, sf))


@register(
    "minority_rows",
    fx.with_ctes(
        ["txn"],
        'SELECT * FROM txn WHERE "Class" = (SELECT "Class" FROM txn GROUP BY "Class" ORDER BY count(*), "Class" LIMIT 1)',
    ),
)
def q_minority(spark, sf):
    return rel.minority_rows(fx.txn(spark, sf))


@register("head_records", fx.with_ctes(["txn"], "SELECT * FROM txn ORDER BY row_id LIMIT 5"))
def q_head(spark, sf):
    return rel.head_records(fx.txn(spark, sf), 5)


@register(
    "sigmoid_score",
    fx.with_ctes(
        ["txn"],
        f"SELECT row_id, {R('1 / (1 + exp(-((Amount - 100) / 20 + (V3 - 50) / 50)))')} AS score FROM txn",
    ),
)
def q_sigmoid(spark, sf):
    t = fx.txn(spark, sf)
    margin = (F.col("Amount") - 100) / 20 + (F.col("V3") - 50) / 50
    return rounded(t.select("row_id", rel.sigmoid(margin).alias("score")))


@register(
    "apply_threshold",
    fx.with_ctes(
        ["scored"],
        "SELECT row_id, label, score, CAST(score >= 0.5 AS INTEGER) AS prediction, "
        "CAST(score > 0.5 AS INTEGER) AS flagged FROM scored",
    ),
)
def q_apply_threshold(spark, sf):
    s = rel.apply_threshold(fx.scored(spark, sf), 0.5)
    return rel.apply_threshold(s, 0.5, out_col="flagged", inclusive=False)


# ---------------------------------------------------------------- statistics


def _scaled_sql(cols, src="txn", keep=TXN_COLS, fit_src=None):
    stats_sel = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
        for c in cols
    )
    out = []
    for c in [x.strip() for x in keep.split(",")]:
        bare = c.strip('"')
        out.append(f"{R(f'({c} - m_{bare}) / s_{bare}')} AS {c}" if bare in cols else c)
    return f"SELECT {', '.join(out)} FROM {src} CROSS JOIN (SELECT {stats_sel} FROM {fit_src or src})"


@register("standard_scale", fx.with_ctes(["txn"], _scaled_sql(["Amount"])))
def q_scale(spark, sf):
    return rounded(stats.standard_scale(fx.txn(spark, sf), ["Amount"]))


@register(
    "standard_scale_all",
    fx.with_ctes(
        ["txn"],
        _scaled_sql(["V1", "V2", "V3", "Amount"], "clean", 'row_id, V1, V2, V3, Amount, "Class"'),
        [("clean", 'SELECT row_id, V1, V2, V3, Amount, "Class" FROM txn')],
    ),
)
def q_scale_all(spark, sf):
    return rounded(stats.standard_scale_all(rel.drop_time(fx.txn(spark, sf))))


_SPLIT_SQL = (
    "SELECT *, row_number() OVER (PARTITION BY \"Class\" ORDER BY {h}, row_id) "
    "<= ceil(0.2 * count(*) OVER (PARTITION BY \"Class\")) AS is_test FROM txn"
).format(h=sql_hash_key(str(SEED), "'split'", "row_id"))


@register(
    "transform_with_scaler",
    fx.with_ctes(
        ["txn"],
        _scaled_sql(["Amount"], "test_rows", TXN_COLS, fit_src="train_rows"),
        [
            ("sp", _SPLIT_SQL),
            ("train_rows", f"SELECT {TXN_COLS} FROM sp WHERE NOT is_test"),
            ("test_rows", f"SELECT {TXN_COLS} FROM sp WHERE is_test"),
        ],
    ),
)
def q_transform_scaler(spark, sf):
    train, test = splits.train_test(fx.txn(spark, sf), seed=SEED)
    scaler = stats.fit_scaler(train, ["Amount"])
    return rounded(stats.transform_with_scaler(test, scaler))


def _describe_sql(cols):
    parts = []
    for c in cols:
        base = f"FROM txn WHERE {c} IS NOT NULL"
        for stat, expr in (
            ("count", f"CAST(count({c}) AS DOUBLE)"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"),
            ("min", f"min({c})"), ("max", f"max({c})"), ("25%", f"quantile_cont({c}, 0.25)"),
            ("50%", f"quantile_cont({c}, 0.5)"), ("75%", f"quantile_cont({c}, 0.75)"),
        ):
            parts.append(
                f"SELECT '{c}' AS \"column\", 'double' AS dtype, (SELECT count({c}) FROM txn) AS non_null, "
                f"'{stat}' AS stat, {R(expr)} AS value {base}"
            )
    return " UNION ALL ".join(parts)


@register("describe", fx.with_ctes(["txn"], _describe_sql(["Time", "V1", "V2", "V3", "Amount"])))
def q_describe(spark, sf):
    t = fx.txn(spark, sf)
    return rounded(stats.describe(t, ["Time", "V1", "V2", "V3", "Amount"]))


_SPARSE = (
    "SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value, "
    "CAST(CASE WHEN user_id % 3 > 0 THEN user_id END AS DECIMAL(12,2)) AS code, CAST(NULL AS DOUBLE) AS nothing FROM events"
)


def _describe_all_sql() -> str:
    parts = []
    for c, dtype in (("event_id", "bigint"), ("event_type", "string"), ("value", "double"), ("code", "decimal(12,2)"), ("nothing", "double")):
        stats_ = [("count", f"CAST(count({c}) AS DOUBLE)")]
        if dtype != "string":
            d = f"CAST({c} AS DOUBLE)"
            stats_ += [("mean", f"avg({d})"), ("std", f"stddev_samp({d})"), ("min", f"min({d})"), ("max", f"max({d})")]
            stats_ += [(f"{int(100 * p)}%", f"quantile_cont({d}, {p})") for p in (0.25, 0.5, 0.75)]
        for stat, expr in stats_:
            parts.append(
                f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, count({c}) AS non_null, '{stat}' AS stat, {R(expr)} AS value FROM sparse"
            )
    return f"WITH sparse AS ({_SPARSE}) " + " UNION ALL ".join(parts)


@register("describe_all_columns", _describe_all_sql())
def q_describe_all(spark, sf):
    """C4 over every column: text, decimals, missing values, nothing at all."""
    events = fx.table(spark, sf, "events")
    return rounded(stats.describe(events.selectExpr(
        "event_id", "event_type", "CASE WHEN event_type <> 'error' THEN value END AS value",
        "CAST(CASE WHEN user_id % 3 > 0 THEN user_id END AS DECIMAL(12,2)) AS code", "CAST(NULL AS DOUBLE) AS nothing",
    )))


@register(
    "class_balance",
    fx.with_ctes(
        ["txn"],
        "SELECT arg_min(label, struct_pack(n := n, l := label)) AS minority, "
        "arg_min(label, struct_pack(n := -n, l := label)) AS majority, min(n) AS n_min, max(n) AS n_max, "
        "max(n) - min(n) AS deficit, count(*) AS n_classes, sum(n)::BIGINT AS n "
        'FROM (SELECT "Class" AS label, count(*) AS n FROM txn GROUP BY 1)',
    ),
)
def q_balance(spark, sf):
    return stats.class_balance(fx.txn(spark, sf))


@register(
    "balanced_class_weight",
    fx.with_ctes(
        ["txn"],
        f"SELECT row_id, \"Class\", {R('count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY \"Class\"))')} AS weight FROM txn",
    ),
)
def q_bcw(spark, sf):
    t = fx.txn(spark, sf).select("row_id", "Class")
    return rounded(stats.balanced_class_weight(t))


@register(
    "positive_weight",
    fx.with_ctes(["txn"], 'SELECT row_id, "Class", CASE WHEN "Class" = 1 THEN 5.0 ELSE 1.0 END AS weight FROM txn'),
)
def q_posw(spark, sf):
    return stats.positive_weight(fx.txn(spark, sf).select("row_id", "Class"), 5.0)


# ---------------------------------------------------------------- splits


@register("stratified_split", fx.with_ctes(["txn"], "SELECT row_id, \"Class\", is_test FROM sp", [("sp", _SPLIT_SQL)]))
def q_split(spark, sf):
    return splits.stratified_split(fx.txn(spark, sf), seed=SEED).select("row_id", "Class", "is_test")


@register(
    "stratified_split_bernoulli",
    fx.with_ctes(["txn"], f"SELECT row_id, \"Class\", {sql_uniform(str(SEED), repr('split'), 'row_id')} < 0.2 AS is_test FROM txn"),
)
def q_split_b(spark, sf):
    return splits.stratified_split(fx.txn(spark, sf), seed=SEED, mode="bernoulli").select("row_id", "Class", "is_test")


@register(
    "stratified_kfold",
    fx.with_ctes(
        ["txn"],
        "SELECT row_id, \"Class\", CAST((row_number() OVER (PARTITION BY \"Class\" ORDER BY "
        f"{sql_hash_key(str(SEED), repr('fold'), 'row_id')}, row_id) - 1) * 5 // count(*) OVER (PARTITION BY \"Class\") "
        "AS INTEGER) AS fold FROM txn",
    ),
)
def q_skfold(spark, sf):
    return splits.stratified_kfold(fx.txn(spark, sf), 5, seed=SEED).select("row_id", "Class", "fold")


@register(
    "kfold",
    fx.with_ctes(
        ["txn"],
        f"SELECT row_id, CAST(floor({sql_uniform(str(SEED), repr('kfold'), 'row_id')} * 5) AS INTEGER) AS fold FROM txn",
    ),
)
def q_kfold(spark, sf):
    return splits.kfold(fx.txn(spark, sf), 5, seed=SEED).select("row_id", "fold")


@register(
    "fold_class_counts",
    fx.with_ctes(
        ["txn"],
        "SELECT fold, \"Class\", count(*) AS n FROM (SELECT \"Class\", CAST((row_number() OVER (PARTITION BY \"Class\" ORDER BY "
        f"{sql_hash_key(str(SEED), repr('fold'), 'row_id')}, row_id) - 1) * 5 // count(*) OVER (PARTITION BY \"Class\") "
        "AS INTEGER) AS fold FROM txn) GROUP BY ALL",
    ),
)
def q_fold_counts(spark, sf):
    f = splits.stratified_kfold(fx.txn(spark, sf), 5, seed=SEED)
    return f.groupBy("fold", "Class").agg(F.count(F.lit(1)).alias("n"))
