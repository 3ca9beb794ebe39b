"""A missing score, feature or label raises, whatever the partitioning."""

import math

import pytest
from pyspark.sql import functions as F

from raresift.operators import curves, knn, metrics, resample, splits, stats


def scores(spark, bad):
    rows = [(i, i % 7 == 0, i / 200) for i in range(200)] + [(900, 1, bad)]
    return spark.createDataFrame([(i, int(y), s) for i, y, s in rows], "row_id long, label int, score double")


@pytest.mark.parametrize("n_ranges", [1, 4, 200])
@pytest.mark.parametrize("bad", [None, math.nan])
def test_scores(spark, n_ranges, bad):
    df = scores(spark, bad)
    for run in (
        lambda: curves.pr_curve(df, n_ranges=n_ranges),
        lambda: curves.best_threshold_f1(df, n_ranges=n_ranges),
        lambda: curves.threshold_percentile(df, 10, n_ranges=n_ranges),
        lambda: metrics.evaluate(df, "cost_based", n_ranges=n_ranges),
    ):
        with pytest.raises(Exception, match="missing"):
            run().collect()


@pytest.mark.parametrize("n_ranges", [1, 4, 200])
def test_same_answers_for_any_number_of_ranges(spark, n_ranges):
    df = scores(spark, 0.5)
    def told(n):
        out = metrics.evaluate_many(df, ["pr_curve", "cost_based", "percentile", "default"], n_ranges=n).collect()
        return sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in out)

    assert told(n_ranges) == told(2)


def test_range_count_is_bounded(spark):
    from raresift.functions.prefix import MAX_RANGES, range_count

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 200_000)
        assert range_count(spark) == MAX_RANGES
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_labels(spark):
    df = scores(spark, 0.5).withColumn("label", F.when(F.col("row_id") != 3, F.col("label")))
    for run in (
        lambda: curves.pr_curve(df),
        lambda: splits.stratified_split(df, label_col="label"),
        lambda: splits.stratified_kfold(df, 3, label_col="label"),
        lambda: stats.class_balance(df, "label"),
    ):
        with pytest.raises(Exception, match="missing"):
            run().collect()


def features(spark, bad, n_bad=1):
    rows = [(i, float(i % 13), float(i), int(i < 20)) for i in range(200)]
    rows = [(i, bad if i < n_bad else a, b, y) for i, a, b, y in rows]
    return spark.createDataFrame(rows, "row_id long, a double, b double, Class int")


@pytest.mark.parametrize("bad", [None, math.nan])
def test_features(spark, bad):
    df = features(spark, bad)
    for run in (
        lambda: knn.knn_join(df, df, 2, ["a", "b"]),
        lambda: resample.smote(df, ["a", "b"]),
        lambda: resample.svm_smote(df, ["a", "b"], svm_coefficients=[0.0, 0.0]),
    ):
        with pytest.raises(Exception, match="missing"):
            run().collect()


@pytest.mark.parametrize("approximate", [False, True])
def test_smote_balances_exactly(spark, approximate):
    df = features(spark, 1.0)
    got = resample.smote(df, ["a", "b"], approximate=approximate).groupBy("Class").count().collect()
    assert {r["Class"]: r["count"] for r in got} == {0: 180, 1: 180}


def test_close_ranking_keys_stay_apart(spark):
    # two thresholds whose F1 differ by less than 1e-12: the better one wins
    n = 3_000_000
    cum = spark.createDataFrame(
        [(0.9, n, n, n, n, 2 * n, 3 * n), (0.8, n, n, n + 1, n + 1, 2 * n, 3 * n)],
        "threshold double, pos long, neg long, tp long, fp long, P long, N long",
    )
    f1 = [2 * tp / (tp + fp + 2 * n) for tp, fp in ((n, n), (n + 1, n + 1))]
    best = cum.agg(curves.selection_struct("pr_curve").alias("s")).first()["s"]
    assert best["t"] == (0.9 if f1[0] > f1[1] else 0.8)
    j = [tp * 3 * n - fp * 2 * n for tp, fp in ((n, n), (n + 1, n + 1))]
    best = cum.agg(curves.selection_struct("roc_curve").alias("s")).first()["s"]
    assert best["t"] == (0.9 if j[0] > j[1] else 0.8)
