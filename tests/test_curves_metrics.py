"""Goldens (FIXTURES.md, hand computed) and invariants for curves, threshold
rules and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from raresift.operators import curves, metrics
from raresift.operators.relational import apply_threshold

TIES = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.8, 0), (0.2, 0)]


def frame(spark, data, parts=2):
    df = spark.createDataFrame([(i, y, float(s)) for i, (s, y) in enumerate(data)], "row_id long, label int, score double")
    return df.repartition(parts)


def one(df):
    r = df.collect()
    assert len(r) == 1
    return r[0]


def test_ties_golden(spark):
    df = frame(spark, TIES)
    r = one(metrics.ranking_summary(curves.cumulative_table(df)))
    assert r["pr_auc"] == pytest.approx(0.5)
    assert r["roc_auc"] == pytest.approx(0.6875)
    assert one(curves.threshold_percentile(df, 99))["threshold"] == pytest.approx(0.8)


def test_ties_pr_curve_points(spark):
    pr = curves.pr_curve(frame(spark, TIES)).orderBy("threshold").collect()
    # thresholds = distinct scores ascending
    assert [r["threshold"] for r in pr] == [0.1, 0.2, 0.35, 0.4, 0.8]
    # at 0.8: tp=1, fp=1
    assert pr[-1]["precision"] == pytest.approx(0.5) and pr[-1]["recall"] == pytest.approx(0.5)
    saved = curves.pr_curve(frame(spark, TIES), closing_point=True).collect()
    assert len(saved) == 6 and any(r["threshold"] == 1.0 and r["precision"] == 1.0 and r["recall"] == 0.0 for r in saved)


def test_all_equal_golden(spark):
    df = frame(spark, [(0.5, 0), (0.5, 1), (0.5, 0)])
    r = one(metrics.ranking_summary(curves.cumulative_table(df)))
    assert r["roc_auc"] == pytest.approx(0.5)
    assert r["pr_auc"] == pytest.approx(1 / 3)
    assert curves.pr_curve(df).count() == 1


def test_no_positives_golden(spark):
    df = frame(spark, [(0.2, 0), (0.9, 0)])
    r = one(metrics.evaluate(df, threshold=0.5))
    assert r["recall"] == 0.0 and r["roc_auc"] is None


def test_none_flagged_golden(spark):
    df = frame(spark, [(0.1, 1), (0.2, 0)])
    r = one(metrics.evaluate(df, threshold=0.5))
    assert (r["precision"], r["recall"], r["f1_score"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_half_float_golden(spark):
    df = frame(spark, [(0.4999999999, 1)])
    # float32 cast (training metrics) rounds up to 0.5 -> flagged
    assert one(metrics.evaluate_metric(df, "recall"))["value"] == 1.0
    # the double score is below 0.5 -> not flagged
    assert one(metrics.evaluate(df, threshold=0.5))["recall"] == 0.0


def test_threshold_rules_ties(spark):
    df = frame(spark, TIES)
    f1 = one(curves.best_threshold_f1(df))
    # F1 at 0.35: tp=2, fp=2 -> 2*2/(2+2+2) = 2/3, the best
    assert f1["threshold"] == 0.35 and f1["value"] == pytest.approx(2 / 3)
    yj = one(curves.best_threshold_youden(df))
    assert yj["threshold"] == 0.35  # tpr 1, fpr 0.5
    cost = one(curves.best_threshold_cost(df, cost_fp=1, cost_fn=5))
    assert cost["threshold"] == 0.35


def test_youden_prefers_start_when_nothing_better(spark):
    # perfectly wrong scores: every J <= 0, so the +inf starting point wins
    df = frame(spark, [(0.9, 0), (0.1, 1)])
    assert math.isinf(one(curves.best_threshold_youden(df))["threshold"])


def test_confusion_counts_sum_to_n(spark):
    df = frame(spark, TIES)
    r = one(metrics.confusion_counts(apply_threshold(df, 0.3)))
    assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == r["n"] == 6


def test_auc_invariant_under_monotone_map(spark):
    df = frame(spark, TIES)
    a = one(metrics.ranking_summary(curves.cumulative_table(df)))
    g = df.withColumn("score", F.exp(F.col("score") * 3) + 7)
    b = one(metrics.ranking_summary(curves.cumulative_table(g)))
    assert a["roc_auc"] == pytest.approx(b["roc_auc"]) and a["pr_auc"] == pytest.approx(b["pr_auc"])


@pytest.mark.parametrize("n_ranges", [1, 3, 16])
def test_running_totals_exact_for_any_cuts(spark, n_ranges):
    from raresift.sources import fixtures as fx

    s = fx.scored(spark, "/root/testdata/sf0.001")
    ref = {r["threshold"]: (r["tp"], r["fp"]) for r in curves.cumulative_table(s, n_ranges=1).collect()}
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in curves.cumulative_table(s, n_ranges=n_ranges).collect()}
    assert got == ref


def test_scored_sf001_known_values(spark):
    from raresift.sources import fixtures as fx

    r = one(metrics.ranking_summary(curves.cumulative_table(fx.scored(spark, "/root/testdata/sf0.01"))))
    assert round(r["roc_auc"], 6) == round(0.9396738087623915, 6)
    assert round(r["pr_auc"], 6) == round(0.2007216877271792, 6)


def test_evaluate_many_equals_single(spark):
    from raresift.sources import fixtures as fx

    s = fx.scored(spark, "/root/testdata/sf0.001")
    many = {r["metric"]: r for r in metrics.evaluate_many(s, ["pr_curve", "cost_based", "percentile", "default"]).collect()}
    for m in ("pr_curve", "cost_based", "percentile", "default"):
        single = one(metrics.evaluate(s, method=m))
        for c in metrics.METRIC_COLUMNS:
            assert many[m][c] == pytest.approx(single[c]) or (many[m][c] is None and single[c] is None)


def test_unknown_metric_raises(spark):
    with pytest.raises(ValueError):
        metrics.evaluate_metric(frame(spark, TIES), "auc")
    with pytest.raises(ValueError):
        curves.curve_values(frame(spark, TIES), "lift")
