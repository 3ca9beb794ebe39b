"""Physical-plan properties behind the scale claims (README 'How it scales')."""

import pytest

import __spark_entry__ as entry
from raresift.operators import splits
from raresift.sources import fixtures as fx

from paths import SF0001

QUERIES = entry.queries()
# plans are inspected without running the (slow) model-fitting flows
PLAN_QUERIES = [
    "pr_curve", "roc_curve", "evaluate_percentile", "experiment_matrix", "describe", "knn_join", "knn_classify",
    "smote", "adasyn", "svm_smote_fixed_plane", "stratified_split", "stratified_kfold", "autoencoder_score",
    "metrics_by_model", "threshold_percentile_by_experiment", "minority_rows",
]


def plan(df):
    """The plan that ran (AQE's final one)."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_pairwise_joins(spark, name):
    p = plan(QUERIES[name](spark, SF0001))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_split_and_folds_are_projections(spark):
    t = fx.txn(spark, SF0001)
    for df in (splits.stratified_split(t), splits.stratified_kfold(t, 5)):
        p = plan(df)
        assert "Exchange" not in p and "Window" not in p and "Sort" not in p


def test_scored_scans_prune_columns(spark):
    p = plan(QUERIES["pr_curve"](spark, SF0001))
    assert "ReadSchema: struct<event_type:string,value:double,props:string>" in p or (
        "user_id" not in p.split("ReadSchema")[1].split(">")[0] and "ts:" not in p.split("ReadSchema")[1].split(">")[0]
    )


def test_running_total_windows_are_partitioned(spark):
    # windows over score rows are partitioned by the range; the others run over
    # the offsets table, which has one row per range
    text = plan(QUERIES["pr_curve"](spark, SF0001))
    windows = [x for x in text.splitlines() if "Window [" in x and "windowspecdefinition(" in x and "threshold" in x]
    assert windows and all("windowspecdefinition(_rng" in x for x in windows)


def test_roc_curve_has_no_self_join(spark):
    text = plan(QUERIES["roc_curve"](spark, SF0001))
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text


@pytest.mark.parametrize("name", ["smote", "adasyn", "svm_smote_fixed_plane"])
def test_nothing_is_shuffled_after_generation(spark, name):
    lines = plan(QUERIES[name](spark, SF0001)).splitlines()
    last = max(i for i, x in enumerate(lines) if "Generate explode(sequence" in x)
    first = min(i for i, x in enumerate(lines) if "Generate explode(sequence" in x)
    # the plan reads top down: above the first Generate is what happens to generated rows
    assert last >= first and not any("Exchange" in x or "Join" in x for x in lines[:first])


def test_no_pairwise_joins_in_flagship(spark):
    p = plan(entry.entry(spark))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
