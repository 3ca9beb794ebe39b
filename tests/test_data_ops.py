"""Scaling, describe, class balance, splits: goldens, invariants, determinism."""

import pytest
from pyspark.sql import functions as F

from raresift.operators import relational, splits, stats
from raresift.sources import fixtures as fx

from paths import SF0001


def test_scaler_population_std_golden(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "Amount double")
    sc = stats.fit_scaler(df, ["Amount"]).first()
    assert sc["mean"] == pytest.approx(4.0)
    assert sc["std"] == pytest.approx(3.1622776601683795)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(7.0,), (7.0,), (7.0,)], "Amount double")
    assert [r["Amount"] for r in stats.standard_scale(df, ["Amount"]).collect()] == [0.0, 0.0, 0.0]


def test_class_balance_ties_to_smaller_label(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (2,)], "Class int")
    r = stats.class_balance(df).first()
    assert (r["minority"], r["majority"], r["n_min"], r["n_max"], r["deficit"]) == (0, 2, 1, 2, 1)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "Class int")
    w = {r["Class"]: r["weight"] for r in stats.balanced_class_weight(df).collect()}
    assert w[0] == pytest.approx(4 / 6) and w[1] == pytest.approx(2.0)


def test_describe_matches_pandas(spark):
    t = fx.txn(spark, SF0001)
    d = {(r["column"], r["stat"]): r["value"] for r in stats.describe(t, ["Amount", "V3"]).collect()}
    pdf = t.select("Amount", "V3").toPandas().describe()
    for c in ("Amount", "V3"):
        for stat in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
            assert d[(c, stat)] == pytest.approx(pdf.loc[stat, c])


def test_drop_time_and_features(spark):
    t = relational.drop_time(fx.txn(spark, SF0001))
    assert "Time" not in t.columns
    assert relational.feature_columns(t) == ["V1", "V2", "V3", "Amount"]
    assert relational.drop_time(t).columns == t.columns


def test_sort_results_unknown_column_warns(spark):
    df = spark.createDataFrame([(1.0,)], "pr_auc double")
    with pytest.warns(UserWarning):
        assert relational.sort_results(df, "nope") is df


def test_split_ratio_and_stratification(spark):
    t = fx.txn(spark, SF0001)
    s = splits.stratified_split(t)
    c = {(r["Class"], r["is_test"]): r["n"] for r in s.groupBy("Class", "is_test").agg(F.count("*").alias("n")).collect()}
    for cls in (0, 1):
        n = c[(cls, True)] + c[(cls, False)]
        assert c[(cls, True)] == -(-n * 2 // 10)  # ceil(0.2 n)


def test_split_same_under_any_partitioning(spark):
    t = fx.txn(spark, SF0001)
    base = {r["row_id"] for r in splits.stratified_split(t).where("is_test").collect()}
    for parts in (1, 7):
        got = {r["row_id"] for r in splits.stratified_split(t.repartition(parts)).where("is_test").collect()}
        assert got == base


def test_folds_disjoint_covering_stratified(spark):
    t = fx.txn(spark, SF0001)
    f = splits.stratified_kfold(t, 5)
    assert f.count() == t.count() and f.select("row_id").distinct().count() == t.count()
    per = f.groupBy("Class", "fold").count().collect()
    for cls in (0, 1):
        ns = [r["count"] for r in per if r["Class"] == cls]
        assert len(ns) == 5 and max(ns) - min(ns) <= 1


def test_kfold_range(spark):
    f = splits.kfold(fx.txn(spark, SF0001), 5)
    assert {r["fold"] for r in f.select("fold").distinct().collect()} == set(range(5))


def test_first_n_matches_sorted_rank(spark):
    import hashlib

    from raresift.operators.splits import first_n

    df = spark.range(0, 3000).withColumnRenamed("id", "row_id")
    for n in (0, 1, 17, 2999, 3000):
        flag = first_n(df, "row_id", 7, "t", n)
        got = {r["row_id"] for r in df.where(flag).collect()}
        keyed = sorted((hashlib.md5(f"7|t|{i}".encode()).hexdigest(), i) for i in range(3000))
        assert got == {i for _, i in keyed[:n]}


def test_first_n_two_rounds(spark, monkeypatch):
    """Both rounds with one hex digit each, so that rows are left to rank."""
    import hashlib

    from raresift.operators import splits as sp

    monkeypatch.setattr(sp, "DIGITS", 1)
    df = spark.range(0, 2000).withColumnRenamed("id", "row_id")
    keyed = sorted((hashlib.md5(f"3|u|{i}".encode()).hexdigest(), i) for i in range(2000))
    for n in (1, 999, 2000):
        got = {r["row_id"] for r in df.where(sp.first_n(df, "row_id", 3, "u", n)).collect()}
        assert got == {i for _, i in keyed[:n]}


def test_kfold_blocks_two_rounds_match_rank_rule(spark, monkeypatch):
    """fold = floor((rank - 1) * k / n_class), with rows left to rank after both rounds."""
    import hashlib

    from raresift.operators import splits as sp

    monkeypatch.setattr(sp, "DIGITS", 1)
    t = fx.txn(spark, SF0001).select("row_id", "Class")
    got = {r["row_id"]: r["fold"] for r in sp.stratified_kfold(t, 4, seed=9).collect()}
    rows = [(r["row_id"], r["Class"]) for r in t.collect()]
    for cls in (0, 1):
        ids = sorted((hashlib.md5(f"9|fold|{i}".encode()).hexdigest(), i) for i, c in rows if c == cls)
        n = len(ids)
        for rank, (_, i) in enumerate(ids, start=1):
            assert got[i] == (rank - 1) * 4 // n
