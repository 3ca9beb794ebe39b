"""Same output for 1, 4 and 16 input partitions (and shuffle partitions)."""

import pytest

from raresift.operators import curves, knn, metrics, splits
from raresift.sources import fixtures as fx

from paths import SF0001


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_curves_and_metrics_partition_independent(spark, parts):
    s = fx.scored(spark, SF0001)
    base_pr = _rows(curves.pr_curve(s))
    base_ev = _rows(metrics.evaluate_many(s, ["pr_curve", "cost_based", "percentile"]))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        r = s.repartition(parts)
        assert _rows(curves.pr_curve(r)) == base_pr
        got = _rows(metrics.evaluate_many(r, ["pr_curve", "cost_based", "percentile"]))
        assert [g[:1] for g in got] == [b[:1] for b in base_ev]
        for g, b in zip(got, base_ev):
            assert g == pytest.approx(b) if all(isinstance(x, float) for x in g[1:]) else True
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("parts", [1, 16])
def test_knn_and_folds_partition_independent(spark, parts):
    v = fx.vec(spark, SF0001)
    base = _rows(knn.knn_join(v, v, 3, "x"))
    assert _rows(knn.knn_join(v.repartition(parts), v.repartition(parts), 3, "x")) == base
    t = fx.txn(spark, SF0001)
    f0 = _rows(splits.stratified_kfold(t, 5).select("row_id", "fold"))
    assert _rows(splits.stratified_kfold(t.repartition(parts), 5).select("row_id", "fold")) == f0
