"""Box cells of the k-nearest join: leaves, reach and hot boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import knn, pivot_knn

from test_pivot_knn import both, frame


def learned(spark, y, leaves, metric="euclidean"):
    refs = frame(spark, y).select(F.col("row_id").alias("rid"), F.col("x").alias("rx"))
    return refs, pivot_knn.Boxes.of(y, leaves, metric).learn(refs, y.shape[1])


def test_leaves_are_alike_and_spark_finds_the_same(spark):
    rng = np.random.default_rng(1)
    y = np.concatenate((rng.normal(size=(700, 3)), np.repeat([[0.0, 1.0, -1.0]], 200, 0), rng.integers(0, 2, (100, 3)).astype(float)))
    refs, cells = learned(spark, y, 7)
    own = cells.assign(y)
    assert cells.number == 7 and cells.count.tolist() == np.bincount(own, minlength=7).tolist()
    assert max(cells.count) < 2.2 * len(y) / 7
    for c in range(7):
        assert (cells.low[c] == y[own == c].min(0)).all() and (cells.high[c] == y[own == c].max(0)).all()
    told = dict(refs.select("rid", F.expr(cells.leaf("rx"))).collect())
    assert [told[i] for i in range(len(y))] == own.tolist()
    assert pivot_knn.Boxes.of(np.ones((50, 2)), 4, "euclidean").number == 1


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_no_neighbour_lies_outside_the_boxes_asked(spark, metric):
    rng = np.random.default_rng(2)
    y, q = rng.normal(size=(400, 4)), rng.normal(size=(60, 4)) * 2
    _, cells = learned(spark, y, 9, metric)
    d, own = pivot_knn.distances(q, y, metric), cells.assign(y)
    third = np.sort(d, 1)[:, 2]
    reach = np.full(60, np.inf)
    for known in (third.copy(), reach):
        ok = cells.within(q, known, 3)
        for i in range(60):
            assert ok[i, own[d[i] <= third[i]]].all()
    assert (reach >= third).all() and np.isfinite(reach).all()


def test_a_hot_box_is_cut_and_loses_nothing(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((np.repeat([[1.0, 2.0]], 900, 0), rng.normal(size=(600, 2))))
    df = frame(spark, x)
    for exclude_self in (True, False):
        both(df, df, 4, exclude_self=exclude_self, max_refs_per_cell=100, max_queries_per_cell=150)
    _, cells = learned(spark, x, 5)
    first, slots, group_of = cells.deal(100)
    assert slots.max() >= 9 and len(group_of) == slots.sum()


def test_few_dimensions_measure_nothing_to_pivots(spark, monkeypatch):
    monkeypatch.setattr(pivot_knn, "learn_cells", None)  # would fail
    rng = np.random.default_rng(4)
    df = frame(spark, rng.normal(size=(1200, 4)))
    both(df, df, 5)
    assert knn.knn_join(df, df, 5, "x", metric="manhattan").count() == 6000
