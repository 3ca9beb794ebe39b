"""The pivot-cell k-nearest join: the grid's rows with a part of its distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import knn, pivot_knn
from raresift.sources import fixtures as fx

from paths import SF001

POINTS = "row_id long, x array<double>, tag string"


def frame(spark, x, first=0, parts=4):
    return spark.createDataFrame([(first + i, v.tolist(), f"t{i % 3}") for i, v in enumerate(x)], POINTS).repartition(parts)


def told(df):
    return sorted((r["query_id"], r["rank"], r["ref_id"], r["distance"], r["tag"]) for r in df.collect())


def both(q, r, k, **options):
    counter = q.sparkSession.sparkContext.accumulator(0)
    pivots = told(knn.knn_join(q, r, k, "x", ref_cols=["tag"], counter=counter, **options))
    assert pivots == told(knn.knn_join(q, r, k, "x", ref_cols=["tag"], method="grid", **options))
    return counter.value


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_clusters_ties_and_copies(spark, metric, exclude_self):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 20
    x = np.concatenate(
        [
            centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 6)),
            np.repeat(centres[:1], 350, 0),  # a third of the rows are one point
            rng.integers(0, 3, (60, 6)).astype(float),  # many equal distances
        ]
    )
    df = frame(spark, x)
    taken = both(df, df, 4, metric=metric, exclude_self=exclude_self)
    assert taken < len(x) ** 2 / 3


def test_other_queries_few_refs_and_wide_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    q, r = rng.normal(size=(300, 3)), rng.normal(size=(900, 3)) * 2
    both(frame(spark, q, 10_000), frame(spark, r), 7, max_queries_per_cell=64, max_refs_per_cell=90)
    both(frame(spark, q, 10_000), frame(spark, r[:3]), 7)  # fewer refs than k
    one = frame(spark, r[:1])
    assert told(knn.knn_join(one, one, 3, "x", ref_cols=["tag"])) == []  # nobody but itself
    assert knn.knn_join(frame(spark, q), one.where("false"), 3, "x").count() == 0
    assert knn.knn_join(one.where("false"), frame(spark, q), 3, "x").count() == 0


def test_a_hot_cell_is_cut_into_slices():
    cells = pivot_knn.Cells(np.array([[0.0], [5.0], [9.0]]), "euclidean", np.array([1000, 30, 20]), np.zeros(3), np.ones(3), np.zeros((3, 2)))
    first, slots, group_of = pivot_knn.deal(cells, 7)
    size = -(-1050 // 7)
    assert slots[0] == -(-1000 // size) and len(set(group_of[: slots[0]])) == slots[0]
    load = np.zeros(group_of.max() + 1)
    for c in range(3):
        for s in range(slots[c]):
            load[group_of[first[c] + s]] += cells.count[c] / slots[c]
    assert load.max() <= 2 * size


def test_reach_is_an_upper_bound_and_routing_loses_nothing():
    rng = np.random.default_rng(6)
    for metric in ("euclidean", "manhattan"):
        y, q = rng.normal(size=(400, 4)), rng.normal(size=(50, 4)) * 2
        pivots = y[:9]
        cell, radius = pivot_knn._assigner(pivots, metric)(y)
        low = np.full((9, 4), np.inf)
        for c in range(9):
            own = np.sort(radius[cell == c])[:4]
            low[c, : len(own)] = own
        count = np.bincount(cell, minlength=9)
        cells = pivot_knn.Cells(pivots, metric, count, np.array([radius[cell == c].min() for c in range(9)]), np.array([radius[cell == c].max() for c in range(9)]), low)
        d = pivot_knn.distances(q, pivots, metric)
        true = np.sort(pivot_knn.distances(q, y, metric), 1)[:, 2]
        reach = cells.reach(d, 3)
        assert (reach >= true).all()
        ok = cells.reachable(d, true)
        for i in range(50):
            need = cell[pivot_knn.distances(q[i : i + 1], y, metric)[0] <= true[i]]
            assert ok[i, need].all()


def test_transactions_need_a_part_of_the_distances(spark):
    # five features: the samplers' workload
    t = fx.txn(spark, SF001).select("row_id", F.array(*[F.col(c).cast("double") for c in fx.FEATURES]).alias("x"), F.lit("t").alias("tag"), "Class")
    some = t.where("Class = 1 OR row_id % 5 = 0")
    assert both(some, t, 5) < some.count() * t.count() / 3


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_many_dimensions_and_many_copies(spark, metric):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(500, 24)), np.repeat(rng.normal(size=(3, 24)) * 1e3, 120, 0)])
    df = frame(spark, x)
    both(df, df, 6, metric=metric, max_queries_per_cell=200, max_refs_per_cell=150)


def test_distances_of_a_task_hardly_grow_with_its_refs():
    rng, taken = np.random.default_rng(9), []
    x = rng.uniform(size=(600, 4)) * [1000, 24, 100, 300]
    for n in (4000, 32_000):
        y = rng.uniform(size=(n, 4)) * [1000, 24, 100, 300]
        i, j, d, reach, count = pivot_knn.search(x, np.arange(600), np.full(600, np.inf), y, np.arange(n), 5, "euclidean", False)
        whole = np.sort(pivot_knn.distances(x, y, "euclidean"), 1)[:, :5]
        assert np.abs(d.reshape(600, 5) - whole).max() < 1e-8 and np.abs(reach - whole[:, -1]).max() < 1e-8
        taken.append(count)
    assert taken[1] < 2 * taken[0] and taken[1] < 600 * 32_000 / 10


def test_a_task_is_bounded_and_refs_go_to_its_group_only(spark):
    tasks = pivot_knn.Tasks(np.array([0, 10, 25, 1]), 10)
    assert tasks.blocks.tolist() == [0, 1, 3, 1] and tasks.first.tolist() == [0, 0, 1, 4] and tasks.number == 5
    y = np.arange(40.0)[:, None]
    cells = pivot_knn.Cells(np.array([[5.0], [15.0], [25.0], [35.0]]), "euclidean", np.full(4, 10), np.zeros(4), np.full(4, 5.0), np.zeros((4, 2)))
    refs = frame(spark, y).select(F.col("row_id").alias("rid"), F.col("x").alias("rx"))
    first, slots, group_of = np.arange(4), np.ones(4, np.int64), np.arange(4)
    rows = pivot_knn._task_refs(refs, cells, first, slots, group_of, tasks).groupBy("_t").count().collect()
    assert {r["_t"]: r["count"] for r in rows} == {0: 10, 1: 10, 2: 10, 3: 10, 4: 9}
