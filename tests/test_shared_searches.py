"""Trials of kNN that differ in k only share their searches."""

import numpy as np

from raresift.operators import classify, knn


def test_trials_of_one_metric_share_a_search(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), int(a + b > 1.2)) for i, (a, b) in enumerate(rng.integers(0, 20, (300, 2)) / 10)]
    rows += rows[:7]  # ids and rows that come twice
    df = spark.createDataFrame(rows, "row_id long, a double, b double, Class int").repartition(3)
    train, valid = df.where("row_id % 3 <> 0"), df.where("row_id % 3 = 0")
    est = knn.KNNClassifier()
    grid = [{est.k: k, est.metric: m} for k in (1, 3, 8) for m in ("euclidean", "manhattan")]
    pipeline, searched, join = classify.make_pipeline(est, ["a", "b"]), [], knn.knn_join
    alone = [classify.score(pipeline.fit(train, m), valid).select("row_id", "score").collect() for m in grid]
    monkeypatch.setattr(knn, "knn_join", lambda q, r, k, *a, **kw: searched.append(k) or join(q, r, k, *a, **kw))
    models = dict(pipeline.fitMultiple(train, grid))
    shared = [classify.score(models[i], valid).select("row_id", "score").collect() for i in range(len(grid))]
    assert [sorted(x) for x in shared] == [sorted(x) for x in alone]
    assert searched == [8, 8]
    other = models[0].copy({models[0].stages[-1].k: 5})  # a point that was not in the grid
    assert classify.score(other, valid).count() and searched == [8, 8, 5]
