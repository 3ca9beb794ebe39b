"""Second-order histogram boosting against a plain numpy version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.operators import boosting, classify, splits
from raresift.operators.boosting import UNIT
from raresift.sources import fixtures as fx

from paths import SF0001

FEATS = ["a", "b", "c"]


def data(n=600, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = ((x[:, 0] * x[:, 1] > 0.1) | (x[:, 2] > 1.2)).astype(int)
    if gaps:
        x[rng.random(n) < 0.2, 2] = np.nan
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, Class int").repartition(parts)


def brute(x, y, cuts, rounds, depth, eta, weight, lam=1.0, child=1.0):
    """Margins after ``rounds`` trees, every split tried one by one."""
    m, w = np.zeros(len(y)), np.where(y > 0, weight, 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = np.rint(w * (p - y) * UNIT) / UNIT, np.rint(w * np.maximum(p * (1 - p), 1e-16) * UNIT) / UNIT

        def value(rows):
            return -eta * g[rows].sum() / (h[rows].sum() + lam)

        def split(rows, level):
            best = None
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + lam)
            for f in range(x.shape[1]) if level < depth else []:
                none = np.isnan(x[rows, f])
                for j, c in enumerate([*cuts[f], np.inf]):
                    for left_too in (False, True):
                        go = np.where(none, left_too, x[rows, f] < c)
                        a, b = rows[go], rows[~go]
                        if h[a].sum() < child or h[b].sum() < child:
                            continue
                        gain = 0.5 * (score(a) + score(b) - score(rows))
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, a, b)
            if best is None:
                m[rows] += value(rows)
            else:
                split(best[1], level + 1), split(best[2], level + 1)

        split(np.arange(len(y)), 0)
    return m


@pytest.mark.parametrize("gaps", [False, True])
def test_margins_equal_brute_force(spark, gaps):
    x, y = data(gaps=gaps)
    cuts = [np.array([-1.0, -0.3, 0.0, 0.4, 1.1])] * 3
    est = boosting.HistogramBoosting(posWeight=3.0, rounds=3, maxDepth=3, stepSize=0.5)
    est.cuts = cuts
    df = frame(spark, x, y)
    model = classify.fit(est, df, FEATS)
    got = {r["row_id"]: r["score"] for r in classify.score(model, df).collect()}
    want = 1 / (1 + np.exp(-brute(x, y, cuts, 3, 3, 0.5, 3.0)))
    assert max(abs(got[i] - want[i]) for i in range(len(y))) < 1e-7


def test_replayed_margins_and_partitions_do_not_matter(spark, monkeypatch):
    x, y = data()
    tables = []
    for replay, parts in ((16, 1), (1, 5)):
        monkeypatch.setattr(boosting, "REPLAY", replay)
        est = boosting.HistogramBoosting(rounds=4, maxDepth=3, subsamplingRate=0.7, featureSubset=0.67, maxBins=16)
        est.cuts = [np.linspace(-2, 2, 9)] * 3
        model = classify.fit(est, frame(spark, x, y, parts), FEATS).stages[-1]
        tables.append(sorted(map(tuple, model.tree_table(spark).collect()), key=str))
    assert tables[0] == tables[1]


def test_stops_on_the_validation_rows(spark):
    x, y = data(500, gaps=False)
    rng = np.random.default_rng(0)
    noise = np.where(rng.random(500) < 0.35, 1 - y, y)  # labels that a deep fit learns by heart
    train, valid = frame(spark, x[:300], noise[:300]), frame(spark, x[300:], noise[300:])
    est = boosting.HistogramBoosting(maxIter=40, stale=3, maxDepth=5, stepSize=1.0, minChildWeight=0.0, maxBins=32)
    pipe = classify.make_pipeline(est, FEATS)
    model = boosting.with_validation(pipe, valid).fit(train)
    trees, _ = model.stages[-1].opened()
    assert 1 <= len(trees) < 40

    def loss(k):
        some = boosting.HistogramBoostingModel(trees[:k], model.stages[-1].opened()[1])
        some._set(featuresCol="features")
        s = classify.score(classify.PipelineModel(stages=[model.stages[0], some]), valid).collect()
        return -np.mean([np.log(r["score"] if r["label"] else 1 - r["score"]) for r in s])

    assert loss(len(trees)) <= min(loss(k) for k in range(len(trees))) + 1e-6
    assert est.validation is None and boosting.with_validation(classify.random_forest(), valid).getNumTrees() == 100


def test_cross_validation_hands_over_the_fold(spark, monkeypatch):
    from raresift.operators import select

    seen = []
    fit = boosting.HistogramBoosting._fit

    def watched(self, df):
        seen.append((df.count(), self.validation.count()))
        return fit(self, df)

    monkeypatch.setattr(boosting.HistogramBoosting, "_fit", watched)
    t = splits.stratified_kfold(fx.txn(spark, SF0001), 3)
    est = boosting.HistogramBoosting(maxIter=2, maxDepth=2)
    wrapped = select.ResampledEstimator(classify.make_pipeline(est, fx.FEATURES), None)
    _, trials = select.cross_validate(t, wrapped, [{est.posWeight: 1.0}, {est.posWeight: 5.0}], parallelism=1)
    assert trials.count() == 2 and len(seen) == 6 and {a + b for a, b in seen} == {t.count()}


def test_saved_and_loaded(spark, tmpdir_path):
    x, y = data(200)
    df = frame(spark, x, y)
    model = classify.fit(boosting.HistogramBoosting(rounds=2, maxDepth=2, maxBins=8), df, FEATS)
    model.write().overwrite().save(f"{tmpdir_path}/m")
    back = classify.PipelineModel.load(f"{tmpdir_path}/m")
    a, b = (sorted(map(tuple, classify.score(m, df).collect())) for m in (model, back))
    assert a == b
    table = model.stages[-1].tree_table(spark)
    assert table.where("value IS NULL").count() and table.where(F.col("cut").isNotNull() & F.col("value").isNotNull()).count() == 0


def test_cut_points_come_from_one_sketch(spark):
    x, y = data(400)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    cuts = boosting.learn_cuts(rows, 3, 16)
    for j, c in enumerate(cuts):
        share = np.diff(np.searchsorted(np.sort(x[:, j][~np.isnan(x[:, j])]), c)) / np.sum(~np.isnan(x[:, j]))
        assert 10 <= len(c) <= 15 and share.max() < 0.12
    assert boosting.binned(np.array([[np.nan, -9, 9]]), cuts).tolist() == [[boosting.MISSING, 0, len(cuts[2])]]
