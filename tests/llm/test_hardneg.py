import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.llm import hardneg as H


def brute(rows, every=5, positives=H.POSITIVES, negatives=H.NEGATIVES):
    kept = []
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], lab))
    out = []
    for a, (i, v, lab) in enumerate(kept):
        if i % every:
            continue
        score = [(-sum(p * q for p, q in zip(v, w)), j, b) for b, (j, w, _) in enumerate(kept)]
        best = sorted((s, j) for s, j, b in score if b != a and kept[b][2] == lab)[:positives]
        for ps, pid in best:
            fits = sorted((s, j) for s, j, b in score if kept[b][2] != lab and 50 * -ps <= 100 * -s <= 95 * -ps)
            out += [(i, pid, n + 1, j, -ps, -s) for n, (s, j) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(n=260, d=20, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d)) / d**0.5
    rows = [(i, (centres[i % 9] + rng.normal(size=d) * 0.1).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[5][1], i % 4) for i in range(90)]  # a hot vector under all labels
    rows += [(2000, None, 1), (2005, [float("nan")] * d, 1), (2010, [None] * d, 1), (2015, [0.5] * d, None), (None, rows[3][1], 2)]
    rows += [(2020, [], 2), (2025, [0.5, 0.25], 2), (2030, [0.0] * d, 3), (2035, [-x for x in rows[5][1]], 1), (2040, rows[7][1], 99)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, home string, place string, score int"


def mined(spark, rows, every=5, parts=3):
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(parts)
    out = H.hard_negatives(df, F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = vectors(seed=seed)
    assert mined(spark, rows) == brute(rows)


def test_many_shards_cells_and_blocks(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 25), ("BLOCK", 4), ("CELL", 9), ("STEP", 3), ("GROUP", 3)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(150)
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, None, 1)], [(5, [1.0, 2.0], 1)], [(5, [1.0], 1), (6, [0.5], 1), (7, [0.3], 2), (5, [1.0], 1)]])
def test_few_rows(spark, rows):
    # one id on two rows: each is an anchor of its own and the other's positive
    assert mined(spark, rows) == brute(rows)


def test_join_is_exact_at_every_threshold():
    rng = np.random.default_rng(3)
    for size in (40, 4000):
        x = rng.integers(-size, size, (500, 19))
        y = rng.integers(-size, size, (70, 19))
        index = H.Index(x, np.arange(500), np.zeros(500, np.int64))
        want = x @ y.T
        for share in (0.9, 0.5, 0.1, 0.0, -0.5):
            t = np.floor(share * (y**2).sum(1)).astype(np.float64)
            a, r, s = index.join(index.anchors(y), t)
            assert sorted(zip(a.tolist(), r.tolist(), s.tolist())) == sorted((j, i, int(want[i, j])) for i, j in zip(*np.nonzero(want >= t)))


def test_high_thresholds_leave_lists_unread():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(3000, 64)) / 8).astype(np.int64)
    index = H.Index(x, np.arange(3000), np.zeros(3000, np.int64))
    index.prepare()
    read = []
    for g, v in enumerate(index.values):
        class Seen(np.ndarray):
            def __getitem__(self, at, g=g):
                out = np.asarray(self)[at]
                read.append((g, len(out)))
                return out

        index.values[g] = v.view(Seen)
    y = index.anchors(x[:64])
    a, r, _ = index.join(y, 0.95 * (y**2).sum(1))
    assert sorted(zip(a.tolist(), r.tolist())) == [(k, k) for k in range(64)]
    assert sum(n for _, n in read) < 0.75 * 3000 * len(index.values)  # omitted and pruned rows
