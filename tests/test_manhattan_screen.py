"""Pairs screened in 16-bit steps: none within the limit is lost, few others stay."""

import numpy as np

from raresift.operators import pivot_knn


def test_every_near_pair_stays_and_few_others():
    rng = np.random.default_rng(3)
    for d, shift in ((64, 0.0), (9, 1e6), (150, -3.0)):
        y = rng.normal(size=(1300, d)) + shift
        x = np.concatenate((y[:5], rng.normal(size=(60, d)) + shift))
        whole = pivot_knn.distances(x, y, "manhattan")
        limit = np.sort(whole, 1)[:, 9]
        i, j = pivot_knn._near_by_steps(x, y, limit)
        kept = np.zeros(whole.shape, bool)
        kept[i, j] = True
        assert kept[whole <= limit[:, None]].all()
        assert kept.sum() < 3 * 10 * len(x)


def test_equal_rows_and_the_distances_told():
    x = np.full((3, 12), 7.5)
    i, j, d = pivot_knn._close(x, np.full((700, 12), 7.5), "manhattan", np.zeros(3))
    assert len(i) == 2100 and not d.any()
    assert not len(pivot_knn._close(x, np.full((700, 12), 8.0), "manhattan", np.full(3, 5.9))[0])


def test_a_screened_pair_moves_two_bytes_a_dimension():
    """Refs of 64 dimensions: the old screen kept single precision."""
    seen = []
    minimum = np.minimum

    class Watch:
        def __getattr__(self, name):
            return getattr(np, name)

        def minimum(self, a, b, **kw):
            if "out" in kw:
                seen.append(kw["out"].dtype.itemsize)
            return minimum(a, b, **kw)

    rng = np.random.default_rng(4)
    pivot_knn.np, old = Watch(), pivot_knn.np
    try:
        pivot_knn._close(rng.normal(size=(20, 64)), rng.normal(size=(300, 64)), "manhattan", np.full(20, 50.0))
    finally:
        pivot_knn.np = old
    assert len(seen) == 64 and set(seen) == {2}
