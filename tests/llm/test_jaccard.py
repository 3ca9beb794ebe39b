import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.llm import jaccard as J
from raresift.llm.components import connected_components


def sets_of(rows, words):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, words, numer, denom):
    s = sets_of(rows, words)
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and rows[a][0] is not None and rows[b][0] is not None and denom * len(s[a] & s[b]) >= numer * len(s[a] | s[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted((-1 if i is None else i, len(x), -1 if i is None else least[c]) for (i, _), x, c in zip(rows, s, comp))


def told(df):
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in df.collect())


@pytest.mark.parametrize("words,numer", [(4, 85), (5, 80), (1, 85), (1, 60)])
def test_components(docs, rows, words, numer):
    assert told(J.jaccard_components(docs, words, numer, 100)) == brute(rows, words, numer, 100)


def test_light_sets_alone(spark, monkeypatch):
    import random

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 16)))) for i in range(120)]
    monkeypatch.setattr(J, "choose_boundary", lambda *a: 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(J.jaccard_components(df, 1, 85, 100)) == brute(rows, 1, 85, 100)


def test_every_list_is_scanned_without_chains(docs, rows, monkeypatch):
    monkeypatch.setattr(J, "CHAIN_ORDERS", 0)
    assert told(J.jaccard_components(docs)) == brute(rows, 4, 85, 100)


def test_repeated_and_null_ids_and_empty(spark, empty):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A B c\td  e"), (None, "a b c d e"), (None, None), (5, None), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(J.jaccard_components(df)) == brute(rows, 4, 85, 100)
    assert J.jaccard_components(empty).count() == 0
    kept = [r["doc_id"] for r in J.keep_one(df).collect()]
    assert sorted(kept, key=lambda x: -1 if x is None else x) == [None, None, 1, 5, 6]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 7), (3, 3), (1, 500), (500, 501), (2, 501)] + [(1000, k) for k in range(1001, 1200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {**{i: 100 for i in range(100, 161)}, 7: 7, 9: 7, 1: 1, 500: 1, 501: 1, 2: 1, **{k: 1000 for k in range(1000, 1200)}}
    assert got == want


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    """One list of many sets that are not connected: blocks of it meet."""
    import random

    rng = random.Random(5)
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "CHAIN_ORDERS", 0)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):
        own = base[:40] + [f"g{g}x{i}" for i in range(40)]
        for k in range(6):
            w = list(own)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(80)] = f"r{g}{k}{rng.randrange(99)}"
            rows.append((g * 10 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cells = []
    scan = J._in_lists

    def watched(frame, emit):
        if "side" in frame.columns:
            cells.append(frame.groupBy("key").count().agg(F.max("count")).first()[0])
        return scan(frame, emit)

    monkeypatch.setattr(J, "_in_lists", watched)
    assert told(J.jaccard_components(df, 1, 80, 100)) == brute(rows, 1, 80, 100)
    assert cells and max(c or 0 for c in cells) < 40  # two blocks at most, about 14


def test_pairs_of_the_largest_component_are_not_tried():
    n = 30_000
    emit = J._scan(85, 100)
    size, cid = np.full(n, 100), np.arange(n)
    comp = np.where(cid % 1000 == 0, cid, 7)  # thirty sets stand outside
    bits = np.empty(n, object)
    rng = np.random.default_rng(1)
    bits[:] = list(rng.integers(-(1 << 62), 1 << 62, (n, J.BITMAP // 128)))
    a, b, _ = emit(np.zeros(n, np.int64), np.zeros(n, np.int64), size, cid, comp, bits)
    assert len(a) == 0  # random bitmaps: none is near


def test_counters_are_packed():
    """What a task sends for the sketch follows the counts, not four bytes each."""
    rng = np.random.default_rng(3)
    n = rng.poisson(2, J.CHUNK).astype(np.uint32)
    n[7] = 0xFFFFFFFF
    assert (J._unpack(J._pack(n)) == n).all()
    assert len(J._pack(n)) < J.CHUNK / 2


def test_bitmaps_of_large_sets_tell_near_misses():
    """Large sets below the threshold stop at the bitmap; those that link don't."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 4000
    rows = []
    for far in (600, 800, 2):  # of 8000 elements in both: 0.86, 0.82 and equal but for two
        both = rng.integers(0, 1 << 63, n - far // 2).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, far // 2).astype(np.uint64)]) for _ in range(2))
        rows.append([J.parity_bitmap(s, J.sharp_width(n)) for s in (a, b)])
        # the bitmaps of lists, 2048 bits, let all of them through
        apart = np.bitwise_count((J.parity_bitmap(a) ^ J.parity_bitmap(b)).view(np.uint64)).sum()
        assert apart * 185 <= 15 * 2 * n
    rows.append([rows[2][0], J._halved(rows[2][1])])  # widths may differ
    k = len(rows)
    ids, size = pa.array(range(k), pa.int64()), pa.array([n] * k, pa.int64())
    a, b = (pa.array([r[x] for r in rows], pa.list_(pa.int64())) for x in (0, 1))
    batch = pa.RecordBatch.from_arrays([ids, ids, size, size, a, b], names=["a", "b", "sa", "sb", "ba", "bb"])
    out = pa.Table.from_batches(J._near(85, 100)([batch]))
    assert out["a"].to_pylist() == [0, 2, 3]
    assert len(rows[0][0]) * 64 >= 1.7 * n


def test_closest_pair_of_two_components(spark):
    pairs = spark.createDataFrame([(1, 5, 9, 9, 0.2), (2, 5, 9, 9, 0.1), (6, 1, 9, 9, 0.3), (3, 4, 9, 9, 0.4)], "a long, b long, sa long, sb long, apart double")
    comp = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "cid long, comp long")
    assert sorted((r.a, r.b) for r in J._closest(pairs, comp).collect()) == [(2, 5), (3, 4)]
