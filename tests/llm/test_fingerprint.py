import hashlib

import numpy as np

from raresift.llm import fingerprint as P


def entropy_code(window: bytes) -> int:
    total = 0
    n = {}
    for c in window:  # same integer steps, one byte after another
        total += int(P._STEP[n.get(c, 0)])
        n[c] = n.get(c, 0) + 1
    return max(0, min(P.CODES, P.CODES - (total * P.CODES) // int(P._LOG[P.WINDOW] * 1e6 + 0.5)))


def test_entropy_of_every_window(rows):
    texts = [(t or "").encode()[:900] for _, t in rows]
    for t, codes in zip(texts, P.code_arrays(texts)):
        assert codes.tolist() == [entropy_code(t[i : i + P.WINDOW]) for i in range(len(t) - P.WINDOW + 1)]


def test_selection_by_brute_force(rows):
    rng = np.random.default_rng(0)
    rank = rng.permutation(P.CODES + 1)
    rank[: P.LEAST_CODE] = -1
    texts = [(t or "").encode()[:1500] for _, t in rows]
    for codes in P.code_arrays(texts):
        n = len(codes)
        points = np.zeros(n, int)
        key = [(rank[c] if rank[c] >= 0 else 1 << 20, i) for i, c in enumerate(codes)]
        for a in range(max(1, n - P.SPAN + 1) if n else 0):
            points[min(key[a : a + P.SPAN])[1]] += 1
        least = P.POINTS if n >= P.SPAN else 1
        want = [i for i in range(n) if points[i] >= least and rank[codes[i]] >= 0]
        assert P.select_features(codes, rank).tolist() == want


def test_rarity_counts_every_window(docs, rows):
    n = np.zeros(P.CODES + 1, int)
    for codes in P.code_arrays([(t or "").encode() for _, t in rows]):
        np.add.at(n, codes, 1)
    rank = P.rarity(docs)
    order = sorted(range(P.CODES + 1), key=lambda c: (n[c], c))
    assert all(rank[c] == i for i, c in enumerate(order) if c >= P.LEAST_CODE)


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in P.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    text = {i: t or "" for i, t in rows}
    ids = sorted(text, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        k = len(text[a]) // 3
        want = text[a][: len(text[a]) - k] + text[b][:k]
        assert got[a]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[a]["n_chars"] == len(text[a])
        assert 0 <= got[a]["near_edited"] <= 1 and 0 <= got[a]["near_next"] <= 1
        if text[a] == want:
            assert got[a]["near_edited"] == 1.0
    by_text = {}
    for i in ids:
        assert by_text.setdefault(text[i], got[i]["fingerprint"]) == got[i]["fingerprint"]
    long = [i for i in ids if len(text[i]) > 600 and len(set(text[i])) > 5]
    assert np.mean([got[i]["near_edited"] for i in long]) > 0.4


def test_repeated_ids_nulls_and_one_row(spark, empty):
    rows = [(1, "a b"), (1, "a c"), (2, None), (None, "zz"), (None, "yy")]
    got = P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 2), (0, 2), (1, 3), (1, 3), (2, 0)]
    (one,) = P.fingerprints(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert P.fingerprints(empty).count() == 0
