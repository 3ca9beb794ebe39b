import math
import zlib
from collections import Counter

import numpy as np
import pytest

from raresift.llm import pitman_yor as P


def expected(rows):
    tok = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in tok]
    c = Counter(w for (_, ws), h in zip(tok, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, ws), h in zip(tok, held)}


def test_counts_and_base(docs, rows):
    got = {r["doc_id"]: r for r in P.score_documents(docs).collect()}
    want = expected(rows)
    assert len(got) == len(rows)
    for i, w in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4])
        assert r["score"] < 0


def test_model_beats_base_on_held_out_text(spark):
    got = P.op7_pitman_yor(spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_same_scores_for_other_partitions_and_batches(docs, monkeypatch):
    a = sorted((r["doc_id"], r["score"]) for r in P.score_documents(docs).collect())
    monkeypatch.setattr(P, "BATCH_DOCS", 7)
    b = sorted((r["doc_id"], r["score"]) for r in P.score_documents(docs.repartition(1)).collect())
    assert [i for i, _ in a] == [i for i, _ in b]
    assert np.allclose([s for _, s in a], [s for _, s in b], rtol=1e-9)


def predictor(texts):
    blobs = [b for _, b, _ in P.pack_batch(texts, np.ones(len(texts), bool), 1)]
    c = P.Counts(blobs)
    totals = P.Totals(c.summary().astype(float))
    (t, t0), seats = P.first_seats(c), []
    for r in range(1, P.SWEEPS + 1):
        t, t0 = P.seated(c, totals, t, t0, 0, r)
        seats.append((t, t0))
        totals.history.append((np.bincount(c.g, weights=t, minlength=P.CONTEXTS).astype(float), float(t0.sum())))
    totals.history = totals.history[:1] + totals.history[-P.SAMPLES :]
    return c, totals, P.Predictor(c, totals, seats[-P.SAMPLES :])


def test_probabilities_sum_to_one():
    c, totals, model = predictor(["a b a c a b", "b a d", "a a a a a a a a a"] * 30)
    for context in (0, 5, int(c.g[1]), int(c.g[-1])):
        h = np.append(c.words, np.uint64(123456789))  # every known type and the unknown one
        log_p, _, _ = model.logs(h, np.arange(len(h)), np.full(len(h), context))
        assert (10**log_p).sum() == pytest.approx(1.0)


def plain_scores(rows, parts):
    """log10 probabilities by dictionaries: the same draws, everything else from
    the definition of the two restaurants."""
    from xxhash import xxh3_64_intdigest as digest

    name = lambda w: 0 if w is None else digest(w) or 1
    texts = {i: [name(w) for w in (t or "").encode().lower().split()] + [0] for i, t in rows}
    pairs = {i: list(zip([0] + ws[:-1], ws)) for i, ws in texts.items()}  # the end token is also the beginning
    count = Counter(p for i, ps in pairs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for p in ps)
    words = sorted({w for _, w in count})
    per_word, kinds = Counter(w for _, w in count), Counter(count.values())
    ones = Counter(per_word.values())
    bound = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b) if a else 0.5))
    d, d0, base = bound(kinds[1], kinds[2]), bound(ones[1], ones[2]), 1 / (len(words) + 1)
    t, t0, seen = dict.fromkeys(count, 1), dict.fromkeys(words, 1), []
    tokens = Counter()
    for (u, _), n in count.items():
        tokens[u] += n

    def parent(w):
        guests = sum(t[p] for p in t if p[1] == w)
        return (guests - d0 * t0.get(w, 0) + (1 + d0 * sum(t0.values())) * base) / (1 + sum(t.values()))

    for sweep in range(1, P.SWEEPS + 1):
        p1, tables, parents = {w: parent(w) for w in words}, Counter(), sum(t0.values())
        for (u, _), n in t.items():
            tables[u] += n
        for part in range(parts):
            rng = np.random.default_rng([11, part, sweep])
            own = [w for w in words if w % parts == part]
            # entries in the order of the packed counts: by word, then context
            entries = sorted((p for p in count if p[1] % parts == part), key=lambda p: (p[1], p[0]))
            drawn = P.crp_tables(np.array([count[p] for p in entries], np.int64), np.array([(1 + d * tables[u]) * p1[w] for u, w in entries]), d, rng)
            t.update(zip(entries, drawn.tolist()))
            guests = np.array([sum(t[p] for p in entries if p[1] == w) for w in own], np.int64)
            t0.update(zip(own, P.crp_tables(guests, np.full(len(own), (1 + d0 * parents) * base), d0, rng).tolist()))
        tables = Counter()
        for (u, _), n in t.items():
            tables[u] += n
        wanted = {p for ps in pairs.values() for p in ps}
        p1 = {w: parent(w) for w in {w for _, w in wanted}}
        seen.append({(u, w): ((count[u, w] - d * t[u, w] if (u, w) in count else 0) + (1 + d * tables[u]) * p1[w]) / (1 + tokens[u]) for u, w in wanted})
    return {i: sum(math.log10(sum(s[p] for s in seen[-P.SAMPLES :]) / P.SAMPLES) for p in ps) for i, ps in pairs.items()}


def test_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    texts = ["", None] + [" ".join(f"w{rng.zipf(1.6) % 40}" for _ in range(rng.integers(1, 25))) for _ in range(80)]
    rows = list(enumerate(texts))
    want = plain_scores(rows, P.LEAST_PARTS)
    got = {r["doc_id"]: r["score"] for r in P.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_many_folds_give_the_same_counts(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 37}" for k in range(1, 30)) for i in range(60)]
    blobs = [b for k in range(0, 60, 7) for _, b, _ in P.pack_batch(texts[k : k + 7], np.ones(len(texts[k : k + 7]), bool), 1)]
    one = P.Counts(iter(blobs))
    monkeypatch.setattr(P, "FOLD", 10)
    many = P.Counts(iter(blobs))
    assert (one.c == many.c).all() and (one.g == many.g).all() and (one.words == many.words).all() and (one.contexts == many.contexts).all()


def test_every_word_is_a_context_of_its_own(spark):
    names = [f"w{i}" for i in range(2000)]
    c, _, _ = predictor([" ".join(names)])
    assert len(c.contexts) == len(names) + 1  # and the beginning
    # each word is always followed by the same one: the word before tells it
    rows = [(i, f"a{i % 1500} b{i % 1500}") for i in range(9000)]
    got = P.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out").collect()
    right, wrong = [], []
    for r in P.score_documents(spark.createDataFrame(rows + [(9000 + i, f"a{i} b{(i + 7) % 1500}") for i in range(700)], "doc_id long, text string")).where("held_out").collect():
        (right if r["doc_id"] < 9000 else wrong).append(r["score"])
    assert np.mean(right) > np.mean(wrong) + 1.5
    # log10: about 1 / 1500 for the first word, then the next ones are all but certain
    assert np.mean([r["score"] for r in got]) > -4.5


def test_seating_bounds_and_mean():
    rng = np.random.default_rng(0)
    customers = np.array([1, 2, 5, 100, 5000])
    t = np.array([P.crp_tables(customers, np.full(5, 2.0), 0.5, rng) for _ in range(300)])
    assert (t >= 1).all() and (t <= customers).all()
    # one after another, plainly
    one = []
    for _ in range(2000):
        tables = 1
        for n in range(1, 5):
            tables += rng.random() < 2.0 / (n - 0.5 * tables + 2.0)
        one.append(tables)
    assert t[:, 2].mean() == pytest.approx(np.mean(one), abs=0.2)


def test_nothing_to_learn(spark, empty):
    assert P.score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = P.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["base_score"] == 0.0
