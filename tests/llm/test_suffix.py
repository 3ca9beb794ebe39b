import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.llm import suffix as S


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((-1 if i is None else i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def told(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, df.collect()))


@pytest.mark.parametrize("length", [200, 64, 50])
def test_removed_bytes(docs, rows, length):
    assert told(S.digests(docs, length)) == brute(rows, length)


def test_random_small_alphabet(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) * rng.randint(1, 9)) for i in range(60)]
    assert told(S.digests(spark.createDataFrame(rows, "doc_id long, text string"), 50)) == brute(rows, 50)


def test_hot_anchors_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(S, "COLLECTION", 8)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, tails = word(150), [word(90) for _ in range(5)]
    rows = [(i, word(rng.randint(0, 80)) + passage + rng.choice(tails)[: rng.randint(0, 90)] + word(rng.randint(0, 40))) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(12)] + [(200 + i, word(120)) for i in range(9)] + [(300, rows[40][1] + word(70))]
    most, salted, gather = [], [], S.repeated_spans

    def held(found, length):
        most.append(found.where("salt = 0").groupBy("key").agg(F.sum(F.size("ids")).alias("n")).agg(F.max("n")).first()[0] or 0)
        salted.append(found.where("salt > 0").count())
        return gather(found, length)

    monkeypatch.setattr(S, "repeated_spans", held)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert told(S.digests(df, 64)) == brute(rows, 64)
    assert most[0] <= 8 and salted[0] > 8


def test_repeated_windows_by_brute_force():
    rng = random.Random(2)
    core = "".join(rng.choice("abcd") for _ in range(400))
    texts, lead, group = [], [], []
    for i in range(80):
        a = rng.randrange(0, 60)
        t = list(core[a : a + rng.randint(80, 220)])
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = "x"
        texts.append("".join(t).encode()), lead.append(100 - a), group.append(i % 3)
    pick = {(g, off, t): k for k, (g, off, t) in enumerate(zip(group, lead, texts))}
    keep = sorted(pick.values())
    texts, lead, group = [texts[k] for k in keep], np.array([lead[k] for k in keep]), np.array([group[k] for k in keep])
    got = S.repeated_windows(group, lead, texts, 40)
    place = Counter((group[k], p - lead[k], t[p : p + 40]) for k, t in enumerate(texts) for p in range(len(t) - 39))
    for k, t in enumerate(texts):
        assert got[k].tolist() == [place[(group[k], p - lead[k], t[p : p + 40])] > 1 for p in range(len(t) - 39)]


def test_long_documents_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    monkeypatch.setattr(S, "PIECE", 500)
    whole = S.anchors(np.frombuffer(text.encode(), np.uint8))
    spans = list(zip(*(x.tolist() for x in whole[2:])))
    assert spans[0][0] == 0 and spans[-1][1] == len(text) - S.LENGTH
    assert all(b[0] == a[1] + 1 for a, b in zip(spans, spans[1:]))


def test_ids_may_repeat_or_be_null(spark, empty):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(500))
    rows = [(1, long), (1, long + "tail"), (None, "x" + long), (None, None), (2, "é" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(S.digests(df)) == brute(rows, 200)
    assert S.digests(empty).count() == 0


def test_cut_documents_keep_their_columns(spark, docs, rows):
    out = S.remove_repeats(docs, 64)
    assert out.schema == docs.schema
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r["spans"] == "x" and r["_doc"] == "x" for r in got.values())
    assert got[1]["text"] == "" if len(rows[1][1].encode()) >= 64 else got[1]["text"] == rows[1][1]
