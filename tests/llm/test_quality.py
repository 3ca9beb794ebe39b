import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from raresift.llm import quality as Q

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, text string"


def brute_scores(model, texts):
    """Every cosine one by one, all that tie with the last neighbour vote."""
    out = []
    for t in texts:
        at, v = Q.term_weights(t)
        x = np.zeros(Q.TERMS)
        x[at] = v * model.idf[at]
        x = (x / (np.linalg.norm(x) or 1.0)) @ model.axes
        if np.linalg.norm(x) <= 1e-12:
            out.append(model.prior)
            continue
        sim = [round(float(x @ n / np.linalg.norm(x)), 9) for n in model.vectors]
        least = sorted(sim)[-min(Q.NEIGHBOURS, len(sim))]
        vote = [(max(0.0, min(1.0, s)) ** Q.SHARPNESS, y) for s, y in zip(sim, model.labels) if s >= least]
        total = sum(w for w, _ in vote)
        out.append(sum(w * y for w, y in vote) / total if total else model.prior)
    return out


def brute_idf(texts):
    df = Counter(int(a) for t in texts for a in Q.term_weights(t)[0])
    return np.array([math.log((1 + len(texts)) / (1 + df[k])) + 1 for k in range(Q.TERMS)])


def test_scores_equal_brute_force_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    model = Q.fit(docs, labels)
    assert np.allclose(model.idf, brute_idf([t for _, t in rows]))
    train = [i for i in told if zlib.crc32(str(i).encode()) % 5]
    assert len(model.labels) == len(train) and model.labels.sum() == sum(told[i] for i in train)

    got = {r["doc_id"]: r for r in Q.op12_quality(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows}
    some = rows[::9]
    want = brute_scores(model, [t for _, t in some])
    assert max(abs(got[i]["score"] - w) for (i, _), w in zip(some, want)) < 1e-6
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in told if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == told[i] for i in held) >= 0.95 * len(held)
    good = [got[i]["score"] for i in held if told[i] == 1]
    bad = [got[i]["score"] for i in held if told[i] == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.98


def test_the_sample_is_bounded_and_drawn_by_hash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    idf_free = lambda d: sorted((y, a.tobytes()) for y, a, _ in Q.labelled_sample(d, labels, "quality", 50))
    one = idf_free(docs)
    assert len(one) == 50 and one == idf_free(docs.repartition(7))
    hot = docs.unionByName(docs.withColumn("doc_id", F.lit(labels.first()["doc_id"])))  # an id on half of the rows
    assert len(Q.labelled_sample(hot, labels, "quality", 50)) <= 50


def test_labels_of_the_held_out_fold_and_conflicts_are_not_learned(spark, docs, rows):
    told = [(i, i % 2, "x") for i, _ in rows] + [(3, 0, "x"), (3, 1, "x"), (None, 1, "x"), (4, None, "x")]
    labels = spark.createDataFrame(told, LABELS)
    sample = Q.labelled_sample(docs, labels, "quality", 4000)
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 5 != 0 and i != 3 for i, _ in rows)


def test_odd_texts_and_clashing_columns(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, "x") for i, _ in rows], LABELS)
    wide = docs.withColumn("score", F.lit("own")).withColumn("_id", F.lit("own"))
    out = Q.keep_good(wide, labels)
    assert out.schema == wide.schema and out.count() == len(rows)  # all labels say 1
    none = labels.where("false")
    scores = {r["doc_id"]: r["new"] for r in Q.predict(docs, Q.fit(docs, none), ("new", "told")).collect()}
    assert set(scores.values()) == {0.5} and len(scores) == len(rows)
    assert Q.predict(empty, Q.fit(empty, none)).count() == 0
    model = Q.fit(docs, spark.createDataFrame([(i, i % 3 and 1, "x") for i, _ in rows], LABELS))
    again = model.scores([t for _, t in rows])
    assert np.isfinite(again).all() and again[rows.index(rows[1])] == model.scores([rows[1][1]])[0]
    assert model.scores([None])[0] == model.scores([""])[0]


def test_word_and_line_echoes():
    def places(text):
        at, v = Q.term_weights(text)
        return {int(a) - Q.SHAPES: round(float(w * w), 6) for a, w in zip(at, v) if a >= Q.SHAPES}

    # words a b a a c c c: three first ones, four second or third; three follow an equal word
    assert places("a b a a c c c") == {0: round(3 / 7, 6), 1: round(4 / 7, 6), 12: round(3 / 7, 6), 16: 1.0}
    assert places("a a a a a") == {0: 0.2, 1: 0.4, 2: 0.4, 12: 0.8, 16: 1.0}
    assert places("x\nx\ny") == {0: round(2 / 3, 6), 1: round(1 / 3, 6), 12: round(1 / 3, 6), 16: round(2 / 3, 6), 17: round(1 / 3, 6), 28: round(1 / 3, 6)}
    assert places("") == places(None) == places(" \n ") or places(" \n ")[16] > 0
