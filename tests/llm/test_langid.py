import math

import numpy as np
from pyspark.sql import functions as F

from raresift.llm import langid as L

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy_and_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.op4_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs)
    odd = [(1, None, "x"), (2, "", "x"), (3, "12 !? 34", "x"), (4, "the and of " * 4000, "x"), (4, "the and of " * 4000, "x"), (None, "the", None)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang_pred string")
    got = [tuple(r) for r in L.predict(df, model, ("p", "s")).collect()]
    assert [r[3] for r in got[:3]] == [L.UNDETERMINED] * 3 and all(r[4] == 0.0 for r in got[:3])
    assert got[3][2:] == got[4][2:] and got[3][3] == "en" and got[3][2] == "x"


def test_nothing_to_learn_from(spark, empty):
    assert L.keep_identified(empty).count() == 0
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.predict(df, L.fit(df)).first()["lang_pred"] == L.UNDETERMINED


def test_labels_and_ids_are_not_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs)
    a = docs.select("doc_id", "text")
    b = docs.select((F.col("doc_id") + 100000).alias("doc_id"), "text")
    get = lambda d: sorted((r["text"], r["lang_pred"], r["lang_score"]) for r in L.predict(d, model).collect())
    assert get(a) == get(b)


def test_document_frequencies_cover_all_training_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs, sample_rows=8)  # the sample bounds the classifier only
    train = docs.where(~L.held_out(F.col("doc_id"))).collect()
    df = np.zeros(L.BUCKETS)
    for r in train:
        df[L.ngram_counts(r["text"])[0]] += 1
    seen = df > 0
    assert np.allclose(model.idf[seen], np.log((1 + len(train)) / (1 + df[seen])) + 1)


def test_temperature():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(3000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(rng.choice(3, p=x)) for x in p]
    assert math.isclose(L.fit_temperature(list(3 * z), y), 3.0, rel_tol=0.1)


def test_elastic_net_gives_zero_weights():
    rng = np.random.default_rng(1)
    rows = [("a" if i % 2 else "b", np.array([i % 2, 2 + i % 50]), np.array([1, 1])) for i in rng.permutation(400)]
    w, _ = L.train_ftrl(rows, ["a", "b"], np.ones(L.BUCKETS), l1=0.5)
    assert (w[2:60] == 0).mean() > 0.5 and w[1, 0] > w[1, 1]
