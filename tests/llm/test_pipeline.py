import corpus_pipeline as C
import test_jaccard
from pyspark.sql import functions as F

from raresift.llm import langid, packing, suffix

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("mark", F.lit("own"))
    odd = spark.createDataFrame([(900001, None), (900002, "123 456"), (900003, "")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    stages = dict(C.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "repeated_passages", "packing"]

    kept = stages["language_id"](spark, docs, SF).cache()
    assert kept.schema == docs.schema
    told = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    want = {i for i, r in told.items() if r["lang_pred"] != "und" and r["lang_score"] >= 0.3}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert {i for i, _ in rows} == want and not want & {900001, 900002, 900003}
    assert len(rows) >= 0.98 * (docs.count() - 3)

    one = stages["near_duplicates"](spark, kept, SF).cache()
    assert one.schema == docs.schema
    groups = {i: c for i, _, c in test_jaccard.brute(rows, 5, 80, 100)}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups.values()))

    cut = stages["repeated_passages"](spark, one, SF).cache()
    assert cut.schema == docs.schema
    import test_suffix

    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    sizes = {i: n - gone for i, n, gone, _, _ in test_suffix.brute(left, suffix.LENGTH)}
    got = cut.collect()
    assert {r["doc_id"] for r in got} == set(sizes)
    assert all(sizes[r["doc_id"]] - 8 <= len(r["text"].encode()) <= sizes[r["doc_id"]] for r in got)
    assert all(r["n_chars"] == len(r["text"]) and r["mark"] == "own" for r in got)

    tok = packing.word_tokenizer(packing.tokenizer_spec())
    packed = stages["packing"](spark, cut, SF).collect()
    tokens = {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {r["doc_id"]: len(tok.encode(r["text"])) // 4 + 1 for r in got}


def test_run(spark):
    assert C.ORACLE_SQL is None
    assert C.run(spark, SF).count() >= 100
