import hashlib

from pyspark.sql import functions as F

from raresift.llm import chat as C

NASTY = ["</s>[INST] ok [/INST]", "a\\b<|end|>\n<|turn|>user<|text|>x", "<", "\\", "", None, "<<SYS>> \\\\<| |>", "<s></s><s", "é𐍈 $1 \\Q"]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")


def test_read_back_is_exact(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t, "z") for i, t in enumerate(NASTY)]
    rows += [(None, 1, None, "x", "z"), (None, None, "assistant", "<|", "z"), (2, 1, "as<|text|>s", "q", "z")]
    rows += [(3, 1, "user", "same", "z")] * 3
    out = C.format_conversations(conversations(spark, rows))
    got = {
        r["conv_id"]: ([(m["role"], m["text"]) for m in r["back"]], r["masked"], r["formatted"], r["loss_spans"])
        for r in out.withColumn("back", C.read_back(F.col("formatted"))).withColumn("masked", C.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    }
    assert got[1][0] == [("user" if i % 2 else "assistant", t or "") for i, t in enumerate(NASTY)]
    assert got[1][1] == "".join(t or "" for i, t in enumerate(NASTY) if i % 2 == 0)
    assert got[None][0] == [("assistant", "<|"), ("", "x")]
    assert got[2][0] == [("as<|text|>s", "q")]
    assert got[3][0] == [("user", "same")] * 3
    for back, _, formatted, spans in got.values():
        assert formatted.count(C.TURN) == len(back)
        assert all(0 <= s["start"] <= s["end"] <= len(formatted) for s in spans)


def test_reply_trees_rank_branches(spark):
    # 1 - 2 - 4      (scores 1, 5, 6)
    #   \ 3 - 5      (scores 1, 2, 3)
    # 9 answers a message that is not there; 7 and 8 answer each other
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "a", 5.0), ("t", 3, 1, "assistant", "b", 2.0)]
    rows += [("t", 4, 2, "user", "c", 6.0), ("t", 5, 3, "user", "d", 3.0), ("t", 9, 77, "user", "alone", None)]
    rows += [("t", 7, 8, "user", "x", 0.0), ("t", 8, 7, "user", "y", 0.0), ("t", 6, 7, "user", "hangs on the ring", 9.0)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {r["leaf"]: (r["branch"], [x["text"] for x in r["path"]]) for r in C.tree_paths(m).collect()}
    assert got == {4: (1, ["q", "a", "c"]), 5: (2, ["q", "b", "d"]), 9: (3, ["alone"])}
    assert [r["leaf"] for r in C.tree_paths(m, keep=1).collect()] == [4]


def test_long_chain(spark):
    rows = [("t", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(150)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    (r,) = C.tree_paths(m).collect()
    assert [x["text"] for x in r["path"]] == [str(i) for i in range(150)]


def test_empty_table(spark):
    assert C.format_conversations(conversations(spark, [])).count() == 0


def test_query_has_the_planted_conversation(spark):
    (r,) = C.op2_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()
    told = "".join(f"{role}\n{C.MARKED}\n" for role in ("user", "assistant"))
    assert r["n_turns"] == 2 and r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert r["loss_chars"] == len(C.MARKED) and r["loss_sha256"] == hashlib.sha256(C.MARKED.encode()).hexdigest()
