"""Chat formatting of reply trees, with DataFrame functions only.

Input: one row per message (tree, node, parent, role, text, score).  Root-to-leaf
paths are enumerated by iterative self-joins that double their reach: round k
gives every node its ancestor 2^k steps up, until no node has one, so a reply
chain of d messages takes log2(d) joins, and a second run over those tables
collects the ancestors of the *leaves* only (output = sum of path lengths).
The paths of a tree are ranked by the mean score of their messages (ties:
smaller leaf first), and every chosen path becomes one formatted conversation.

Template: ``<|turn|>ROLE<|text|>TEXT<|end|>\\n`` per message.  Inside roles and
texts every backslash is doubled and a backslash is put after the first
character of every control string (``CONTROLS``), so no control string is left
and removing one backslash before each character restores the input exactly.

Defined results: null roles and texts are empty; a node whose parent is missing
is a root; rows with a null tree form one tree; repeated nodes are kept, one
after another (ties by role, then text); an empty table gives an empty result.
A reply cycle has no root, hence no path: its rows belong to no conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raresift.llm.catalog import register
from raresift.llm.common import materialize, read

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: template marks begin with the first; the others belong to public chat templates
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(c: Column) -> Column:
    """Text without control strings (see the module text)."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(s[0] + "\\" + s[1:])), CONTROLS, c)


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def tree_paths(messages: DataFrame, score: str = "score", keep: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees, ranked by mean score.

    ``messages``: tree string, node long, parent long (null at a root), role,
    text, ``score``.  (tree, node) must be unique.  Returns tree, leaf, branch
    (1 = best), branch_score and ``path``: array of (depth, role, text) from
    the root.  ``keep`` bounds the branches per tree (None: all).
    """
    nodes = messages.select("tree", "node", "parent", "role", "text", F.col(score).cast("double").alias("score"))
    ids = nodes.select("tree", "node")
    # (node, ancestor) one step up; a parent that is not in the tree counts as none
    up = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("above"), "node")
    up = materialize(up.join(ids.withColumnRenamed("node", "above"), ["tree", "above"], "left_semi").select("tree", "node", "above"))
    leaves = ids.join(up.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    n, jumps, step = up.count(), [], up
    while step.limit(1).count():
        jumps.append(step)
        if 1 << (len(jumps) - 1) > n:  # farther than any path: these nodes lead into a cycle
            leaves = leaves.join(step.select("tree", "node"), ["tree", "node"], "left_anti")
            break
        # only nodes that reach as far as this take part in the next round
        a, b = step.alias("a"), step.alias("b")
        step = materialize(
            a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.above") == F.col("b.node"))).select(
                F.col("a.tree").alias("tree"), F.col("a.node").alias("node"), F.col("b.above").alias("above")
            )
        )
    line = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    for k in range(len(jumps) - 1, -1, -1):
        more = line.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))
        line = materialize(line.unionByName(more))  # the plan would double each round
    full = line.join(nodes, ["tree", "node"])
    entry = F.struct((-F.col("dist")).alias("depth"), F.col("role"), F.col("text"))
    paths = full.groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(entry)).alias("path"), F.avg("score").alias("branch_score")
    )
    by = Window.partitionBy("tree").orderBy(F.col("branch_score").desc_nulls_last(), "leaf")
    paths = paths.withColumn("branch", F.row_number().over(by))
    return paths if keep is None else paths.where(F.col("branch") <= keep)


def format_paths(paths: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss_spans``: (start, end) code points of every
    assistant text inside ``formatted``."""
    turns = F.transform("path", lambda m: F.struct(escape(m["role"]).alias("role"), escape(m["text"]).alias("text")))
    df = paths.withColumn("_turns", turns)
    one = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END + "\n"))
    df = df.withColumn("formatted", F.array_join(F.transform("_turns", one), ""))
    head, tail = len(TURN) + len(TEXT), len(END) + 1
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def walk(acc, t):
        a = acc["at"] + head + F.length(t["role"])
        b = a + F.length(t["text"])
        own = F.array(F.struct(a.alias("start"), b.alias("end")))
        none = F.array().cast("array<struct<start:long,end:long>>")
        return F.struct(
            (b + tail).alias("at"),
            F.concat(acc["spans"], F.when(t["role"] == "assistant", own).otherwise(none)).alias("spans"),
        )

    df = df.withColumn("loss_spans", F.aggregate("_turns", start, walk, lambda acc: acc["spans"]))
    return df.drop("_turns")


def read_back(formatted: Column) -> Column:
    """Array of (role, text) out of formatted text."""
    turns = F.filter(F.split(formatted, r"\Q" + TURN + r"\E", -1), lambda x, i: i > 0)
    role = lambda x: F.substring_index(x, TEXT, 1)

    def text(x):
        rest = F.substr(x, F.length(role(x)) + F.lit(len(TEXT) + 1))
        return F.substring_index(rest, END, 1)

    return F.transform(turns, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(text(x)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, joined with nothing between."""
    cut = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each row
    answers the row before it.  Node numbers are ranks, so repeated turns stay."""
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(
        tree.alias("tree"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of linear conversations."""
    trees = materialize(linear_trees(conversations))
    out = format_paths(tree_paths(trees))
    conv = F.when(F.col("tree") != "none", F.substr("tree", F.lit(2))).cast("long")
    return out.select(conv.alias("conv_id"), "branch", "formatted", "loss_spans")


MARKED = "</s>[INST] ok [/INST]"

OP2_SQL = f"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{MARKED}'
    UNION ALL SELECT -7, 1, 'assistant', '{MARKED}'
), esc AS (
    SELECT *, {{e_role}} AS e_role, {{e_text}} AS e_text FROM rows_
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(e_role) + length(e_text) + {len(TURN) + len(TEXT) + len(END) + 1}) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""


def _sql_escape(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for s in CONTROLS:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


@register("op2_chat", OP2_SQL.format(e_role=_sql_escape("role"), e_text=_sql_escape("text")))
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, with digests read back from the output."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKED).alias("text"),
    )
    conv = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(extra)
    out = format_conversations(conv).withColumn("back", read_back(F.col("formatted")))
    out = out.withColumn("masked", masked_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("back", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
