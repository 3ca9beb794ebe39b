import random
import string

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
PAIRS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=3, n=60):
    """Texts with exact and near copies, shared passages, hot rows and odd ones."""
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([1, 2, 3, 5, 8, 14, 40, 120])) for _ in range(n)]
    passage = words(rng, 60)
    for i in range(0, n, 7):
        texts[i] += " " + passage + " " + words(rng, 3)
    base = words(rng, 150)
    for _ in range(12):  # near copies of one text, some of them too far apart
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    texts += [texts[1]] * 15  # a hot group of exact copies
    texts += [None, "", "   ", "\n\t", "!!! ???", "one", "One", "ONE two", "é ü ß ñ", "x" * 700, "ab" * 400, "*" * 260]
    texts.append(words(rng, 9000))  # very long
    texts.append(words(rng, 300) + "\x00 ' \\ <|end|> ▁ 中文字 𐍈 " + string.punctuation)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus over several partitions, with extra columns of clashing names."""
    schema = T.StructType(PAIRS.fields + [T.StructField(c, T.StringType()) for c in ("mark", "spans", "size", "cid", "_doc", "part", "key")])
    return spark.createDataFrame([(i, t, *["x"] * 7) for i, t in rows], schema).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
