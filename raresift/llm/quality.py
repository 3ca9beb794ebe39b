"""Quality classifier: nearest-neighbour voting among labelled latent-semantic
vectors.

Terms of a text describe its shape, not its words, so they hold for any
language: symbol 1-, 2- and 3-grams after every letter, digit and blank became
its class and runs of a class one symbol, hashed into ``SHAPES`` places, and how
often words came back (``ECHOES`` places).  Their shares in the text, square
rooted, times idf, scaled to length one, are projected on the ``RANK`` leading
right singular vectors of the labelled sample (latent-semantic analysis).

The idf counts every document of the corpus.  At most ``SAMPLE_ROWS`` labelled
documents outside the held-out fold, drawn by a fixed hash, are the neighbours
(the documented bound; also the bound of what is broadcast: ``SAMPLE_ROWS``
vectors of ``RANK`` numbers).  Every document takes exact cosine products with
all of them, in blocks, and the ``NEIGHBOURS`` nearest vote with their
similarity to the power ``SHARPNESS``; equal similarities at the border all
vote, so the vote depends on no order.

Defined results: a null text counts as empty, which has a score too; without
anything to learn from the score is 0.5; a text that no neighbour resembles gets
the share of label 1 in the sample; ids with conflicting labels, null ids and
null labels are not learned from; labels other than 0 count as 1; repeated rows
get equal scores; other columns are passed through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift.llm.catalog import register
from raresift.llm.common import crc_text, fresh, read

SHAPES = 1 << 11
ECHOES = 32
TERMS = SHAPES + ECHOES
SAMPLE_ROWS = 4000
RANK = 32
NEIGHBOURS = 15
SHARPNESS = 8
BLOCK = 256
FOLDS = 5
THRESHOLD = 0.3

_CLASSES: list[np.ndarray] = []
_BREAK = 10
#: one less than the least occurrence in each place: 1, 2, 4, ...
_LOWS = (1 << np.arange(12)) - 1


def _classes() -> np.ndarray:
    """For every code point the symbol that stands for it (built once a worker):
    capital, other letter, digit, blank, or itself."""
    if not _CLASSES:
        out = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = 65 if c.isupper() else 97
            elif c.isdigit():
                out[i] = 48
            elif c.isspace() and i != _BREAK:
                out[i] = 32
        _CLASSES.append(out)
    return _CLASSES[0]


def _shapes(kind: np.ndarray) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the run-length-free classes."""
    run = (kind[1:] == kind[:-1]) & ((kind[1:] == 97) | (kind[1:] == 65) | (kind[1:] == 48) | (kind[1:] == 32))
    k = np.concatenate(([_BREAK], kind[:1], kind[1:][~run], [_BREAK])).astype(np.uint32)
    one = k * np.uint32(2654435761)
    two = (one[:-1] ^ (k[1:] + np.uint32(0x9E37))) * np.uint32(2246822519)
    three = (two[:-1] ^ (k[2:] + np.uint32(0x85EB))) * np.uint32(3266489917)
    shift = np.uint32(32 - SHAPES.bit_length() + 1)
    return sum(np.bincount(h >> shift, minlength=SHAPES) for h in (one[1:-1], two, three))


def _echoes(c: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Of the words: how many are the first, second to third, fourth to seventh,
    ... occurrence of their kind and how many equal the word before, as shares;
    the same of the lines."""
    out = np.zeros(ECHOES)
    for blank, at in (((kind == 32) | (kind == _BREAK), 0), (kind == _BREAK, 16)):
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        start = edge[::2]
        if not len(start):
            continue
        first = np.zeros(len(c), np.int64)
        first[start] = start
        place = (np.arange(len(c)) - np.maximum.accumulate(first)).astype(np.uint64)
        h = (c.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD1B54A32D192ED03))
        h ^= h >> np.uint64(31)
        h[blank] = 0
        word = np.add.reduceat(h, start) * np.uint64(0xBF58476D1CE4E5B9)
        n = np.unique(word, return_counts=True)[1]
        # words that are an occurrence of at least 1, 2, 4, ... of their kind
        several = n[n > 1][:, None]
        reach = np.maximum(several - _LOWS, 0).sum(0)
        reach[0] += len(n) - len(several)
        out[at : at + 12] = reach - np.append(reach[1:], 0)
        out[at + 12] += (word[1:] == word[:-1]).sum()
        out[at : at + 13] /= len(start)
    return out


def term_weights(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights before idf) of a whole text."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[c]
    shapes = _shapes(kind).astype(np.float64)
    v = np.concatenate((shapes / max(1.0, shapes.sum() / 3), _echoes(c, kind)))
    at = np.flatnonzero(v)
    return at, np.sqrt(v[at])


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_text(doc_id), F.lit(FOLDS)) == 0


class Model:
    """Latent directions with the idf worked in, labelled vectors and labels."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.axes, self.vectors, self.labels = idf, axes, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def project(self, terms: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit latent vectors (zero where nothing is left)."""
        out = np.zeros((len(terms), self.axes.shape[1]))
        for k, (at, v) in enumerate(terms):
            v = v * self.idf[at]
            out[k] = (v / (np.sqrt(v @ v) or 1.0)) @ self.axes[at]
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.where(size > 1e-12, out / np.maximum(size, 1e-12), 0.0)

    def scores(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            q = self.project([term_weights(t) for t in texts[a : a + BLOCK]])
            sim = np.round(q @ self.vectors.T, 9)  # free of the order of summation
            least = np.partition(sim, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            vote = np.where(sim >= least[:, None], sim.clip(0, 1), 0.0) ** SHARPNESS
            weight, yes = vote.sum(1), vote @ self.labels
            out[a : a + BLOCK] = np.where(weight > 0, yes / np.where(weight > 0, weight, 1.0), self.prior).clip(0, 1)
        return out


def latent_axes(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """Leading right singular vectors of ``x`` by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.linalg.qr(np.random.default_rng(11).normal(size=(x.shape[1], min(x.shape[1], rank + 8))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2][:rank].T


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of every term over all documents (at most a row a term collected)."""

    def run(batches):
        df, rows = np.zeros(TERMS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                df[term_weights(text)[0]] += 1
                rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], rows), pa.int64())], names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r[0]: r[1] for r in counted.collect()}
    n = df.pop(-1, 0) or 0
    idf = np.full(TERMS, np.log(1 + n) + 1)
    if df:
        idf[list(df)] = np.log((1 + n) / (1 + np.array(list(df.values())))) + 1
    return idf


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list:
    """(label, places, weights) of at most ``rows`` labelled training documents."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    yes = (F.col(label) != 0).cast("int")
    told = told.groupBy("doc_id").agg(F.min(yes).alias("y"), F.max(yes).alias("_y")).where("y = _y").select(F.col("doc_id").alias("_id"), "y")
    draw = F.xxhash64(F.col("_id"), F.lit(17))
    picked = told.orderBy(draw, "_id").limit(rows)  # at most ``rows`` ids are broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "y", "text")

    def run(batches):
        for b in batches:
            got = [term_weights(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([v.astype("<f8").tobytes() for _, v in got], pa.binary())],
                names=["_id", "y", "at", "v"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    terms = found.mapInArrow(run, f"_id {kind}, y int, at binary, v binary")
    # an id on several documents could bring more rows than ids
    sample = terms.orderBy(draw, "_id", "at", "v").limit(rows).collect()
    return [(r["y"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["v"], "<f8")) for r in sample]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, rank: int = RANK) -> Model:
    """Learn ``label`` of ``labels`` (doc_id, label) outside the held-out fold."""
    idf = inverse_frequencies(docs)
    sample = labelled_sample(docs, labels, label, sample_rows)
    x = np.zeros((len(sample), TERMS))
    for k, (_, at, v) in enumerate(sample):
        v = v * idf[at]
        x[k, at] = v / (np.sqrt(v @ v) or 1.0)
    axes = latent_axes(x, rank) if len(sample) else np.zeros((TERMS, 0))
    model = Model(idf, axes, np.zeros((0, axes.shape[1])), np.array([y for y, _, _ in sample], np.float64))
    model.vectors = model.project([(at, v) for _, at, v in sample])
    return model


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted"), threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus score and 0/1 prediction, under names that
    ``docs`` does not have.  The model's vectors are bounded by the sample."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            score = held.value.scores(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*b.schema.names, *names]
            )

    added = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Only the documents that are predicted as good; columns stay as they are."""
    score, told = fresh(docs, "score"), fresh(docs, "predicted")
    return predict(docs, fit(docs, labels, label), (score, told)).where(F.col(told) == 1).select(*docs.columns)


@register("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
