"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Features: the letters of a lower-cased text with every run of other characters
as one space; all 1-, 2- and 3-grams, hashed into ``BUCKETS`` places; weight
``log(1 + count) * idf``, scaled to length one.  The document frequencies come
from *all* training documents (one pass, summed by bucket).  The classifier is
trained with follow-the-regularised-leader under elastic-net penalties on a
sample of about ``SAMPLE_ROWS`` training documents, the same number per
language (a fixed hash draws each row by itself, so the number varies a little;
twice ``SAMPLE_ROWS`` is the documented bound), and a temperature fitted on a
fifth of that sample calibrates the probabilities.

Only text and non-null labels of documents outside the held-out fold are
learned from; a prediction uses the text alone.  Scoring is one map-only pass
over whole texts with the weights (buckets x languages) in the function.

Defined results: ``und`` with score 0 for a null text, one without letters, or
when nothing could be learned; ties between languages go to the smaller name;
repeated rows give equal rows; other columns are passed through untouched, and
clashing names get an underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift.llm.catalog import register
from raresift.llm.common import crc_text, fresh, read

BUCKETS = 1 << 15
SAMPLE_ROWS = 4000
FOLDS = 5
UNDETERMINED = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter (built once per worker)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text; both empty without letters."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[c]
    if not is_letter.any():
        return none
    c = np.where(is_letter, c, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of a run of other characters the first stays
    c = np.concatenate(([np.uint32(32)], c[keep], [np.uint32(32)])).astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] + np.uint32(0x9E37))) * np.uint32(2246822519)
    three = (two[:-1] ^ (c[2:] + np.uint32(0x85EB))) * np.uint32(3266489917)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    h = np.concatenate((one[1:-1] >> shift, two >> shift, three >> shift))
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_text(doc_id), F.lit(FOLDS)) == 0


class Model:
    """Weights (buckets x languages), idf and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * self.idf[at]
        size = np.sqrt(v @ v)
        return (v / size if size else v) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = ngram_counts(text)
        if not len(at) or not self.languages:
            return UNDETERMINED, 0.0
        z = self.logits(at, n) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train_ftrl(rows, languages, idf, alpha=2.0, beta=1.0, l1=0.002, l2=0.002, passes=4, seed=7):
    """FTRL-proximal over ``rows`` of (label, buckets, counts), elastic net."""
    k = len(languages)
    place = {x: i for i, x in enumerate(languages)}
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    bias = np.zeros(k)
    order = np.random.default_rng(seed)
    data = []
    for label, at, c in rows:
        v = np.log1p(c) * idf[at]
        size = np.sqrt(v @ v)
        data.append((place[label], at, v / size if size else v))

    def current(zz, nn):
        return -np.sign(zz) * np.maximum(np.abs(zz) - l1, 0) / ((beta + np.sqrt(nn)) / alpha + l2)

    for _ in range(passes):
        for i in order.permutation(len(data)):
            y, at, v = data[i]
            zz, nn = z[at], n[at]
            w = current(zz, nn)
            s = v @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            g2 = nn + g * g
            z[at] = zz + g - (np.sqrt(g2) - np.sqrt(nn)) / alpha * w
            n[at] = g2
            bias -= 0.01 * p
    return current(z, n), bias


def fit_temperature(scores: list[np.ndarray], labels: list[int]) -> float:
    """Temperature with the smallest log loss (golden section on its logarithm)."""
    if not scores:
        return 1.0
    s, y = np.array(scores), np.array(labels)
    n, k = s.shape
    # targets keep one (n + 2)th part for the other languages, so that a
    # sample without an error does not make every probability 1
    target = np.full((n, k), 1.0 / (n + 2) / max(1, k - 1))
    target[np.arange(n), y] = 1 - 1.0 / (n + 2)

    def loss(x):
        z = s / np.exp(x)
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - (target * z).sum(1)))

    lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``text`` and non-null ``lang`` outside the held-out fold."""
    docs = docs.select("doc_id", "text", "lang")
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches):
        df, rows = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                df[ngram_counts(text)[0]] += 1
                rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], rows), pa.int64())], names=["bucket", "n"]
        )

    counted = train.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = {r[0]: r[1] for r in counted.collect()}  # at most one row per bucket
    n = df.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(1 + n) + 1)
    if df:
        idf[list(df)] = np.log((1 + n) / (1 + np.array(list(df.values())))) + 1

    per_lang = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(per_lang)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    share = sample_rows / len(languages)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for lang, count in per_lang.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < share / count))
    picked = train.where(wanted).limit(2 * sample_rows)

    def features(batches):
        for b in batches:
            got = [ngram_counts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()),
                    pa.array([c.astype("<i4").tobytes() for _, c in got], pa.binary()),
                ],
                names=["lang", "at", "n"],
            )

    sample = picked.select("lang", "text").mapInArrow(features, "lang string, at binary, n binary").collect()
    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in sample if r["at"])
    rows = [(x, np.frombuffer(a, "<i4"), np.frombuffer(c, "<i4")) for x, a, c in rows]
    kept = [r for i, r in enumerate(rows) if i % 5]
    weights, bias = train_ftrl(kept, languages, idf)
    model = Model(languages, idf, weights, bias)
    aside = [r for i, r in enumerate(rows) if i % 5 == 0]
    model.temperature = fit_temperature([model.logits(a, c) for _, a, c in aside], [languages.index(x) for x, _, _ in aside])
    return model


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs`` plus the predicted language and its score, under
    names that ``docs`` does not have."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = held.value
        for b in batches:
            got = [m.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                names=[*b.schema.names, *names],
            )

    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added))


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Drop the documents whose language cannot be told (``und`` or a
    calibrated probability below ``min_score``); columns stay as they are."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    out = predict(docs, fit(docs), (lang, score))
    return out.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).select(*docs.columns)


@register("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = read(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
