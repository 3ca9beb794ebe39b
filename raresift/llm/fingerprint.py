"""Improbable-feature digests of documents.

Every window of ``WINDOW`` bytes is a feature.  Its entropy falls into one of
``CODES`` classes; the classes are ranked by how rare they are among *all*
windows of the corpus (one counting pass), so a low rank is an improbable
feature.  In every run of ``SPAN`` neighbouring features the first one of the
lowest rank gets a point; features with ``POINTS`` points are selected, hashed
and inserted, in text order, into a chain of Bloom filters of ``BITS`` bits that
take ``FEATURES`` features each.  Two digests are compared by the overlap of
their filters beyond chance, scaled to 0..1: each filter of the digest with
fewer filters against the best of the other, weighted by its set bits.

The next document of each document (descending id) is found without a global
sort in one task: ids are cut into ranges, the first document of each range is
sent to the range before it as well, and every task reads its ranges in order,
holding two texts at a time.  Texts are shuffled once.

Defined results: null is the empty text; a text without a selected feature
(short or of one repeated character) has one feature, the whole text; so equal
texts have equal fingerprints and two empty texts are alike (1.0); documents
with equal ids follow each other in text order, null ids come last; the only
document of a table is its own next one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.llm.catalog import register
from raresift.llm.common import read, shuffle_partitions

WINDOW = 32
SPAN = 32
POINTS = 8
CODES = 1000
#: classes below this entropy say nothing (runs of one or two characters)
LEAST_CODE = 100
BITS = 2048
FEATURES = 160
HASHES = 5
BLOCK = 1 << 17

_LOG = np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)])
#: change of sum(c * log2 c) when a count goes from c to c + 1, in millionths
_STEP = np.round((_LOG[1:] - _LOG[:-1]) * 1e6).astype(np.int64)


def entropy_codes(b: np.ndarray) -> np.ndarray:
    """Entropy class of every window of a byte array (windows by start)."""
    n = len(b)
    if n < WINDOW:
        return np.empty(0, np.int64)
    before = np.zeros(n, np.uint8)  # equal bytes among the WINDOW-1 before
    after = np.zeros(n, np.uint8)  # and among the WINDOW-1 after
    for lag in range(1, WINDOW):
        same = (b[lag:] == b[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    gain = _STEP[before]
    gain[WINDOW:] -= _STEP[after[: n - WINDOW]]
    total = np.cumsum(gain)[WINDOW - 1 :]
    code = CODES - (total * CODES) // int(_LOG[WINDOW] * 1e6 + 0.5)
    return np.clip(code, 0, CODES)


def blocks(texts: list[bytes]):
    """Texts in blocks: (indices, joined bytes, starts)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t)
        if size >= BLOCK:
            yield group
            group, size = [], 0
    if group:
        yield group


def code_arrays(texts: list[bytes]) -> list[np.ndarray]:
    """Entropy classes of every text's windows."""
    out: list[np.ndarray] = []
    for group in blocks(texts):
        joined = np.frombuffer(b"".join([texts[i] for i in group]), np.uint8)
        codes, at = entropy_codes(joined), 0
        for i in group:
            n = len(texts[i])
            out.append(codes[at : at + max(0, n - WINDOW + 1)])
            at += n
    return out


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of every entropy class, 0 for the rarest, over all windows of all
    texts; classes below ``LEAST_CODE`` are never selected (-1)."""

    def run(batches):
        n = np.zeros(CODES + 1, np.int64)
        for b in batches:
            for codes in code_arrays([(t or "").encode() for t in b.column(0).to_pylist()]):
                n += np.bincount(codes, minlength=CODES + 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["code", "n"])

    counted = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CODES + 1, np.int64)
    for r in counted:
        n[r[0]] = r[1]
    rank = np.empty(CODES + 1, np.int64)
    rank[np.lexsort((np.arange(CODES + 1), n))] = np.arange(CODES + 1)
    rank[:LEAST_CODE] = -1
    return rank


def select_features(codes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of the selected windows."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.int64)
    r = rank[codes]
    worst = np.int64(1 << 20)
    key = (np.where(r < 0, worst, r) << 40) | np.arange(n)
    reach = 1
    low = key
    while reach < SPAN and len(low) > 1:  # minima of runs of doubling length
        step = min(reach, SPAN - reach, len(low) - 1)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    full = n >= SPAN
    at = (low if full else low[:1]) & ((1 << 40) - 1)
    points = np.bincount(at, minlength=n)
    chosen = np.flatnonzero(points >= (POINTS if full else 1))
    return chosen[r[chosen] >= 0]


def feature_hashes(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows, first occurrences in text order."""
    windows = np.lib.stride_tricks.sliding_window_view(b, WINDOW)[starts]
    words = np.ascontiguousarray(windows).view("<u8")
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def digest(text: bytes, codes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Chained Bloom filters of a text: (filters, BITS / 8) bytes."""
    starts = select_features(codes, rank)
    if len(starts):
        h = feature_hashes(np.frombuffer(text, np.uint8), starts)
    else:
        h = np.array([int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")], np.uint64)
    filters = np.zeros((-(-len(h) // FEATURES), BITS), bool)
    row = np.arange(len(h)) // FEATURES
    for j in range(HASHES):
        filters[row, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(filters, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap of two digests, 0 to 1."""
    if len(a) > len(b):
        a, b = b, a
    set_a = np.bitwise_count(a).sum(1, dtype=np.int64)
    set_b = np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(1, dtype=np.int64)
        chance = set_a[i] * set_b / BITS
        room = np.minimum(set_a[i], set_b) - chance
        total += set_a[i] * float(np.clip(np.where(room > 0, (both - chance) / np.where(room > 0, room, 1), 1.0), 0, 1).max())
    return min(1.0, total / float(set_a.sum()))


def as_text(d: np.ndarray) -> str:
    return f"{len(d)}:" + base64.b64encode(d.tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the next one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_id_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, _range, _tail: sorted runs of whole id ranges per
    partition, each range followed by the first document of the next one."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    cuts = min(4 * parts, 10_000)
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / cuts for i in range(1, cuts)]
    found = src.select(F.percentile_approx("doc_id", shares, 10 * cuts)).first()[0] or []
    splits = [-float("inf"), *sorted({float(x) for x in found}), float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="_id", outputCol="_r", handleInvalid="keep")
    ranged = ranges.transform(src.withColumn("_id", F.col("doc_id").cast("double")))
    ranged = ranged.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_r").cast("int"))).drop("_id", "_r")
    # one row per range: its largest id, and the range that it follows
    tops = sorted((r[0], r[1]) for r in ranged.groupBy("_range").agg(F.max("doc_id")).collect())
    above = {tops[i][0]: tops[(i + 1) % len(tops)][0] for i in range(len(tops))}
    heads = spark.createDataFrame([(top, above[r]) for r, top in tops], f"_top {src.schema['doc_id'].dataType.simpleString()}, _above int")
    tails = ranged.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_top"))).select("doc_id", "text", F.col("_above").alias("_range"), F.lit(1).alias("_tail"))
    rows = ranged.select("doc_id", "text", "_range", F.lit(0).alias("_tail")).unionByName(tails)
    return rows.repartition(parts, "_range").sortWithinPartitions(
        F.col("_range").desc(), "_tail", F.col("doc_id").desc_nulls_last(), "text"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text; see the module text."""
    rank = rarity(docs)

    def run(batches):
        held = None  # (doc_id, text, digest) that waits for its next document
        skip = None
        for b in batches:
            out = []
            ids, texts, ranges, tails = (c.to_pylist() for c in b.columns)
            raw = [t.encode() for t in texts]
            digests = [digest(t, c, rank) for t, c in zip(raw, code_arrays(raw))]
            pairs = []
            for doc, text, d, r, tail in zip(ids, texts, digests, ranges, tails):
                if r == skip:  # further rows with the id of the range's tail
                    continue
                if held is not None:
                    pairs.append((*held, edited(held[1], text), d))
                held = (doc, text, d)
                if tail:
                    held, skip = None, r
            changed = [p[3].encode() for p in pairs]
            for (doc, text, d, e, nxt), raw_e, codes in zip(pairs, changed, code_arrays(changed)):
                de = digest(raw_e, codes, rank)
                out.append((doc, len(text), hashlib.sha256(raw_e).hexdigest(), as_text(d), as_text(de), likeness(d, de), likeness(d, nxt)))
            cols = list(zip(*out)) or [()] * 7
            types = [b.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if docs.limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], schema)
    return in_id_order(docs).mapInArrow(run, schema)


@register("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole documents and of their edited texts."""
    return fingerprints(read(spark, sf_dir, "documents"))
