"""Repeated-passage removal by a column-wise suffix order of aligned texts.

A byte goes when a string of ``LENGTH`` bytes that covers it starts anywhere else
as well (any document, overlaps included).

1. Anchors.  Every window of ``LENGTH`` bytes names as its anchor the leftmost of
   its ``GRAM``-byte strings with the least hash.  Equal windows have equal
   anchors at the same place, so only windows of equal anchors can be equal.
   One pass counts the anchors; those that occur once are done with.
2. Contexts.  A second pass sends, for each anchor that occurs again (tested
   by a filter of fixed size, so with harmless false alarms), the bytes of the
   windows that it anchors.  Equal contexts are one row per map task.
3. Suffix order.  The distinct contexts of an anchor are aligned at it and read
   column by column from the right: each round inserts one symbol per context,
   re-sorts the collection stably by that symbol (the columns read so far are
   its Burrows-Wheeler order) and updates the common prefixes of neighbours by
   range minima.  As equal windows stand in the same column, a window is
   repeated if and only if its common prefix with a neighbour reaches
   ``LENGTH``, or its whole context occurs twice.  Groups run through a task
   in the order of Spark's sorted shuffle files; a round costs one sort of the
   collection at hand.
   An anchor with more than ``COLLECTION`` occurrences (the border of a passage
   that very many documents share) is salted, not gathered in one task: its
   windows are counted one by one, by a 128-bit hash of their bytes, in a partial
   aggregate.  That is another method for the hottest anchors; the result is
   the same.
4. Removal.  The spans meet their documents again in one join.

Building the suffix order of the whole corpus column by column would take as
many rounds over all of it as the longest document has bytes; the anchors
bound the rounds by twice ``LENGTH`` and the collections to bytes that may repeat,
with the same result.

Defined results: null is the empty text; texts shorter than ``LENGTH`` keep all;
equal rows are copies of each other (two rows of the same long text lose all of it);
null and repeated ids are allowed, a row is told by its id and text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.llm.catalog import register
from raresift.llm.common import fresh, materialize, read, shuffle_partitions, slices

LENGTH = 200
GRAM = 32
PIECE = 1 << 20
FILTER_BITS = 1 << 26
FILTER_CHUNK = 1 << 20
COLLECTION = 1 << 14
CONTEXT_BYTES = 8 << 20

_M = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hash of every GRAM-byte string (GRAM is a power of two)."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _M
    h ^= h >> np.uint64(29)
    size = 1
    while size < GRAM:
        left, right = h[:-size], h[size:]
        h = (left ^ (right >> np.uint64(7)) ^ (right << np.uint64(57))) * (_M + np.uint64(2 * size))
        h ^= h >> np.uint64(31)
        size *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def anchors(b: np.ndarray, length: int = LENGTH):
    """Runs of windows with one anchor: (key, anchor place, first, last start)."""
    keys, places, firsts, lasts = [], [], [], []
    for at in range(0, max(0, len(b) - length + 1), PIECE):
        part = b[at : at + PIECE + length - 1]
        h = gram_hashes(part)
        # least hash, leftmost on ties: the place fills the low bits
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        reach, width = 1, length - GRAM + 1
        while reach < width:
            step = min(reach, width - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        place = (low & _LOW).astype(np.int64)
        start = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        keys.append(h[place[start]])
        places.append(place[start] + at)
        firsts.append(start + at)
        lasts.append(np.concatenate((start[1:], [len(place)])) - 1 + at)
    if not keys:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in (keys, places, firsts, lasts))


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def repeated_anchor_filter(docs: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the hashes of all anchors that occur more than once, and of those
    that occur more than ``COLLECTION`` times."""
    most = COLLECTION

    def run(batches):
        for b in batches:
            found = [anchors(_bytes(t), length)[0] for part in slices(b) for t in part.column(0).to_pylist()]
            keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    again = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    bit = F.pmod("key", F.lit(FILTER_BITS))
    dealt = again.select((bit / FILTER_CHUNK).cast("int").alias("chunk"), (bit % FILTER_CHUNK).cast("int").alias("bit"), (F.col("n") > most).alias("hot"))

    def bits(batches):
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, bit, hot = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for c in np.unique(chunk).tolist():
                own = chunks.setdefault(c, np.zeros((2, FILTER_CHUNK), bool))
                own[0, bit[chunk == c]] = True
                own[1, bit[(chunk == c) & hot]] = True
        packed = [[np.packbits(y, bitorder="little").tobytes() if y.any() else None for y in x] for x in chunks.values()]
        cols = [pa.array([x[k] for x in packed], pa.binary()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), *cols], names=["chunk", "bits", "hot"])

    out = np.zeros((2, FILTER_BITS // 8), np.uint8)
    size = FILTER_CHUNK // 8
    parts = FILTER_BITS // FILTER_CHUNK
    for r in dealt.repartition(parts, "chunk").mapInArrow(bits, "chunk int, bits binary, hot binary").collect():
        for k in range(2):
            if r[1 + k] is not None:
                out[k, r[0] * size : (r[0] + 1) * size] |= np.frombuffer(r[1 + k], np.uint8)
    return out[0], out[1]


def contexts(docs: DataFrame, held, length: int, hot=None) -> DataFrame:
    """Rows (key, salt, lead, context, ids, marks, starts): the bytes of all
    windows of an anchor in the filter ``held``, and the documents and places
    where these very bytes stand.  Anchors in the filter ``hot`` are salted by
    their bytes; 0 is the salt of all others."""
    spread = shuffle_partitions(docs.sparkSession)

    def in_filter(bits, keys):
        spot = (keys & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1

    def flushed(got, kind):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in got], pa.int64()),
                pa.array([k[1] and 1 + zlib.crc32(k[3]) % spread for k in got], pa.int32()),
                pa.array([k[2] for k in got], pa.int32()),
                pa.array([k[3] for k in got], pa.binary()),
                pa.array([v[0] for v in got.values()], pa.list_(kind)),
                pa.array([v[1] for v in got.values()], pa.list_(pa.int64())),
                pa.array([v[2] for v in got.values()], pa.list_(pa.int32())),
            ],
            names=["key", "salt", "lead", "context", "ids", "marks", "starts"],
        )

    def run(batches):
        for b in batches:
            kind, got, size = b.column(0).type, {}, 0
            for part in slices(b):
                for doc, mark, text in zip(*(c.to_pylist() for c in part.columns)):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    keys, places, firsts, lasts = anchors(np.frombuffer(raw, np.uint8), length)
                    hit = np.flatnonzero(in_filter(held.value, keys))
                    many = in_filter(hot.value, keys[hit]) if hot else np.zeros(len(hit), np.int8)
                    for key, is_hot, place, first, last in zip(keys.view(np.int64)[hit].tolist(), many.tolist(), *(x[hit].tolist() for x in (places, firsts, lasts))):
                        name = (key, is_hot, place - first, raw[first : last + length])
                        row = got.get(name)
                        if row is None:
                            row = got[name] = ([], [], [])
                            size += last + length - first
                        row[0].append(doc)
                        row[1].append(mark)
                        row[2].append(first)
                    if size > CONTEXT_BYTES:
                        yield flushed(got, kind)
                        got, size = {}, 0
            if got:
                yield flushed(got, kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key long, salt int, lead int, context binary, ids array<{kind}>, marks array<long>, starts array<int>"
    return docs.select("doc_id", "mark", "text").mapInArrow(run, schema)


def window_rows(t: pa.Table, length: int):
    """(h1, h2, n, doc_id, mark, start, stop) from context rows of hot anchors:
    each window by the hash of its bytes, with its number of occurrences in the
    row (two stand for more) and the place of the first; null hashes mark a whole
    context that occurs again in its row."""
    from xxhash import xxh3_128_digest as digest

    for text, ids, marks, starts in zip(*(t.column(k).to_pylist() for k in ("context", "ids", "marks", "starts"))):
        h = np.frombuffer(b"".join(digest(text[i : i + length]) for i in range(len(text) - length + 1)), "<i8").reshape(-1, 2)
        again = len(ids) if len(ids) > 1 else 0
        at = np.arange(len(h), dtype=np.int32) + starts[0]
        stops = np.concatenate((at + length, np.array(starts[:again], np.int32) + len(text)))
        none = [None] * again
        yield [
            pa.array(h[:, 0].tolist() + none, pa.int64()),
            pa.array(h[:, 1].tolist() + none, pa.int64()),
            pa.array([min(2, len(ids))] * len(h) + none, pa.int64()),
            pa.array(ids[:1] * len(h) + ids[:again], t.schema.field("ids").type.value_type),
            pa.array(marks[:1] * len(h) + marks[:again], pa.int64()),
            pa.array(np.concatenate((at, np.array(starts[:again], np.int32))), pa.int32()),
            pa.array(stops, pa.int32()),
        ]


def range_min(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Minimum of values[a..z] (both ends included) for each pair."""
    out = values[z].copy()
    wide = np.flatnonzero(z > a)
    if not len(wide):
        return out
    span = z[wide] - a[wide] + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    table, size = values, 1
    for k in range(int(level.max()) + 1):
        at = wide[level == k]
        if len(at):
            out[at] = np.minimum(table[a[at]], table[z[at] - size + 1])
        if k < level.max():
            table = np.minimum(table[:-size], table[size:])
            size *= 2
    return out


def repeated_windows(group: np.ndarray, lead: np.ndarray, texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows equal a window of another context
    of its group; contexts are distinct and aligned by ``lead``."""
    m = len(texts)
    size = np.array([len(t) for t in texts])
    begin = int(lead.max()) - lead  # first column of each context
    columns = int((begin + size).max())
    table = np.full((columns, m), 256, np.uint16)  # a column is a row here
    for i, t in enumerate(texts):
        table[begin[i] : begin[i] + size[i], i] = np.frombuffer(t, np.uint8)
    hits = np.zeros((columns, m), bool)
    number = np.unique(group, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(number, kind="stable")
    common = np.zeros(m, np.int32)  # with the neighbour before, in this order
    base = number * 512
    for col in range(columns - 1, -1, -1):
        symbol = base[order] + table[col, order]
        turn = np.argsort(symbol, kind="stable")
        symbol = symbol[turn]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] & 511 < 256)) + 1
        fresh = np.zeros(m, np.int32)
        fresh[same] = 1 + range_min(common, turn[same - 1] + 1, turn[same]) if len(same) else 0
        order, common = order[turn], fresh
        long = np.flatnonzero(common >= length)
        hits[col, order[long]] = True
        hits[col, order[long - 1]] = True
    return [hits[begin[i] : begin[i] + size[i] - length + 1, i] for i in range(m)]


def _runs(hit: np.ndarray):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return zip(edge[::2].tolist(), edge[1::2].tolist())


def solve(t: pa.Table, length: int) -> list[pa.Array]:
    """doc_id, mark, start and stop of the repeated spans of whole groups."""
    size = pc.binary_length(t.column("context")).to_numpy().astype(np.int64)
    number = pc.list_value_length(t.column("starts")).to_numpy().astype(np.int64)
    names: dict[tuple, int] = {}
    rows = zip(t.column("key").to_pylist(), t.column("lead").to_pylist(), t.column("context").to_pylist())
    own = np.array([names.setdefault(x, len(names)) for x in rows], np.int64)
    total = np.bincount(own, number, len(names))
    ids, marks, starts = (t.column(c).combine_chunks().flatten() for c in ("ids", "marks", "starts"))
    first = starts.to_numpy().astype(np.int64)
    # a context that occurs again goes whole
    of = np.repeat(np.arange(len(own)), number)
    take, begin, end = [np.flatnonzero(total[own[of]] > 1)], [], []
    begin.append(first[take[0]])
    end.append(begin[0] + size[of[take[0]]])
    # the others of a group with several: windows shared with another context
    key = np.array([k for k, _, _ in names], np.int64)
    group, per_group = np.unique(key, return_inverse=True, return_counts=True)[1:]
    several = np.flatnonzero(per_group[group] > 1)
    if len(several):
        lead, text = [x[1] for x in names], [x[2] for x in names]
        found = repeated_windows(group[several], np.array([lead[c] for c in several]), [text[c] for c in several], length)
        at = np.empty(len(names), np.int64)  # where the (only) occurrence stands
        at[own] = np.cumsum(number) - number
        spot, a, z = [], [], []
        for c, hit in zip(several.tolist(), found):
            if total[c] == 1 and hit.any():
                for x, y in _runs(hit):
                    spot.append(at[c]), a.append(x), z.append(y)
        spot = np.array(spot, np.int64)
        take.append(spot)
        begin.append(first[spot] + np.array(a, np.int64))
        end.append(first[spot] + np.array(z, np.int64) + length - 1)
    where = pa.array(np.concatenate(take))
    return [ids.take(where), marks.take(where), pa.array(np.concatenate(begin), pa.int32()), pa.array(np.concatenate(end), pa.int32())]


_FOUND = ["h1", "h2", "n", "doc_id", "mark", "start", "stop"]


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """From context rows: spans of removed bytes (null n) of the anchors that are
    gathered, and the windows of the salted ones."""
    kind = rows.schema["ids"].dataType.elementType.simpleString()

    def spans(t: pa.Table):
        cols = solve(t, length)
        none = pa.nulls(len(cols[0]), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, *cols], names=_FOUND)

    def run(batches):
        held, n = [], 0  # whole groups of cold anchors, then the last one, open
        for b in batches:
            t = pa.Table.from_batches([b])
            salt = t.column("salt").to_numpy()
            for cols in window_rows(t.filter(pa.array(salt != 0)), length) if salt.any() else ():
                yield pa.RecordBatch.from_arrays(cols, names=_FOUND)
            t = t.filter(pa.array(salt == 0))
            if not len(t):
                continue
            held.append(t)
            n += len(t)
            if n >= COLLECTION:
                t = pa.concat_tables(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # sorted: the open group starts here
                if cut:
                    yield spans(t.slice(0, cut))
                held, n = [t.slice(cut)], len(t) - cut
        if n:
            yield spans(pa.concat_tables(held))
        pa.default_memory_pool().release_unused()

    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(parts, "key", "salt").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"h1 long, h2 long, n long, doc_id {kind}, mark long, start int, stop int")


def with_windows(found: DataFrame) -> DataFrame:
    """The spans, and of the windows those that occur again anywhere."""
    span = ["doc_id", "mark", "start", "stop"]
    again = found.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    single = found.where("n IS NOT NULL").join(again, ["h1", "h2"], "left_semi")
    return found.where("h1 IS NULL").select(*span).unionByName(single.select(*span))


def merge_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union of (start, stop) spans."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def removed_spans(docs: DataFrame, length: int = LENGTH, name: str = "spans") -> DataFrame:
    """Every column of ``docs`` plus ``name``: array of (start, stop) byte
    offsets of removed spans, unmerged (null where nothing goes)."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    several, many = repeated_anchor_filter(own, length)
    held = spark.sparkContext.broadcast(several)
    hot = spark.sparkContext.broadcast(many) if many.any() else None
    spans = repeated_spans(contexts(own, held, length, hot), length)
    # with hot anchors the spans are used twice: counted, then picked
    spans = with_windows(materialize(spans)) if hot else spans.select("doc_id", "mark", "start", "stop")
    doc, mark, own_mark = fresh(docs, "_doc"), fresh(docs, "_mark"), fresh(docs, "_own_mark")
    by_doc = spans.groupBy(F.col("doc_id").alias(doc), F.col("mark").alias(mark)).agg(F.collect_list(F.struct("start", "stop")).alias(name))
    marked = docs.withColumn(own_mark, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(F.col(doc)) & (F.col(own_mark) == F.col(mark))
    return marked.join(by_doc, same, "left").select(*docs.columns, name)


def kept_bytes(raw: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    runs = merge_spans([(s["start"], s["stop"]) for s in spans or []])
    parts, at = [], 0
    for a, z in runs:
        parts.append(raw[at:a])
        at = z
    parts.append(raw[at:])
    return b"".join(parts), runs


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated passages cut out of ``text`` and
    ``n_chars`` (where there is one) brought up to date.  Bytes of a character
    that a cut has split go with it."""

    columns = docs.columns

    def run(batches):
        for b in batches:
            texts = []
            for t, spans in zip(b.column(columns.index("text")).to_pylist(), b.column(len(columns)).to_pylist()):
                texts.append(t if not spans else kept_bytes(t.encode("utf-8", "surrogatepass"), spans)[0].decode("utf-8", "ignore"))
            out = dict(zip(columns, b.columns))
            out["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    cut = removed_spans(docs, length, fresh(docs, "spans")).mapInArrow(run, docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else cut


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, runs = kept_bytes(raw, spans)
                out.append((doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [()] * 5
            types = [b.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs.select("doc_id", "text"), length).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


@register("op10_suffix")
def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that repeat."""
    return digests(read(spark, sf_dir, "documents"))
