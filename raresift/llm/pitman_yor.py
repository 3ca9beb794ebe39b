"""Language-model scoring with a hierarchical Pitman-Yor model of words.

Restaurants: the context of a token is the whole token before it (told by 48
bits of its hash; the text's beginning has its own), so there are as many context
restaurants as words; all of them share one parent, the restaurant of word types,
whose base is uniform over the ``V`` known types and one for everything unknown.  A customer that opens a table
in a context restaurant sends one customer to the parent.

Seating is sampled by blocked Gibbs sweeps: given all other tables, the
customers of a dish in a restaurant are seated anew one after another by the
Chinese-restaurant rule (in blocks of an eighth of those already seated; the
chance of a new table is fixed inside a block).  A sweep sees the table totals
of the one before.  Discounts follow from the counts of counts.  Predictive
probabilities are averaged over the last ``SAMPLES`` of ``SWEEPS`` sweeps.

On the cluster: words are dealt by hash into parts of about ``PART_BYTES`` of
text.  One pass over the texts makes, per batch and part, a packed list of (word,
document, context, count), once for the counts and once for the scores.  What restaurants
know of a word is in its part; its counts are folded from one list at a time.
Tokens and tables of a context are summed on the cluster: every part sends those
of its contexts to where the context's hash is dealt and gets back the sums over
all parts.  Only totals (words, tokens, tables, counts of counts) meet on the
driver, a fixed number per part.  The seats of a part are written after each
sweep, which seats once more from them with a fixed seed, so a lost task repeats
the same draws.  Scores are summed per document and part, then per document.
Counts, words and documents are never sampled or cut.

Defined results: a null or empty text is one end token; unknown words share
the unknown type; repeated rows count as often as they occur; with an empty
training set every probability is the base (1 / (V + 1), V = 0).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.llm.catalog import register
from raresift.llm.common import crc_text, materialize, read, release, shuffle_partitions

#: least places of a part's vectors over contexts (those past its contexts are
#: empty restaurants); the contexts themselves are not limited
CONTEXTS = 256
#: contexts are told by the upper 48 bits of their hash
CONTEXT_SHIFT = np.uint64(16)
SWEEPS, SAMPLES = 4, 3
STRENGTH = 1.0
FOLDS, HELD_OUT = 7, 2
#: text of a part; parts grow in number with the corpus, not in size
PART_BYTES = 32 << 20
LEAST_PARTS = 12
#: entries that wait before they are folded into a part's counts
FOLD = 500_000
#: partial scores travel as whole numbers of this size
UNIT = 1e-9
BATCH_BYTES = 24 << 20
BATCH_DOCS = 60_000


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(crc_text(doc_id), F.lit(FOLDS)) == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered (the end token is added by the caller)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side (they compress better)."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(raw, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).view(kind).ravel()


def gaps(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their differences."""
    return planes(np.diff(ascending, prepend=np.uint64(0)).astype("<u8"))


def from_gaps(raw, n: int, at: int) -> np.ndarray:
    return np.cumsum(from_planes(raw, "<u8", n, at), dtype=np.uint64)


def pack_batch(texts, train, parts: int):
    """Packed rows (part, blob) of a batch, and the token count of each text."""
    from xxhash import xxh3_64_intdigest as digest

    local: dict = {None: 0}  # the end token
    known = local.setdefault
    flat: list[int] = []
    size = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = tokens(t)
        size[i] = len(words) + 1
        flat += [known(w, len(local)) for w in words]
        flat.append(0)
    token = np.array(flat, np.int64)
    del flat
    doc = np.repeat(np.arange(len(texts)), size)
    h = np.fromiter((0 if w is None else digest(w) or 1 for w in local), np.uint64, len(local))
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((h, part))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    before = np.full(len(token), rank[0])
    before[1:] = rank[token[:-1]]  # after an end token a text begins
    pair, at = np.unique((rank[token] << 32) | before, return_inverse=True)
    key, n = np.unique(at * len(texts) + doc, return_counts=True)
    pair, d = pair[key // len(texts)], key % len(texts)
    at, context = pair >> 32, pair & 0xFFFFFFFF
    pack = zstandard.ZstdCompressor(level=1).compress
    h, part = h[order], part[order]
    for p in np.unique(part[at]).tolist():
        lo, hi = np.searchsorted(part, [p, p + 1])
        a, z = np.searchsorted(at, [lo, hi])
        runs = np.bincount(at[a:z] - lo, minlength=hi - lo)
        own, g = np.unique(context[a:z], return_inverse=True)
        keys, to = np.unique(h[own] >> CONTEXT_SHIFT, return_inverse=True)
        g = to[g]
        steps = np.diff(g, prepend=0) % len(keys)  # mostly ascending inside a word
        head = np.array([hi - lo, z - a, len(texts), len(keys)], "<i8").tobytes()
        rest = (runs.astype("<u4"), n[a:z].astype("<u4"), d[a:z].astype("<u2"), train.astype(np.uint8))
        body = b"".join((gaps(h[lo:hi]), gaps(keys), *(x.tobytes() for x in rest), planes(steps.astype("<u4"))))
        yield p, pack(head + body), size


def unpack(blob: bytes):
    """(hashes, hashes of contexts, word of each entry, count, document, place of
    the context, train flags)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    words, entries, docs, contexts = np.frombuffer(raw, "<i8", 4).tolist()
    h, own = from_gaps(raw, words, 32), from_gaps(raw, contexts, 32 + 8 * words)
    at, out = 32 + 8 * (words + contexts), []
    for kind, n in (("<u4", words), ("<u4", entries), ("<u2", entries), ("u1", docs)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    runs, n, doc, train = out
    context = np.cumsum(from_planes(raw, "<u4", entries, at).astype(np.int64)) % contexts
    return h, own, np.repeat(np.arange(words), runs), n.astype(np.int64), doc.astype(np.int64), context, train.astype(bool)


def packed(docs: DataFrame, parts: int, heads: bool = False) -> DataFrame:
    """Rows (part, batch, ids, sizes, blob); with ``heads`` instead the rows (of
    part -1) that list ids, folds and sizes of the same batches."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        number = itertools.count()
        names = ["part", "batch", "ids", "held", "sizes", "blob"]

        def flush(ids, held, texts):
            batch = (TaskContext.get().partitionId() << 32) + next(number)
            if heads:
                cols = [[-1], [batch], [ids.to_pylist()], [held.tolist()], [[len(tokens(t)) + 1 for t in texts]], [None]]
            else:
                rows = list(pack_batch(texts, ~held, parts))
                none = [None] * len(rows)
                cols = [[p for p, _, _ in rows], [batch] * len(rows), none, none, none, [b for _, b, _ in rows]]
            kinds = [pa.int32(), pa.int64(), pa.list_(ids.type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        for b in batches:
            texts = b.column(2).to_pylist()
            held = b.column(1).to_numpy(zero_copy_only=False)
            start = used = 0
            for i, t in enumerate(texts):
                used += len(t or "")
                if used >= BATCH_BYTES or i + 1 - start >= BATCH_DOCS or i + 1 == len(texts):
                    yield from flush(b.column(0).slice(start, i + 1 - start), held[start : i + 1], texts[start : i + 1])
                    start, used = i + 1, 0

    src = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held"), "text")
    schema = f"part int, batch long, ids array<{kind.simpleString()}>, held array<boolean>, sizes array<long>, blob binary"
    return src.mapInArrow(run, schema)


class Counts:
    """What the restaurants of one part know: training counts by (word, context),
    and all contexts that its entries have, in training or not (``g`` is a place
    in ``contexts``)."""

    def __init__(self, blobs):
        held: list = []

        def fold():
            # entries are (word, context): unique over all batches so far
            nonlocal held
            h = np.concatenate([self.h] + [x[0] for x in held])
            c = np.concatenate([self.before] + [x[1] for x in held])
            n = np.concatenate([self.c] + [x[2] for x in held])
            order = np.lexsort((c, h))
            h, c, n = h[order], c[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))) if len(h) else np.empty(0, np.int64)
            self.h, self.before = h[first], c[first]
            self.c = np.add.reduceat(n, first) if len(first) else n
            self.contexts = np.unique(np.concatenate([self.contexts] + [x[3] for x in held]))
            held = []

        self.h, self.before, self.c = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.contexts = np.empty(0, np.uint64)
        size = 0
        for blob in blobs:
            h, own, w, n, doc, context, train = unpack(blob)
            use = train[doc]
            # per batch, sum over documents first
            key, at = np.unique((w[use] << 32) | context[use], return_inverse=True)
            held.append((h[key >> 32], own[key & 0xFFFFFFFF], np.bincount(at, weights=n[use], minlength=len(key)).astype(np.int64), own))
            size += len(key) + len(own)
            if size > max(FOLD, len(self.c) // 2):  # so that all folds cost a few times the last
                fold()
                size = 0
        fold()
        self.words, self.w = np.unique(self.h, return_inverse=True)
        self.g = np.searchsorted(self.contexts, self.before)
        self.total = np.bincount(self.w, weights=self.c, minlength=len(self.words)).astype(np.int64)
        del self.h, self.before

    def pack(self) -> bytes:
        head = np.array([len(self.words), len(self.c), len(self.contexts)], "<i8").tobytes()
        runs = np.bincount(self.w, minlength=len(self.words))
        steps = np.diff(self.g, prepend=0) % max(1, len(self.contexts))
        cols = (gaps(self.words), gaps(self.contexts), planes(self.c.astype("<i8")), runs.astype("<u4").tobytes(), planes(steps.astype("<u4")))
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(cols))

    @classmethod
    def unpack(cls, blob: bytes) -> Counts:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        words, entries, contexts = np.frombuffer(raw, "<i8", 3).tolist()
        at = 24 + 8 * (words + contexts)
        out = [from_gaps(raw, words, 24), from_gaps(raw, contexts, 24 + 8 * words), from_planes(raw, "<i8", entries, at)]
        at += 8 * entries
        out.append(np.frombuffer(raw, "<u4", words, at))
        out.append(np.cumsum(from_planes(raw, "<u4", entries, at + 4 * words).astype(np.int64)) % max(1, contexts))
        c = cls.__new__(cls)
        c.words, c.contexts, c.c, runs, g = out
        c.w, c.g = np.repeat(np.arange(words), runs), g.astype(np.int64)
        c.total = np.bincount(c.w, weights=c.c, minlength=words).astype(np.int64)
        return c

    def dealt(self, parts: int):
        """Where contexts meet: their order by that, and (target, its slice)."""
        target = (self.contexts % np.uint64(parts)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        cut = np.searchsorted(target[order], np.arange(parts + 1))
        return order, [(q, slice(cut[q], cut[q + 1])) for q in range(parts) if cut[q] < cut[q + 1]]

    def summary(self) -> np.ndarray:
        """Tokens per context, entries per context, then: words, counts of counts
        1 and 2 for the entries and for the number of contexts of a word."""
        places = max(CONTEXTS, len(self.contexts))
        contexts = np.bincount(self.w, minlength=len(self.words))
        return np.concatenate(
            (
                np.bincount(self.g, weights=self.c, minlength=places),
                np.bincount(self.g, minlength=places),
                [len(self.words), (self.c == 1).sum(), (self.c == 2).sum(), (contexts == 1).sum(), (contexts == 2).sum()],
            )
        )


class Totals:
    """Corpus totals and the table totals after each sweep, per context."""

    def __init__(self, sums: np.ndarray):
        places = (len(sums) - 5) // 2
        self.tokens_in = sums[:places]
        self.n = float(self.tokens_in.sum())
        self.v, e1, e2, w1, w2 = sums[2 * places :]
        self.discount = min(0.95, max(0.05, e1 / (e1 + 2 * e2) if e1 else 0.5))
        self.parent_discount = min(0.95, max(0.05, w1 / (w1 + 2 * w2) if w1 else 0.5))
        self.base = 1.0 / (self.v + 1)
        # (tables per context, tables of the parent); first one table per entry
        self.history = [(sums[places : 2 * places], self.v)]

    @classmethod
    def of_part(cls, sums: list[np.ndarray], whole: list) -> Totals:
        """From the sums over all parts for the contexts of one part (tokens and
        entries, then tables after each sweep) and those of the whole corpus; the
        last place of each vector stands for the contexts of other parts."""
        wide = [np.append(x, n - x.sum()) for x, n in zip(sums[:2], whole[0][:2])]
        totals = cls(np.concatenate((*wide, whole[0][2:])))
        for x, (tables, parents) in zip(sums[2:], whole[1:]):
            totals.history.append((np.append(x, tables - x.sum()), parents))
        return totals


def crp_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of ``customers`` of one dish, seated one after another; ``weight``
    is the mass of a new table, (strength + discount * tables) * parent."""
    tables = np.ones(len(customers), np.int64)
    at = np.flatnonzero(customers > 1)
    n = np.ones(len(at), np.int64)
    while len(at):
        step = np.minimum(np.maximum(1, n // 8), customers[at] - n)
        a = weight[at]
        p = a / (n - discount * tables[at] + a)
        tables[at] += rng.binomial(step, np.clip(p, 0.0, 1.0))
        n += step
        more = customers[at] > n
        at, n = at[more], n[more]
    return tables


def seated(c: Counts, totals: Totals, t: np.ndarray, t0: np.ndarray, part: int, sweep: int, seed: int = 11):
    """Tables (of entries, of words) of one more sweep, given those before and
    the latest totals."""
    rng = np.random.default_rng([seed, part, sweep])
    tables, parents = totals.history[-1]
    p1 = parent_probability(c, totals, t, t0, tables, parents)
    t = crp_tables(c.c, (STRENGTH + totals.discount * tables[c.g]) * p1[c.w], totals.discount, rng)
    guests = np.bincount(c.w, weights=t, minlength=len(c.words)).astype(np.int64)
    mass = np.full(len(c.words), (STRENGTH + totals.parent_discount * parents) * totals.base)
    return t, crp_tables(guests, mass, totals.parent_discount, rng)


def first_seats(c: Counts):
    """One table per entry and word."""
    return np.ones(len(c.c), np.int64), np.ones(len(c.words), np.int64)


def pack_seats(t: np.ndarray, t0: np.ndarray) -> bytes:
    return pack_whole(np.concatenate((t, t0)))


def unpack_seats(blob: bytes, c: Counts):
    both = unpack_whole(blob)
    return both[: len(c.c)], both[len(c.c) :]


def parent_probability(c: Counts, totals: Totals, t, t0, tables, parents) -> np.ndarray:
    """Probability of every word of the part in the parent restaurant."""
    guests = np.bincount(c.w, weights=t, minlength=len(c.words))
    mass = (STRENGTH + totals.parent_discount * parents) * totals.base
    return (guests - totals.parent_discount * t0 + mass) / (STRENGTH + tables.sum())


class Predictor:
    """Averaged predictive probabilities of one part."""

    def __init__(self, c: Counts, totals: Totals, seats: list):
        """``seats`` of some sweeps; ``totals`` has the totals after each."""
        self.c, self.totals = c, totals
        self.key = (c.w.astype(np.int64) << 32) | c.g
        self.samples = []
        for (t, t0), (tables, parents) in zip(seats, totals.history[1:]):
            p1 = parent_probability(c, totals, t, t0, tables, parents)
            unknown = (STRENGTH + totals.parent_discount * parents) * totals.base / (STRENGTH + tables.sum())
            room = STRENGTH + totals.tokens_in
            own = (c.c - totals.discount * t) / room[c.g]
            rest = (STRENGTH + totals.discount * tables) / room
            self.samples.append((own, rest, np.append(p1, unknown)))

    def logs(self, h: np.ndarray, w: np.ndarray, context: np.ndarray):
        """(log10 probability, base log10, known) of packed entries."""
        c, totals = self.c, self.totals
        place = np.searchsorted(c.words, h)
        found = place < len(c.words)
        found[found] = c.words[place[found]] == h[found]
        place = np.where(found, place, len(c.words))[w]
        key = (place << 32) | context
        at = np.searchsorted(self.key, key)
        seen = at < len(self.key)
        seen[seen] = self.key[at[seen]] == key[seen]
        at = np.where(seen, at, 0)
        p = np.zeros(len(w))
        for own, rest, p1 in self.samples:
            p += rest[context] * p1[place]
            if len(own):
                p += np.where(seen, own[at], 0.0)
        p /= max(1, len(self.samples))
        count = np.append(c.total, 0)[place]
        return np.log10(p), np.log10((count + 1) / (totals.n + totals.v + 1)), count > 0


def pack_whole(whole: np.ndarray) -> bytes:
    """Whole numbers, bytes of equal weight side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(planes(np.ascontiguousarray(whole, "<i8")))


def unpack_whole(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return from_planes(raw, "<i8", len(raw) // 8, 0)


def pack_sums(sums: np.ndarray) -> bytes:
    """Partial scores, as whole numbers of ``UNIT``."""
    return pack_whole(np.round(sums / UNIT))


def unpack_sums(blob: bytes) -> np.ndarray:
    return unpack_whole(blob) * UNIT


OFFERS = "part int, target int, keys binary, own binary, parents long"


def offers(part: int, parts: int, c: Counts, values: np.ndarray, parents: int) -> pa.Table:
    """Rows of a part: its contexts by the target where they meet, with their
    values (one row of ``values`` after the other)."""
    order, cuts = c.dealt(parts)
    keys, values = c.contexts[order], values[:, order]
    n = len(cuts)
    return pa.table(
        {
            "part": pa.array([part] * n, pa.int32()),
            "target": pa.array([q for q, _ in cuts], pa.int32()),
            "keys": pa.array([zstandard.ZstdCompressor(level=1).compress(gaps(keys[x])) for _, x in cuts], pa.binary()),
            "own": pa.array([pack_whole(values[:, x].ravel()) for _, x in cuts], pa.binary()),
            "parents": pa.array([parents] + [0] * (n - 1), pa.int64()),
        }
    )


def _meet(table: pa.Table) -> pa.Table:
    """All offers of one target: for each, the sums over all parts."""
    raws = map(zstandard.ZstdDecompressor().decompress, table.column("keys").to_pylist())
    keys = [from_gaps(x, len(x) // 8, 0) for x in raws]
    own = [unpack_whole(x).reshape(-1, len(k)) for x, k in zip(table.column("own").to_pylist(), keys)]
    each, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.stack([np.bincount(at, weights=v, minlength=len(each)) for v in np.concatenate(own, 1)])
    cut = np.cumsum([0] + [len(k) for k in keys])
    told = [pack_whole(sums[:, at[a:z]].ravel()) for a, z in zip(cut[:-1], cut[1:])]
    return pa.table(
        {
            "part": table.column("part"),
            "target": table.column("target"),
            "sums": pa.array(told, pa.binary()),
            "tables": pa.array([int(x[-1].sum()) for x in own], pa.int64()),
            "parents": table.column("parents"),
        }
    )


def _told(c: Counts, parts: int, told: pa.Table) -> list[np.ndarray]:
    """Sums over all parts for the contexts of ``c``: tokens, entries, tables..."""
    rounds: dict[int, dict] = {}
    for r, q, blob in zip(*(told.column(x).to_pylist() for x in ("round", "target", "sums"))):
        rounds.setdefault(r, {})[q] = unpack_whole(blob)
    order, cuts = c.dealt(parts)
    out = []
    for r in sorted(rounds):
        rows = np.empty((2 if r == 0 else 1, len(order)))
        for q, x in cuts:
            rows[:, order[x]] = rounds[r][q].reshape(len(rows), -1)
        out += list(rows)
    return out


def _by_part(batches, use):
    """Feed the blobs of each part (rows are sorted by part) to ``use``, one at
    a time."""

    def rows():
        for b in batches:
            parts, blobs = b.column(0).to_pylist(), b.column(1)
            for i, part in enumerate(parts):
                yield part, blobs[i].as_py()

    for part, own in itertools.groupby(rows(), key=lambda r: r[0]):
        yield from use(part, (blob for _, blob in own))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // PART_BYTES))
    # the lists are packed for the counts and again for the scores, which is
    # cheaper than keeping them on disk in between
    blobs = packed(docs, parts).select("part", "batch", "blob")
    dealt = blobs.repartition(max(parts, shuffle_partitions(spark)), "part").sortWithinPartitions("part", "batch")

    def count(part, held):
        c = Counts(held)
        sums = c.summary()
        whole = [c.c.sum(), len(c.c), *sums[-5:]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([[float(x) for x in whole]], pa.list_(pa.float64())), pa.array([c.pack()], pa.binary())],
            names=["part", "whole", "counts"],
        )

    counted = materialize(dealt.select("part", "blob").mapInArrow(lambda batches: _by_part(batches, count), "part int, whole array<double>, counts binary"))
    # a fixed number of totals per part, summed on the driver
    sums = [np.array(r[0]) for r in counted.select("whole").collect()]
    whole = [np.sum(sums, axis=0) if sums else np.zeros(7)]

    def first(batches):
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = Counts.unpack(blob)
                k = len(c.contexts)
                values = np.stack((np.bincount(c.g, weights=c.c, minlength=k), np.bincount(c.g, minlength=k)))
                yield from offers(part, parts, c, values, 0).to_batches()

    def sweep(r, whole):
        """Left: a part's counts; right: its totals and (but for the first
        sweep) its seats.  Gives the new seats (target -1) and the offers."""

        def run(left, right):
            part, c = left.column("part")[0].as_py(), Counts.unpack(left.column("counts")[0].as_py())
            own = pc.equal(right.column("target"), -1)
            held = right.filter(own).column("sums").to_pylist()
            t, t0 = unpack_seats(held[0], c) if held else first_seats(c)
            t, t0 = seated(c, Totals.of_part(_told(c, parts, right.filter(pc.invert(own))), whole), t, t0, part, r)
            tables = np.bincount(c.g, weights=t, minlength=len(c.contexts))[None]
            given = offers(part, parts, c, tables, int(t0.sum()))
            new = [pa.array([part], pa.int32()), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.array([pack_seats(t, t0)], pa.binary()), pa.array([0], pa.int64())]
            return pa.concat_tables([pa.Table.from_arrays(new, schema=given.schema), given])

        return run

    counts = counted.select("part", "counts")
    told, seats = {}, {}
    for r in range(SWEEPS + 1 if sums else 0):
        if r == 0:
            own = counts.mapInArrow(first, OFFERS)
        else:
            before = told[0]
            if r > 1:
                before = before.unionByName(told[r - 1]).unionByName(seats[r - 1])
            totals = [whole[0]] if r == 1 else [whole[0], whole[r - 1]]
            own = materialize(counts.groupBy("part").cogroup(before.groupBy("part")).applyInArrow(sweep(r, totals), OFFERS))
            kept = materialize(own.where("target = -1").select("part", F.lit(r).alias("round"), "target", F.col("own").alias("sums")))
            seats[r], own = kept, own.where("target >= 0")
            del before, kept
        met = materialize(own.groupBy("target").applyInArrow(_meet, "part int, target int, sums binary, tables long, parents long"))
        if r:
            whole.append(tuple(float(x) for x in met.agg(F.sum("tables"), F.sum("parents")).first()))
        told[r] = met.select("part", F.lit(r).alias("round"), "target", "sums")
        for old in [k for k in told if 0 < k <= r - SAMPLES]:
            del told[old], seats[old]
        del own, met
        release(spark)
    del counted

    names = ["part", "batch", "known", "base", "score"]

    sampled = sorted(told)[-SAMPLES:] if sums else []
    last = [whole[0]] + [whole[r] for r in sampled]

    def score(left, right):
        """Left: a part's packed lists; right: what it knows and is told."""
        part, held = left.column("part")[0].as_py(), left.column("blob").to_pylist()
        is_counts, is_seats = pc.equal(right.column("target"), -2), pc.equal(right.column("target"), -1)
        c = Counts.unpack(right.filter(is_counts).column("sums")[0].as_py())
        drawn = right.filter(is_seats).sort_by("round").column("sums").to_pylist()
        totals = Totals.of_part(_told(c, parts, right.filter(pc.greater_equal(right.column("target"), 0))), last)
        model = Predictor(c, totals, [unpack_seats(x, c) for x in drawn])
        pack = zstandard.ZstdCompressor(level=1).compress
        out = []
        for batch, blob in zip(left.column("batch").to_pylist(), held):
            h, own, w, n, doc, context, train = unpack(blob)
            log_p, base, known = model.logs(h, w, np.searchsorted(c.contexts, own)[context])
            size = len(train)
            out.append(
                (
                    part,
                    batch,
                    pack(np.bincount(doc, weights=n * known, minlength=size).astype("<u4").tobytes()),
                    pack_sums(np.bincount(doc, weights=n * base, minlength=size)),
                    pack_sums(np.bincount(doc, weights=n * log_p, minlength=size)),
                )
            )
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    if sums:
        # both sides are dealt by part; the blobs stay where they are
        knows = told[0].unionByName(counts.select("part", F.lit(0).alias("round"), F.lit(-2).alias("target"), F.col("counts").alias("sums")))
        for r in sampled:
            knows = knows.unionByName(told[r]).unionByName(seats[r])
        partial = blobs.groupBy("part").cogroup(knows.groupBy("part")).applyInArrow(score, "part int, batch long, known binary, base binary, score binary")
    else:
        partial = blobs.select("part", "batch", *[F.lit(None).cast("binary").alias(c) for c in names[2:]])
    heads = packed(docs, parts, heads=True).select("part", "batch", "ids", "held", "sizes", *[F.lit(None).cast("binary").alias(c) for c in ("known", "base", "score")])
    listed = partial.select(
        "part",
        "batch",
        F.lit(None).cast(f"array<{kind}>").alias("ids"),
        F.lit(None).cast("array<boolean>").alias("held"),
        F.lit(None).cast("array<long>").alias("sizes"),
        "known",
        "base",
        "score",
    )
    n_train = int(whole[0][0])

    def finish(batches):
        head, sums = None, None

        def out():
            ids, held, sizes = head
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    held,
                    sizes,
                    pa.array(sums[0].astype(np.int64)),
                    pa.array(np.full(len(ids), n_train, np.int64)),
                    pa.array(sums[1]),
                    pa.array(sums[2]),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() < 0:  # sorted first in its batch
                    if head is not None:
                        yield out()
                    head = tuple(b.column(k)[i].values for k in (2, 3, 4))
                    sums = [np.zeros(len(head[0])) for _ in range(3)]
                else:
                    known = zstandard.ZstdDecompressor().decompress(b.column(5)[i].as_py())
                    sums[0] += np.frombuffer(known, "<u4")
                    sums[1] += unpack_sums(b.column(6)[i].as_py())
                    sums[2] += unpack_sums(b.column(7)[i].as_py())
        if head is not None:
            yield out()

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return heads.unionByName(listed).repartition("batch").sortWithinPartitions("batch", "part").mapInArrow(finish, schema)


@register("op7_pitman_yor")
def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents."""
    return score_documents(read(spark, sf_dir, "documents"))
