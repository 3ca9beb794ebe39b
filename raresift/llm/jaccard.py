"""N-gram Jaccard join: size-aware, light sets by subsets, heavy sets by lists.

A document's set holds 64-bit hashes of its distinct word shingles.  Documents
with equal sets are one class; only classes are joined.

* Order.  A sketch of document counts over *all* shingles (fixed size, at most
  ``MAX_SKETCH`` counters) gives every shingle a coarse level; sets are ordered
  by (level, hash), so frequent shingles come last.  The sketch steers cost
  only: any total order gives the same links.
* Light sets (size up to a boundary) enumerate their subsets of the sizes that
  a link needs: two sets of at most ``b`` elements that link share
  ``ceil(t * b)`` of them, so both emit one common subset.
* Heavy sets put their first ``s - ceil(t * s) + 1`` shingles into inverted
  lists; a list is scanned in size order with the length and position bounds.
* The boundary minimises the cost measured on the short texts: subsets to
  enumerate against list entries times their expected number of partners.

Links must be found between different texts, yet a group of ``m`` near copies
has ``m^2 / 2`` pairs.  So the lists are scanned twice.  First, neighbours in
two hashed orders of the first lists of each set are compared and the links
united, which joins most of every group at ``m`` pairs an order.  Then all lists are
scanned for pairs of sets that are *not yet connected*.  Short lists give their
pairs; the members of longer ones meet again with a parity bitmap of each set
(the Hamming distance of two never exceeds the sets' difference).  Of the pairs
that pass it, a list first gives only a spanning part, the closest of which
between any two components is checked and united; then the members meet once
more and give every pair that passes and is still not connected.  Nothing is
capped: each candidate pair is compared by bitmap or already in one component,
and every pair that passes is checked on the whole sets, made again from the
texts of the classes that need it.  Before that, pairs of large sets meet a
sharper bitmap, as wide as the sets are large: whole sets are many times its
size, so only pairs that most likely link should move them.

Defined results: null texts and texts without words have an empty set and are
alone; texts with fewer words than a shingle are one shingle; documents with a
null id are not linked (null component); equal ids are equal documents as far
as components go (the smallest id names the component).
"""

from __future__ import annotations

import itertools
import math
import zlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.llm.catalog import register
from raresift.llm.common import materialize, read, release, shuffle_partitions
from raresift.llm.components import connected_components

WORDS = 4
NUMER, DENOM = 85, 100
MIN_SKETCH, MAX_SKETCH = 1 << 20, 1 << 23
CHUNK = 1 << 14
BITMAP = 2048
LIGHT_MOST = 16
CHAIN_LISTS = 3
CHAIN_ORDERS = 2
SHORT_LIST = 8
#: members of a list that are compared in one group
BLOCK = 4096
#: up to this size half a bitmap is sharp enough
SMALL_SET = 1200
BLOOM_BITS = 1 << 24
BLOOM_CHUNKS = 16

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text."""
    from xxhash import xxh3_64_intdigest as digest

    if not text:
        return np.empty(0, np.uint64)
    w = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([digest(b" ".join(w), 1)], np.uint64)
    h = np.fromiter(map(digest, w), np.uint64, len(w))
    s = mix(h[: len(h) - words + 1] * _M1)
    for k in range(1, words):
        s = mix((s + h[k : len(h) - words + 1 + k]) * _M1)
    return np.unique(s)


def need(size, numer: int = NUMER, denom: int = DENOM):
    """Least overlap that a link of a set of this size has: ceil(t * size)."""
    return -(-size * numer // denom)


def subset_sizes(size: int, numer: int = NUMER, denom: int = DENOM) -> list[int]:
    """Sizes of the subsets a light set enumerates, one per larger partner."""
    return sorted({need(b, numer, denom) for b in range(size, size * denom // numer + 1)})


def subset_cost(size: int, numer: int = NUMER, denom: int = DENOM) -> int:
    return sum(comb(size, c) for c in subset_sizes(size, numer, denom))


class Sketch:
    """Document counts of shingles by hash, and the levels they give."""

    def __init__(self, counts: np.ndarray):
        mean = max(1.0, counts.sum() / len(counts))
        ratio = np.maximum(counts / mean, 1.0)
        self.levels = np.floor(np.log2(ratio)).astype(np.uint8)
        self.counts = counts

    def place(self, s: np.ndarray) -> np.ndarray:
        return (s & np.uint64(len(self.counts) - 1)).astype(np.int64)

    def order(self, s: np.ndarray) -> np.ndarray:
        """The set, frequent shingles last."""
        lev = self.levels[self.place(s)]
        return s[np.lexsort((s, lev))] if lev.any() else s


def _pack(n: np.ndarray) -> bytes:
    """Counters by byte planes, compressed: most counts of a task are small."""
    return zlib.compress(n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def document_counts(docs: DataFrame, words: int) -> Sketch:
    """Sketch over the shingles of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = MIN_SKETCH
    while width < MAX_SKETCH and width * 800 < total:  # about 128 shingles a counter
        width *= 2

    def run(batches):
        n = np.zeros(width, np.uint32)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(n, (shingles(t, words) & np.uint64(width - 1)).astype(np.int64), 1)
        if n.any():
            parts = n.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([_pack(p) for p in parts], pa.binary())], names=["chunk", "n"]
            )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = _unpack(n).astype(np.uint64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([_pack(np.minimum(x, 0xFFFFFFFF)) for x in sums.values()], pa.binary())],
                names=["chunk", "n"],
            )

    parts = docs.select("text").mapInArrow(run, "chunk int, n binary")
    summed = parts.repartition(min(width // CHUNK, 4 * shuffle_partitions(docs.sparkSession)), "chunk").mapInArrow(add, "chunk int, n binary")
    counts = np.zeros(width, np.uint32)
    for r in summed.collect():  # width counters, whatever the input
        counts[r[0] * CHUNK : (r[0] + 1) * CHUNK] = _unpack(r[1])
    return Sketch(counts)


def choose_boundary(docs: DataFrame, held, words: int, numer: int, denom: int) -> int:
    """Size up to which sets are light: least cost over the short texts."""

    def run(batches):
        sketch = held.value
        n = np.zeros(LIGHT_MOST + 1, np.int64)
        partners = np.zeros(LIGHT_MOST + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                s = shingles(t, words)
                if 0 < len(s) <= LIGHT_MOST:
                    first = sketch.order(s)[: len(s) - need(len(s), numer, denom) + 1]
                    n[len(s)] += 1
                    partners[len(s)] += int(sketch.counts[sketch.place(first)].sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(LIGHT_MOST + 1), pa.int32()), pa.array(n), pa.array(partners)], names=["size", "n", "partners"]
        )

    short = docs.where(F.octet_length("text") < 64 * LIGHT_MOST).select("text")
    got = short.mapInArrow(run, "size int, n long, partners long").groupBy("size").agg(F.sum("n"), F.sum("partners")).collect()
    n = {r[0]: (r[1], r[2]) for r in got}
    best, best_cost = 0, None
    for x in range(LIGHT_MOST + 1):
        cost = 0
        for s in range(1, LIGHT_MOST + 1):
            rows, partners = n.get(s, (0, 0))
            lists = rows * (s - need(s, numer, denom) + 1) + partners
            if s <= x:
                cost += rows * subset_cost(s, numer, denom) + (lists if s * denom // numer > x else 0)
            else:
                cost += lists
        if best_cost is None or cost < best_cost:
            best, best_cost = x, cost
    return best


def parity_bitmap(s: np.ndarray, width: int = BITMAP) -> np.ndarray:
    """Parity of the number of elements per hash place, as 64-bit words."""
    at = (mix(s * _M2) & np.uint64(width - 1)).astype(np.int64)
    bits = (np.bincount(at, minlength=width) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def sharp_width(size: int) -> int:
    """Bits of the bitmap by which a large set is compared before the set moves."""
    width = BITMAP
    while width * SMALL_SET < size * BITMAP:
        width *= 2
    return width


def signatures(docs: DataFrame, held, boundary: int, words: int, numer: int, denom: int) -> DataFrame:
    """doc_id, n_shingles, cid (of the set), bitmaps, subset and list keys."""
    from xxhash import xxh3_64_intdigest as digest

    def run(batches):
        sketch = held.value
        for b in batches:
            size, cid, bitmap, sharp, subsets, lists = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, words)
                n = len(s)
                size.append(n)
                if n == 0:
                    cid.append(None), bitmap.append(None), sharp.append(None), subsets.append([]), lists.append([])
                    continue
                cid.append(digest(s.tobytes()) - (1 << 63))
                bitmap.append(parity_bitmap(s))
                sharp.append(parity_bitmap(s, sharp_width(n)) if n > SMALL_SET else None)
                own = []
                if n <= boundary:
                    for c in subset_sizes(n, numer, denom):
                        own += [digest(np.array(x, np.uint64).tobytes(), c) - (1 << 63) for x in itertools.combinations(s, c)]
                subsets.append(own)
                if n > boundary or n * denom // numer > boundary:
                    lists.append(sketch.order(s)[: n - need(n, numer, denom) + 1].view(np.int64))
                else:
                    lists.append([])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(cid, pa.int64()),
                    pa.array(bitmap, pa.list_(pa.int64())),
                    pa.array(sharp, pa.list_(pa.int64())),
                    pa.array(subsets, pa.list_(pa.int64())),
                    pa.array(lists, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "cid", "bitmap", "sharp", "subsets", "lists"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, cid long, bitmap array<long>, sharp array<long>, subsets array<long>, lists array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _columns(batch) -> list[np.ndarray]:
    """Columns as numpy arrays; a list column as an array of arrays."""
    out = []
    for c in batch.columns:
        if pa.types.is_list(c.type):
            at, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
            own = np.empty(len(c), object)
            own[:] = [flat[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())] if len(c) else []
            out.append(own)
        else:
            out.append(c.to_numpy(zero_copy_only=False))
    return out


def _lists(batches, emit):
    """Stream rows sorted by key through ``emit(columns of one list)``, which
    gives arrays (a, b, pos): pairs with pos -9, or members of a long list."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            cols = _columns(batch)
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            # the last list may go on in the next batch
            start = np.concatenate(([0], cut))
            rest = [c[start[-1] :] for c in cols]
            bounds = list(zip(start[:-1].tolist(), start[1:].tolist()))
        elif rest is not None:
            cols, bounds = rest, [(0, len(rest[0]))]
        else:
            return
        found = [emit(*[c[a:z] for c in cols]) for a, z in bounds if z - a > 1]
        found = [f for f in found if len(f[0])]
        if found:
            rows = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows.T], names=["a", "b", "pos"])


NOTHING = (np.empty(0, np.int64),) * 3


def _as_pairs(u: np.ndarray, v: np.ndarray):
    return np.minimum(u, v), np.maximum(u, v), np.full(len(u), -9)


def _chain(numer: int, denom: int):
    """Pairs of neighbours in ``CHAIN_ORDERS`` hashed orders of each list."""

    def emit(key, pos, size, cid, comp):
        keep = np.unique(cid, return_index=True)[1]
        size, cid = size[keep], cid[keep]
        found = [NOTHING]
        for seed in range(1, CHAIN_ORDERS + 1):
            order = np.argsort(mix(cid.view(np.uint64) * _M1 + np.uint64(seed)))
            s, c = size[order], cid[order]
            ok = np.minimum(s[1:], s[:-1]) * denom >= np.maximum(s[1:], s[:-1]) * numer
            found.append(_as_pairs(c[:-1][ok], c[1:][ok]))
        return tuple(np.concatenate(x) for x in zip(*found))

    return emit


def _halved(bits: np.ndarray) -> np.ndarray:
    """The parity bitmap of half the length."""
    return bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]


def _fold(bits: np.ndarray) -> np.ndarray:
    """A whole bitmap as the parity bitmap of half its length."""
    return bits if len(bits) == BITMAP // 128 else _halved(bits)


def _root(parent: dict, c: int) -> int:
    while parent.setdefault(c, c) != c:
        parent[c] = parent[parent[c]]
        c = parent[c]
    return c


def _scan(numer: int, denom: int, spanning: bool = False):
    """Pairs of unconnected sets within the length and position bounds; without
    bitmaps, a long list gives its members instead (key, cid, pos).  With
    ``spanning``, only pairs that no others of the list connect already."""

    def emit(key, pos, size, cid, comp, bits=None, side=None):
        if (comp == comp[0]).all():
            return NOTHING
        if bits is None and len(cid) > SHORT_LIST:
            return np.full(len(cid), key[0]), cid, pos.astype(np.int64)
        order = np.argsort(size, kind="stable")
        pos, size, cid, comp = pos[order], size[order], cid[order], comp[order]
        side = np.zeros(len(size), np.int8) if side is None else side[order]
        if bits is not None:
            bits = [x.view(np.uint64) for x in bits[order]]  # a signed count would take the absolute value
            half = np.stack([_fold(x) for x in bits])
            whole = np.array([len(x) == BITMAP // 64 for x in bits])
        left = size - pos - 1  # elements after this one, for the position bound
        begin = np.searchsorted(size, -(-size * numer // denom), side="left")
        end = np.searchsorted(size, size * denom // numer, side="right")
        out_u, out_v = [], []
        parent: dict = {}
        # each pair has a member outside the largest component: those search all
        name, at, number = np.unique(comp, return_inverse=True, return_counts=True)
        others = at != number.argmax()
        for i in np.flatnonzero(others).tolist():
            j = np.arange(begin[i], end[i])
            # of two that search, the first one gives the pair
            j = j[(comp[j] != comp[i]) & ((j > i) | ~others[j]) & ((side[j] != side[i]) | (side[i] == 0))]
            least, most = np.minimum(size[i], size[j]), size[i] + size[j]
            # o >= t * (a + b - o), and o <= 1 + what follows in both
            reach = np.where((pos[j] < 0) | (pos[i] < 0), least, 1 + np.minimum(left[j], left[i]))
            j = j[reach * (numer + denom) >= numer * most]
            if bits is not None and len(j):
                # |A xor B| = a + b - 2 o <= (denom - numer) / (denom + numer) * (a + b)
                room = (denom - numer) * (size[i] + size[j])
                j = j[np.bitwise_count(half[j] ^ half[i]).sum(1, dtype=np.int64) * (denom + numer) <= room]
                if whole[i] and len(j):
                    apart = np.array([int(np.bitwise_count(bits[k] ^ bits[i]).sum()) if whole[k] else 0 for k in j])
                    j = j[apart * (denom + numer) <= (denom - numer) * (size[i] + size[j])]
            if spanning and len(j):  # the closest first: they most likely link
                apart = np.bitwise_count(half[j] ^ half[i]).sum(1, dtype=np.int64)
                j = j[np.argsort(apart / (size[i] + size[j]), kind="stable")]
                own, keep = _root(parent, int(comp[i])), []
                for k in j.tolist():
                    other = _root(parent, int(comp[k]))
                    if other != own:
                        parent[other] = own
                        keep.append(k)
                j = np.array(keep, np.int64)
            if len(j):
                out_u.append(np.full(len(j), cid[i]))
                out_v.append(cid[j])
        return _as_pairs(np.concatenate(out_u), np.concatenate(out_v)) if out_u else NOTHING

    return emit


def _in_lists(rows: DataFrame, emit) -> DataFrame:
    """What ``emit`` gives for the lists of rows (key, pos, size, cid, comp, ...)."""
    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _lists(batches, emit), "a long, b long, pos long").distinct()


def _unconnected(found: DataFrame, labelled: DataFrame, emit) -> DataFrame:
    """Candidate pairs between sets that are not connected, from what the lists
    gave: pairs of short lists, and long lists by their members."""
    comp = labelled.select("cid", "comp")
    pairs = found.where("pos = -9").select("a", "b")
    pairs = pairs.join(comp.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), "a")
    pairs = pairs.join(comp.select(F.col("cid").alias("b"), F.col("comp").alias("cb")), "b").where("ca != cb").select("a", "b")
    members = found.where("pos != -9").select(F.col("a").alias("key"), F.col("b").alias("cid"), "pos").join(comp, "cid")
    # lists that are one component by now have nothing to give; long ones are
    # cut into blocks, and every two blocks of a list meet in a group of their own
    mixed = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m")).where("x != y")
    mixed = mixed.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = members.join(mixed, "key").withColumn("x", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    members = members.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2).cast("byte")
    cell = F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y"))
    # the bitmaps come last, so they move once
    members = members.select(cell.alias("key"), "pos", "cid", "comp", side.alias("side")).join(labelled.select("cid", "size", "bits"), "cid")
    more = _in_lists(members.select("key", "pos", "size", "cid", "comp", "bits", "side"), emit)
    return pairs.unionByName(more.select("a", "b")).distinct()


def _bloom(ids: DataFrame, col: str) -> np.ndarray:
    """Bits of hashed ids, ``BLOOM_BITS`` of them (a filter before a join); they
    reach the driver as packed chunks."""
    chunk = BLOOM_BITS // BLOOM_CHUNKS

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(h // chunk).tolist():
                held.setdefault(c, np.zeros(chunk, bool))[h[h // chunk == c] % chunk] = True
        if held:
            packed = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "bits"])

    h = ids.select(F.pmod(F.xxhash64(col), F.lit(BLOOM_BITS)).alias("h"))
    dealt = h.repartition(BLOOM_CHUNKS, (F.col("h") / chunk).cast("int"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in dealt.mapInArrow(run, "chunk int, bits binary").collect():
        out[r[0] * chunk // 8 : (r[0] + 1) * chunk // 8] |= np.frombuffer(r[1], np.uint8)
    return out.view("<i8")


def whole_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(cid, members array<long>) of the classes (cid, rep): their sets, made
    again from the texts of their representatives."""
    from xxhash import xxh3_64_intdigest as digest

    bits = docs.sparkSession.sparkContext.broadcast(_bloom(classes, "rep"))

    def run(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            hit = (bits.value[h >> 6] >> (h & 63)) & 1
            at = np.flatnonzero(hit)
            sets = [shingles(t, words) for t in b.column(2).take(pa.array(at)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).take(pa.array(at)),
                    pa.array([digest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["rep", "cid", "members"],
            )

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BLOOM_BITS)).alias("h")
    made = docs.select(place, F.col("doc_id").cast("long").alias("rep"), "text").mapInArrow(run, "rep long, cid long, members array<long>")
    # whichever text a set is made from, its cid names it: they are dealt by cid alone, once
    return made.select("cid", "members").join(classes.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def _folded(c: str):
    half = BITMAP // 128
    return F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _near(numer: int, denom: int):
    """Of pairs (a, b, sa, sb, ba, bb) those within the bitmaps' bound, and how
    far apart they are as a share of both sizes."""

    def run(batches):
        for batch in batches:
            a, b, sa, sb, ba, bb = _columns(batch)
            apart = np.empty(len(a), np.int64)
            for i, (x, y) in enumerate(zip(ba, bb)):
                while len(x) > len(y):
                    x = _halved(x)
                while len(y) > len(x):
                    y = _halved(y)
                apart[i] = np.bitwise_count((x ^ y).view(np.uint64)).sum()
            # |A xor B| = a + b - 2 o <= (denom - numer) / (denom + numer) * (a + b)
            ok = np.flatnonzero(apart * (denom + numer) <= (denom - numer) * (sa + sb))
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (a, b, sa, sb, apart / (sa + sb))], names=["a", "b", "sa", "sb", "apart"])

    return run


def _closest(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Of the pairs between any two components the closest one."""
    p = pairs.join(comp.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), "a", "left")
    p = p.join(comp.select(F.col("cid").alias("b"), F.col("comp").alias("cb")), "b", "left")
    ca, cb = F.coalesce("ca", "a"), F.coalesce("cb", "b")
    best = p.groupBy(F.least(ca, cb), F.greatest(ca, cb)).agg(F.min(F.struct("apart", "a", "b", "sa", "sb")).alias("p"))
    return best.select("p.a", "p.b", "p.sa", "p.sb")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, numer: int, denom: int, comp: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) that link, by whole sets; given the components (cid,
    comp), only the closest pair between any two is checked."""
    own = classes.select("cid", "size", F.coalesce("sharp", "bits").alias("bits"))
    p = pairs.join(own.select(F.col("cid").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("ba")), "a")
    p = p.join(own.select(F.col("cid").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("bb")), "b")
    p = p.where(F.least("sa", "sb") * denom >= F.greatest("sa", "sb") * numer).select("a", "b", "sa", "sb", "ba", "bb")
    p = p.mapInArrow(_near(numer, denom), "a long, b long, sa long, sb long, apart double")
    p = materialize(p.select("a", "b", "sa", "sb") if comp is None else _closest(p, comp))
    wanted = p.select(F.col("a").alias("cid")).union(p.select("b")).distinct()
    wanted = materialize(classes.join(wanted, "cid", "left_semi").select("cid", "rep"))
    sets = materialize(whole_sets(docs, wanted, words))
    q = p.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("ma")), "a")
    q = q.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("mb")), "b")
    o = F.size(F.array_intersect("ma", "mb"))
    return q.where(o * denom >= (F.col("sa") + F.col("sb") - o) * numer).select("a", "b")


def jaccard_components(docs: DataFrame, words: int = WORDS, numer: int = NUMER, denom: int = DENOM) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; documents link
    when denom * intersection >= numer * union of their shingle sets."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    held = spark.sparkContext.broadcast(document_counts(docs, words))
    boundary = choose_boundary(docs, held, words, numer, denom)
    sig = materialize(signatures(docs, held, boundary, words, numer, denom))
    linked = sig.where("cid IS NOT NULL AND doc_id IS NOT NULL")
    # dealt by cid once: joins by cid find the classes where they are
    bits = F.when(F.col("size") <= SMALL_SET, _folded("bitmap")).otherwise(F.col("bitmap"))
    firsts = [F.first(c).alias(c) for c in ("bitmap", "sharp", "subsets", "lists")]
    classes = linked.repartition(shuffle_partitions(spark), "cid").groupBy("cid").agg(F.min("doc_id").cast("long").alias("rep"), F.first("n_shingles").alias("size"), *firsts)
    classes = materialize(classes.withColumn("bits", bits).drop("bitmap"))
    sig = materialize(sig.select("doc_id", "n_shingles", "cid"))
    del linked  # else the keys of all documents stay on disk beside those of the classes
    release(spark)

    def rows(labelled: DataFrame, most: int | None) -> DataFrame:
        lists = F.col("lists") if most is None else F.slice("lists", 1, most)
        keep = ["size", "cid", "comp"]
        a = labelled.select(F.posexplode(lists).alias("pos", "key"), *keep)
        b = labelled.select(F.lit(-1).alias("pos"), F.explode("subsets").alias("key"), *keep)
        return a.unionByName(b).select("key", "pos", *keep)

    labelled = classes.withColumn("comp", F.col("cid"))
    edges, found, comp = None, None, None
    for r in range(3):
        if r == 0:
            pairs = _in_lists(rows(labelled, CHAIN_LISTS), _chain(numer, denom)).select("a", "b")
        else:
            if found is None:
                found = materialize(_in_lists(rows(labelled, None), _scan(numer, denom)))
            pairs = _unconnected(found, labelled, _scan(numer, denom, spanning=r == 1))
        new = materialize(verified(pairs, classes, docs, words, numer, denom, comp if r == 1 else None))
        edges = new if edges is None else edges.unionByName(new)
        comp = materialize(connected_components(edges).select(F.col("node").alias("cid"), F.col("component").alias("comp")))
        labelled = classes.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        edges = comp.select(F.col("cid").alias("a"), F.col("comp").alias("b"))  # the components, as stars
        del pairs, new
        release(spark)  # the files of this round's comparisons
    named = classes.select("cid", "rep").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("cid", "component_id")
    out = sig.select("doc_id", "n_shingles", "cid").join(named, "cid", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id").cast("long")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, numer: int = 80, denom: int = 100) -> DataFrame:
    """The documents without all but the smallest id of every group of near
    duplicates; of rows that repeat an id, one stays.  Rows without an id stay."""
    found = jaccard_components(docs, words, numer, denom)
    drop = found.where("doc_id != component_id").select("doc_id").distinct()
    rest = docs.join(materialize(drop), "doc_id", "left_anti").select(*docs.columns)
    again = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.limit(1).count() == 0:
        return rest
    once = rest.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))


@register("op9_jaccard")
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by Jaccard 0.85 of four-word shingles."""
    return jaccard_components(read(spark, sf_dir, "documents"))
