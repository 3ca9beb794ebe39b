"""Embedding near-duplicates with navigable small-world graphs per shard.

Equal vectors are one class (counted, never expanded into pairs).  The classes
are dealt into shards by hash; every shard gets a hierarchical navigable
small-world graph, built in batches in one task (at most about ``SHARD_ROWS``
vectors).  Every class is searched in its own shard and all later ones, in
blocks of ``BLOCK_ROWS`` queries, so each pair of shards meets once.  A shard
meets itself in a single task, which sees each of its pairs from both ends and
counts it once.

A search keeps a beam of candidates.  A beam whose worst member is still a link
is widened until it is not, and an audit compares a part of the queries of
every task with an exact scan: while less than ``RECALL`` of their links are
found, all beams of the task are doubled (at the size of the shard the search
is exact).  Found pairs are verified by cosine in double precision.  A task
returns, for each class, its number of links there and one edge towards the
root of its local component; the edges are united on the cluster.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (own component, kept); vectors of different
lengths are never compared; every row is a vector of its own, so equal rows
link with each other; ids may repeat.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.llm.catalog import register
from raresift.llm.common import materialize, read
from raresift.llm.components import connected_components

THRESHOLD = 0.95
SHARDS = 8
SHARD_ROWS = 100_000
BLOCK_ROWS = 200_000
LINKS = 16
BUILD_BEAM = 48
SEARCH_BEAM = 32
RECALL = 0.99
AUDIT_SHARE = 0.02
AUDIT_LEAST = 200
#: slack for candidates that are compared in single precision first
SLACK = 1e-4


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, width: int = 4):
    """Beam search for all queries in step: (ids, similarities), best first."""
    n_q = len(q)
    beam = min(beam, len(x))
    ids = np.full((n_q, beam), -1, np.int64)
    sim = np.full((n_q, beam), -np.inf, np.float32)
    done = np.zeros((n_q, beam), bool)
    k = min(entry.shape[1], beam)
    first = np.einsum("qkd,qd->qk", x[entry], q)
    order = np.argsort(-first, axis=1)[:, :k]
    ids[:, :k] = np.take_along_axis(entry, order, 1)
    sim[:, :k] = np.take_along_axis(first, order, 1)
    live = np.arange(n_q)
    width = min(width, beam)
    while len(live):
        waiting = np.where(done[live] | (ids[live] < 0), -np.inf, sim[live])
        pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width] if width < beam else np.tile(np.arange(beam), (len(live), 1))
        value = np.take_along_axis(waiting, pick, 1)
        some = np.isfinite(value).any(1)
        live, pick, value = live[some], pick[some], value[some]
        if not len(live):
            break
        chosen = np.where(np.isfinite(value), np.take_along_axis(ids[live], pick, 1), -1)
        flag = done[live]
        np.put_along_axis(flag, pick, True, 1)
        done[live] = flag
        near = links[chosen].reshape(len(live), -1)
        near[np.repeat(chosen < 0, links.shape[1], 1)] = -1
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        s = np.einsum("qkd,qd->qk", x[near], q[live])
        s[near < 0] = -np.inf
        s[s <= sim[live][:, -1:]] = -np.inf
        useful = np.isfinite(s).any(1)
        if useful.any():
            rows = live[useful]
            near, s = near[useful], s[useful]
            known = (near[:, :, None] == ids[rows][:, None, :]).any(2)
            s[known] = -np.inf
            all_s = np.concatenate((sim[rows], s), 1)
            all_i = np.concatenate((ids[rows], near), 1)
            all_d = np.concatenate((done[rows], np.zeros(near.shape, bool)), 1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sim[rows] = np.take_along_axis(all_s, top, 1)
            kept = np.take_along_axis(all_i, top, 1)
            ids[rows] = np.where(np.isfinite(sim[rows]), kept, -1)
            done[rows] = np.take_along_axis(all_d, top, 1)
    return ids, sim


def diverse(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Per row up to ``most`` candidates, nearest first, preferring those that
    are nearer to the row than to any chosen one; -1 where there are none."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    ok = np.isfinite(sim) & (cand >= 0)
    v = x[cand]
    between = np.matmul(v, v.transpose(0, 2, 1))
    taken = np.zeros(cand.shape, bool)
    closest = np.full(cand.shape, -np.inf, np.float32)
    count = np.zeros(len(cand), np.int64)
    for j in range(cand.shape[1]):
        take = ok[:, j] & (sim[:, j] > closest[:, j]) & (count < most)
        taken[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    # chosen ones first, then the nearest others
    key = np.where(taken, 0, np.where(ok, 1, 2))
    order = np.argsort(key, axis=1, kind="stable")[:, :most]
    out = np.full((len(cand), most), -1, np.int64)
    out[:, : order.shape[1]] = np.where(np.take_along_axis(key, order, 1) < 2, np.take_along_axis(cand, order, 1), -1)
    return out


def build_layer(x: np.ndarray, entry_of, most: int) -> np.ndarray:
    """Links of one layer over the vectors ``x``, inserted in batches."""
    n = len(x)
    links = np.full((n, most), -1, np.int64)
    at = 0
    while at < n:
        size = min(n - at, 256 if at == 0 else min(at, 1024))
        new = np.arange(at, at + size)
        own = x[new] @ x[new].T
        own[np.arange(size), np.arange(size)] = -np.inf
        k = min(BUILD_BEAM, max(1, size - 1))
        top = np.argpartition(-own, k - 1, axis=1)[:, :k]
        cand, sim = new[top], np.take_along_axis(own, top, 1)
        if at:
            entry = entry_of(x[new], at)
            ids, s = beam_search(x[:at], links[:at], x[new], entry, BUILD_BEAM)
            cand, sim = np.concatenate((cand, ids), 1), np.concatenate((sim, s), 1)
            keep = np.argsort(-sim, axis=1, kind="stable")[:, :BUILD_BEAM]
            cand, sim = np.take_along_axis(cand, keep, 1), np.take_along_axis(sim, keep, 1)
        links[new] = diverse(x, cand, sim, most)
        # reverse links; a node with more than it can hold is chosen anew
        u = np.repeat(new, most)
        v = links[new].ravel()
        u, v = u[v >= 0], v[v >= 0]
        order = np.lexsort((-np.einsum("id,id->i", x[u], x[v]), v))
        u, v = u[order], v[order]
        nodes, start, number = np.unique(v, return_index=True, return_counts=True)
        rank = np.arange(len(v)) - np.repeat(start, number)
        room = 2 * most
        extra = np.full((len(nodes), room), -1, np.int64)
        few = rank < room
        extra[np.repeat(np.arange(len(nodes)), number)[few], rank[few]] = u[few]
        cand = np.concatenate((links[nodes], extra), 1)
        cand.sort(1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == nodes[:, None]] = -1
        for a in range(0, len(nodes), 2048):
            c, own_v = cand[a : a + 2048], x[nodes[a : a + 2048]]
            s = np.einsum("ikd,id->ik", x[c], own_v)
            s[c < 0] = -np.inf
            links[nodes[a : a + 2048]] = diverse(x, c, s, most)
        at += size
    return links


class Graph:
    """Hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, unit: np.ndarray):
        self.x = unit.astype(np.float32)
        n = len(unit)
        sizes = [n]
        while sizes[-1] > 64:
            sizes.append(max(1, sizes[-1] // LINKS))
        # vectors come in hashed order, so each prefix is a random sample
        self.layers: list[np.ndarray] = []
        for size in reversed(sizes[1:]):
            self.layers.append(build_layer(self.x[:size], self._entry, LINKS))
        self.layers.append(build_layer(self.x, self._entry, 2 * LINKS))

    def _entry(self, q: np.ndarray, limit: int) -> np.ndarray:
        """Entry nodes below ``limit`` from the upper layers."""
        entry = np.zeros((len(q), 1), np.int64)
        for links in self.layers:
            if len(links) > limit:
                break
            ids, _ = beam_search(self.x[: len(links)], links, q, entry, 4)
            entry = np.where(ids < 0, 0, ids)
            entry.sort(1)
            if entry.shape[1] > 1:
                entry = entry[:, -1:] if (entry[:, :1] == entry[:, -1:]).all() else ids[:, :1]
        return entry

    def links_of(self, q: np.ndarray, threshold: float, beam: int):
        """(query, node) pairs with similarity of at least ``threshold``."""
        out_q, out_v = [], []
        q32 = q.astype(np.float32)
        base = self.layers[-1]
        for a in range(0, len(q), 512):
            rows = np.arange(a, min(a + 512, len(q)))
            size = beam
            while len(rows):
                if size >= len(self.x):
                    s = q32[rows] @ self.x.T
                    i, j = np.nonzero(s >= threshold)
                    out_q.append(rows[i])
                    out_v.append(j)
                    break
                saved, self.layers = self.layers, self.layers[:-1]
                entry = self._entry(q32[rows], len(self.x))
                self.layers = saved
                ids, s = beam_search(self.x, base, q32[rows], entry, size)
                full = (ids[:, -1] >= 0) & (s[:, -1] >= threshold)
                i, j = np.nonzero((s >= threshold) & ~full[:, None])
                out_q.append(rows[i])
                out_v.append(ids[i, j])
                rows, size = rows[full], size * 4
        if not out_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_q), np.concatenate(out_v)


def audited_links(graph: Graph, q: np.ndarray, threshold: float, beam: int = SEARCH_BEAM, own: np.ndarray | None = None):
    """Links of all queries; beams double until the audit passes: the mean share
    of an audited query's links that the search has found, itself (node ``own``
    of the graph, -1 if it isn't there) left out."""
    loose = threshold - SLACK
    own = np.full(len(q), -1) if own is None else own
    step = max(1, min(int(1 / AUDIT_SHARE), len(q) // AUDIT_LEAST or 1))
    checked = np.arange(0, len(q), step)
    true = np.zeros(len(checked), np.int64)
    for a in range(0, len(checked), 256):
        rows = checked[a : a + 256]
        near = q[rows].astype(np.float32) @ graph.x.T >= loose
        here = np.flatnonzero(own[rows] >= 0)
        near[here, own[rows[here]]] = False
        true[a : a + 256] = near.sum(1)
    some = np.flatnonzero(true)
    while True:
        i, j = graph.links_of(q, loose, beam)
        other = (i % step == 0) & (j != own[i])
        found = np.bincount(i[other] // step, minlength=len(checked))
        if not len(some) or (found[some] / true[some]).mean() >= RECALL or beam >= len(graph.x):
            return i, j
        beam *= 2


def _unit(table: pa.Table) -> np.ndarray:
    col = table.column("unit").combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1).astype(np.float64)


def _build(key, table):
    table = table.sort_by([("place", "ascending"), ("class_id", "ascending")])
    unit = _unit(table)
    blob = pickle.dumps((table.column("class_id").to_numpy(), table.column("copies").to_numpy(), unit, Graph(unit)))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "graph": pa.array([blob], pa.binary())})


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _search(threshold: float):
    def run(key, left, right):
        empty = pa.table({"class_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return empty
        own_id, copies, unit, graph = pickle.loads(left.column("graph")[0].as_py())
        q_id, q_copies, q = right.column("class_id").to_numpy(), right.column("copies").to_numpy(), _unit(right)
        at = {c: k for k, c in enumerate(own_id.tolist())}
        own = np.array([at.get(c, -1) for c in q_id.tolist()], np.int64)
        i, j = audited_links(graph, q, threshold, own=own)
        exact = np.empty(len(i))
        for a in range(0, len(i), 1 << 18):
            exact[a : a + (1 << 18)] = np.einsum("kd,kd->k", q[i[a : a + (1 << 18)]], unit[j[a : a + (1 << 18)]])
        good = (exact >= threshold) & (q_id[i] != own_id[j])
        i, j = i[good], j[good]
        # inside one shard a pair is met from both of its ends; keep one
        lo, hi = np.minimum(q_id[i], own_id[j]), np.maximum(q_id[i], own_id[j])
        pairs, first = np.unique(np.stack((lo, hi), 1), axis=0, return_index=True) if len(i) else (np.empty((0, 2), np.int64), [])
        i, j = i[first] if len(i) else i, j[first] if len(j) else j
        size_of_q, size_of_own = q_copies[i], copies[j]
        nodes, place = np.unique(np.concatenate((q_id[i], own_id[j])), return_inverse=True)
        a, b = place[: len(i)], place[len(i) :]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, a, size_of_own)
        np.add.at(links, b, size_of_q)
        parent = np.arange(len(nodes))
        for u, v in zip(a.tolist(), b.tolist()):
            ru, rv = _find(parent, u), _find(parent, v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
        root = np.array([_find(parent, u) for u in range(len(nodes))], np.int64)
        return pa.table({"class_id": pa.array(nodes, pa.int64()), "links": pa.array(links), "root": pa.array(nodes[root] if len(nodes) else nodes, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, n_links, component_id and kept for every vector."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda e: e.cast("double")).alias("v"))
    number = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    # scaled by the largest component first, so squares neither overflow nor vanish
    largest = F.array_max(F.transform("v", F.abs))
    ok = F.coalesce(F.forall("v", number) & (largest > 0), F.lit(False))
    v = v.withColumn("ok", ok).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda e: e / largest)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    v = v.select("id", "ok", F.transform("v", lambda e: e / norm).alias("unit"))
    v = v.withColumn("h1", F.xxhash64("unit")).withColumn("h2", F.xxhash64(F.lit(1), F.col("unit")))
    classes = v.where("ok AND id IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("id").cast("long").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")
    )
    # ids may repeat over vectors, so classes have numbers of their own (fixed
    # by the checkpoint)
    classes = materialize(classes.withColumn("place", F.xxhash64("h2", "h1")).withColumn("class_id", F.monotonically_increasing_id()))
    n = classes.count()
    shards, blocks = max(SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n // BLOCK_ROWS))
    # shards of vectors of one length only
    home = F.size("unit").cast("long") * shards + F.pmod(F.col("place"), F.lit(shards))
    classes = classes.withColumn("home", home)
    graphs = classes.select("home", "place", "class_id", "copies", "unit").groupBy("home").applyInArrow(_build, "shard long, graph binary")
    graphs = materialize(graphs)
    blocked = graphs.select("shard", "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    of_length = F.floor(F.col("home") / shards) * shards
    later = F.explode(F.sequence(F.col("home"), of_length + (shards - 1)))
    queries = classes.select("home", "class_id", "copies", "unit", later.alias("shard"), "h1")
    # the classes of a shard search it in one block (about SHARD_ROWS of them)
    block = F.when(F.col("home") == F.col("shard"), F.pmod("shard", F.lit(blocks))).otherwise(F.pmod(F.xxhash64("h1"), F.lit(blocks)))
    queries = queries.withColumn("block", block.cast("int")).drop("h1")
    found = (
        blocked.groupBy("shard", "block")
        .cogroup(queries.groupBy("shard", "block"))
        .applyInArrow(_search(threshold), "class_id long, links long, root long")
    )
    found = materialize(found)
    components = connected_components(found, "class_id", "root")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    told = classes.select("h1", "h2", "class_id", "least_id", "copies").join(links, "class_id", "left")
    told = told.join(components.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    told = told.withColumn("component", F.coalesce("component", "class_id"))
    named = told.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = told.join(named, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = v.where("ok AND id IS NOT NULL").select("id", "h1", "h2").join(told, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = v.where("NOT ok OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


@register("op8_hnsw")
def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings at cosine 0.95."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
