import numpy as np
import pytest

from raresift.llm import hnsw as H


def brute(rows, threshold=H.THRESHOLD):
    """(links, component) by all pairs in double precision."""
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            a = a / np.abs(a).max()
            ok[k] = a / np.sqrt((a * a).sum())
    parent = list(range(len(rows)))

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    links = [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k in ok:
        least[find(k)] = min(least.get(find(k), 1 << 60), rows[k][0])
    return sorted((rows[k][0] if rows[k][0] is not None else -1, links[k], least[find(k)] if k in ok else (rows[k][0] if rows[k][0] is not None else -1)) for k in range(len(rows)))


def vectors(n=250, d=12):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=d).tolist()) for i in range(n)]
    base = rng.normal(size=d)
    rows += [(1000 + i, (base + rng.normal(size=d) * 0.17).tolist()) for i in range(120)]  # around the threshold
    rows += [(2000 + i, rows[3][1]) for i in range(40)]  # exact copies
    rows += [(3000, None), (3001, []), (3002, [0.0] * d), (3003, [float("nan")] * d), (3004, [None] + [1.0] * (d - 1)), (3005, [float("inf")] + [1.0] * (d - 1))]
    rows += [(3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, rows[5][1]), (3, rows[3][1]), (3008, [1e200] * d), (3009, [1e-200] * d)]
    return rows


def test_all_links_and_components(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, unit string").repartition(4)
    got = H.near_duplicates(df).collect()
    told = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in got)
    assert told == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_pairs_of_one_shard_count_once_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 40)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    told = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in H.near_duplicates(df).collect())
    assert told == brute(rows)


def test_one_id_on_several_vectors(spark):
    rows = [(3, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (5, [0.0, 1.0, 0.02]), (6, [1.0, 0.01, 0.0]), (7, [1.0, 0.02, 0.0])]
    rows += [(9, [0.0, 0.01, 1.0]), (9, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, 1.0])]  # links within one id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    told = sorted(tuple(r)[:3] for r in H.near_duplicates(df).collect())
    assert told == brute(rows)


def test_audit_leaves_the_query_itself_out():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8))
    x[1::2] = x[::2] + rng.normal(size=(200, 8)) * 0.01  # pairs
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, beams = H.Graph(x), []

    class OnlyItself:
        x = g.x

        def links_of(self, q, threshold, beam):
            beams.append(beam)
            return (np.arange(len(q)),) * 2 if beam < 32 else g.links_of(q, threshold, beam)

    H.audited_links(OnlyItself(), x, 0.95, 8, np.arange(400))
    assert beams == [8, 16, 32]


def test_recall_of_the_graph_itself():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 16))
    x = np.repeat(centres, 10, 0) + rng.normal(size=(3000, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    g = H.Graph(x)
    i, j = g.links_of(x, 0.95, H.SEARCH_BEAM)
    assert len(i) >= 0.95 * (x @ x.T >= 0.95).sum()


def test_audit_widens_beams(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = H.Graph(x)
    tried = []
    find = g.links_of

    def poor(q, threshold, beam):
        tried.append(beam)
        i, j = find(q, threshold, beam)
        return (i, j) if beam >= 64 else (i[:1], j[:1])

    monkeypatch.setattr(g, "links_of", poor)
    i, _ = H.audited_links(g, x, 0.8, 8)
    assert tried == [8, 16, 32, 64] and len(i) >= 0.99 * (x @ x.T >= 0.8).sum()


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_link(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in H.near_duplicates(df).collect()] == [(1, 0, 1, True) for _ in rows]
