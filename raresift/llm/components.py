"""Connected components of an edge table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.llm.common import materialize

ROWS = 50_000


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component = smallest node.

    Alternating large-star and small-star steps: each keeps the components,
    pulls every node to the smallest of its neighbours, and never makes more
    edges than there were.  Minima are partially aggregated, so a node with very many
    neighbours costs one row per task; the edges then meet them in a join that
    AQE may split.  One count and checksum per round reach the driver.  The
    rounds run in one partition per ``ROWS`` edges, as they never grow.
    """
    und = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    edges_ = materialize(und.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges_)
    parts = max(1, -(-state[0] // ROWS))
    edges_ = edges_.coalesce(parts)
    while True:
        both = edges_.unionByName(edges_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u").coalesce(parts)
        small = (
            hop.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .coalesce(parts)
            .distinct()
        )
        edges_ = materialize(small.coalesce(parts))
        now = _state(edges_)
        if now == state:
            break
        state = now
    leaves = edges_.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges_.select(F.col("v").alias("node")).distinct().join(leaves.select("node"), "node", "left_anti")
    return leaves.unionByName(roots.select("node", F.col("node").alias("component")))
