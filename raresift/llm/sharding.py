"""Consistent-hash sharding with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a ring.  A row's key hashes to a
place on the ring and belongs to the first shard clockwise; a shard that is
full passes the row on clockwise.  The capacities sum up to the number of rows
(``ceil`` for the first ``n mod shards`` shards, ``floor`` for the others), so
the counts differ by at most one.

The ring is cut into equal slots (the leading bits of the hash).  All rows of a
slot meet the same shards in the same order, so *which rows go where* follows
from the number of rows per slot: a table of at most ``MAX_SLOTS`` counts, the
only thing the driver sees.  It plans segments (slot, first rank, count, shard,
place in the shard); the rows are ranked inside their slot and joined with the
segments of that slot.  No task ever holds a shard, no row is moved through the
driver, and the rows are shuffled once (ids, sizes and checksums, no texts).

Defined results: null text has no bytes and the checksum of the empty text; a
null key is an ordinary key; repeated rows are counted first and spread
out again after ranking, so a hot key needs one row per map task; an empty
table gives an empty result; extra columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raresift.llm.catalog import register
from raresift.llm.common import crc_text, read

SHARDS = 24
VIRTUAL_NODES = 64
MIN_SLOTS = 1 << 14
MAX_SLOTS = 1 << 20
ROWS_PER_SLOT = 50_000


def slot_count(n_rows: int) -> int:
    """Slots of the ring: a power of two, about ``ROWS_PER_SLOT`` rows each."""
    slots = MIN_SLOTS
    while slots < MAX_SLOTS and slots * ROWS_PER_SLOT < n_rows:
        slots *= 2
    return slots


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted (place on the 32-bit ring, shard) of all virtual nodes."""
    points = []
    for s in range(shards):
        for v in range(virtual_nodes):
            h = hashlib.blake2b(f"{s}#{v}".encode(), digest_size=4).digest()
            points.append((int.from_bytes(h, "big"), s))
    return sorted(points)


def plan_segments(counts: dict[int, int], shards: int, slots: int, virtual_nodes: int = VIRTUAL_NODES):
    """Assign the rows of every slot: list of (slot, first, count, shard, place).

    Round by round, every slot that still has rows offers them to the next
    shard clockwise; a shard takes what its capacity allows.  Within a round
    the slots come in a hashed order, so no part of the ring is favoured.
    """
    n = sum(counts.values())
    free = [n // shards + (s < n % shards) for s in range(shards)]
    filled = [0] * shards
    points = ring(shards, virtual_nodes)
    places = [p for p, _ in points]
    width = (1 << 32) // slots
    order = sorted(counts, key=lambda s: hashlib.blake2b(b"%d" % s, digest_size=8).digest())
    waiting = []
    for s in order:
        if counts[s]:
            waiting.append([s, 0, counts[s], bisect_left(places, s * width)])
    out = []
    while waiting:
        still = []
        for s, first, left, at in waiting:
            while not free[shard := points[at % len(points)][1]]:
                at += 1
            take = min(left, free[shard])
            out.append((s, first, take, shard, filled[shard]))
            free[shard] -= take
            filled[shard] += take
            if left > take:
                still.append([s, first + take, left - take, at + 1])
        waiting = still
    return out


def shard_rows(df: DataFrame, key: str, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Add ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    Columns other than ``key`` order equal keys, so all of them must be
    orderable; carry ids and sizes here and join the payload afterwards.
    """
    spark = df.sparkSession
    place = F.shiftrightunsigned(F.xxhash64(F.col(key)), 32)
    n = df.count()
    slots = slot_count(n)
    width = (1 << 32) // slots
    slot = F.floor(place / width).cast("long")
    counts = {r[0]: r[1] for r in df.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_segments(counts, shards, slots, virtual_nodes)
    segments = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], "_s long, _first long, _n long, shard int, _at long")
    cols = df.columns
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_place", place).withColumn("_slot", slot)
    w = Window.partitionBy("_slot").orderBy("_place", *[F.col(c) for c in cols])
    rows = rows.withColumn("_to", F.sum("_copies").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_from", F.col("_to") - F.col("_copies"))
    met = rows.join(
        segments,
        (F.col("_slot") == F.col("_s")) & (F.col("_from") < F.col("_first") + F.col("_n")) & (F.col("_first") < F.col("_to")),
    )
    a = F.greatest("_from", "_first")
    b = F.least(F.col("_to"), F.col("_first") + F.col("_n")) - 1
    met = met.select(*cols, "shard", "_first", "_at", F.explode(F.sequence(a, b)).alias("_rank"))
    return met.select(*cols, "shard", (F.col("_at") + F.col("_rank") - F.col("_first")).alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write rows that carry ``shard`` as one folder per shard (Parquet)."""
    df.write.partitionBy("shard").mode("overwrite").parquet(path)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size in bytes plus 8, checksum of the text."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        crc_text(F.col("text")).alias("text_crc32"),
    )


@register("op3_shards")
def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``."""
    rows = shard_rows(sized(read(spark, sf_dir, "documents")), "doc_id")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
