"""Vector code compression: product codes whose codebooks ball k-means fits.

Vectors are cut into ``PARTS`` equal consecutive parts; each part position has a
codebook of ``ENTRIES`` entries, and a vector becomes the indexes of its parts'
nearest entries.  All numbers are whole (``floor(SCALE * x)``), so results are
the same under any partitioning.

The vectors are written once, in blocks (one row per Arrow batch), each part
with its *home*: the entry it was nearest to when the blocks were last written.
A round is one pass over the blocks with the codebooks in the function, and one
small aggregate:

- the parts of a block that share a home are a ball around the entry as it is
  now, with the largest distance as its radius; only entries nearer to the
  ball's entry than twice the radius are its neighbours;
- a part nearer to its home than half the way to the nearest neighbour is in
  the stable core and keeps its home without another distance;
- neighbours, sorted by their distance, cut the rest of the ball into rings; a
  part in ring k is compared with the first k neighbours only.

By the triangle inequality in whole numbers (an entry at a squared distance of
more than 4 D from the home cannot be as near as D) this is exact, ties
included.  Homes are written anew only when a round needs ``DRIFT`` times the
distances of the first round after the last writing, so most rounds read the
blocks and write nothing.  To the driver come ``PARTS * ENTRIES`` sums a round
and at most ``ENTRIES`` first vectors.

Defined results: vectors that are null or hold null or non-finite components
are dropped; shorter vectors are padded with zeros to the longest one, and that
to a multiple of ``PARTS`` (empty vectors are all zeros); components beyond
``LIMIT`` count as ``LIMIT``; fewer vectors than ``ENTRIES`` make a smaller
codebook; the first vectors are told by id, then by components (null ids last);
equal entries tie, so the later one stays unused; ids may be null or repeat;
labels may be null (nulls are one label); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.llm.catalog import register
from raresift.llm.common import materialize, read, release
from raresift.llm.vectors import packed, unpacked, whole_numbers

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: squared distances and their sums stay below 2^63 (|x| up to 4096)
LIMIT = 1 << 24
DRIFT = 1.25


def gaps(entries: np.ndarray) -> np.ndarray:
    """Squared distances between the entries of one codebook."""
    d = entries[:, None, :] - entries[None, :, :]
    return (d * d).sum(2)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, ties to the lower index."""
    best, dist = np.zeros(len(x), np.int64), None
    for j, entry in enumerate(entries):
        e = x - entry
        e = (e * e).sum(1)
        if dist is None:
            dist = e
        else:
            better = e < dist
            best[better], dist[better] = j, e[better]
    return best, np.zeros(len(x), np.int64) if dist is None else dist


def nearest_by_balls(x: np.ndarray, entries: np.ndarray, home: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``nearest`` from the balls around the homes, and the distances taken."""
    e = x - entries[home]
    own = (e * e).sum(1)
    best, dist, taken = home.copy(), own.copy(), len(x)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = order[cut[i] : cut[i + 1]]
        if not len(ball):
            continue
        others = np.argsort(gap[i], kind="stable")
        others = others[others != i]
        ring = np.searchsorted(gap[i][others], 4 * own[ball], side="right")
        for t in range(int(ring.max())):  # the ball's neighbours; none for a core
            rows, j = ball[ring > t], others[t]
            e = x[rows] - entries[j]
            e = (e * e).sum(1)
            better = (e < dist[rows]) | ((e == dist[rows]) & (j < best[rows]))
            best[rows[better]], dist[rows[better]] = j, e[better]
            taken += len(rows)
    return best, dist, taken


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, entries: int) -> DataFrame:
    """A row per Arrow batch: ids, labels, rows, width, the whole numbers and
    the batch's ``entries`` first vectors in (id, components) order."""
    kinds = dict(vectors.select(id_col, label_col).dtypes)

    def run(batches):
        for b in batches:
            whole, x = whole_numbers(b.column(1), SCALE, LIMIT)
            keep = pa.array(whole)
            ids, labels = b.column(0).filter(keep), b.column(2).filter(keep)
            turn = pc.sort_indices(ids).to_numpy()  # nulls last
            last = ids[int(turn[min(entries, len(turn)) - 1])] if len(turn) else None
            if last is None:
                first = []
            elif not last.is_valid:
                first = range(len(ids))
            else:
                first = np.flatnonzero(pc.less_equal(ids, last).fill_null(False).to_numpy(zero_copy_only=False)).tolist()
            names = ids.to_pylist() if len(first) else []
            first = sorted(first, key=lambda k: (names[k] is None, 0 if names[k] is None else names[k], x[k].tolist()))[:entries]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(ids.type)),
                    pa.array([labels], pa.list_(labels.type)),
                    pa.array([len(x)], pa.int32()),
                    pa.array([x.shape[1]], pa.int32()),
                    pa.array([packed(x)], pa.binary()),
                    pa.array([[{"id": names[k], "x": x[k].tolist()} for k in first]], pa.list_(pa.struct([("id", ids.type), ("x", pa.list_(pa.int64()))]))),
                ],
                names=["ids", "labels", "n", "width", "x", "first"],
            )

    a, b = kinds[id_col], kinds[label_col]
    schema = f"ids array<{a}>, labels array<{b}>, n int, width int, x binary, first array<struct<id: {a}, x: array<long>>>"
    return vectors.select(id_col, vec_col, label_col).mapInArrow(run, schema)


def _cut(row: dict, parts: int, width: int) -> np.ndarray:
    """The numbers of a block as (part, vector, position within the part)."""
    x = np.zeros((row["n"], parts * width), np.int64)
    x[:, : row["width"]] = unpacked(row["x"], row["n"], row["width"])
    return np.ascontiguousarray(x.reshape(row["n"], parts, width).transpose(1, 0, 2))


def _assigned(row: dict, codebooks: np.ndarray, gap: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(parts, codes, squared distances, distances taken) of a block."""
    x = _cut(row, len(codebooks), codebooks.shape[2])
    home = np.frombuffer(row["home"], np.uint8).reshape(len(codebooks), -1).astype(np.int64) if row.get("home") else None
    codes, dist, taken = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64), 0
    for p, entries in enumerate(codebooks):
        if home is None:
            codes[p], dist[p] = nearest(x[p], entries)
            taken += x[p].shape[0] * len(entries)
        else:
            codes[p], dist[p], some = nearest_by_balls(x[p], entries, home[p], gap[p])
            taken += some
    return x, codes, dist, taken


def _sums(x: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """Per part and entry the count, then the componentwise sums."""
    out = np.zeros((len(x), entries, 1 + x.shape[2]), np.int64)
    for p in range(len(x)):
        np.add.at(out[p, :, 0], codes[p], 1)
        np.add.at(out[p, :, 1:], codes[p], x[p])
    return out


def _by_entry(sums: np.ndarray, taken: int) -> pa.RecordBatch:
    parts, entries, wide = sums.shape
    part, entry = np.divmod(np.arange(parts * entries), entries)
    flat = sums.reshape(-1, wide)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part, pa.int32()),
            pa.array(entry, pa.int32()),
            pa.array(flat[:, 0]),
            pa.array(list(flat[:, 1:]), pa.list_(pa.int64())),
            pa.array([taken] + [0] * (len(flat) - 1), pa.int64()),
        ],
        names=["part", "entry", "n", "sums", "taken"],
    )


_ENTRY_ROWS = "part int, entry int, n long, sums array<long>, taken long"


def round_sums(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """A row per task, part and entry with what the blocks' parts add to it."""
    gap = [gaps(c) for c in codebooks]

    def run(batches):
        sums, taken = np.zeros((*codebooks.shape[:2], 1 + codebooks.shape[2]), np.int64), 0
        for b in batches:
            for row in b.to_pylist():
                x, codes, _, some = _assigned(row, codebooks, gap)
                sums += _sums(x, codes, codebooks.shape[1])
                taken += some
        yield _by_entry(sums, taken)

    return blocks.select("n", "width", "x", *([] if "home" not in blocks.columns else ["home"])).mapInArrow(run, _ENTRY_ROWS)


def with_homes(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """The blocks with the codes under ``codebooks`` as their homes, and the
    sums that belong to them."""
    gap = [gaps(c) for c in codebooks]
    kept = [c for c in blocks.columns if c not in ("home", "sums", "taken")]

    def run(batches):
        for b in batches:
            for k, row in enumerate(b.to_pylist()):
                x, codes, _, taken = _assigned(row, codebooks, gap)
                own = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(own.column(b.schema.get_field_index(c)) for c in kept),
                        pa.array([codes.astype(np.uint8).tobytes()], pa.binary()),
                        pa.array([_sums(x, codes, codebooks.shape[1]).tobytes()], pa.binary()),
                        pa.array([taken], pa.int64()),
                    ],
                    names=[*kept, "home", "sums", "taken"],
                )

    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", home binary, sums binary, taken long"
    return blocks.mapInArrow(run, schema)


def stored_sums(blocks: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``round_sums`` of blocks that ``with_homes`` has just written."""

    def run(batches):
        sums, taken = np.zeros((shape[0], shape[1], 1 + shape[2]), np.int64), 0
        for b in batches:
            for own, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums += np.frombuffer(own, np.int64).reshape(sums.shape)
                taken += some
        yield _by_entry(sums, taken)

    return blocks.select("sums", "taken").mapInArrow(run, _ENTRY_ROWS)


def moved(codebooks: np.ndarray, sums: DataFrame) -> tuple[np.ndarray, int]:
    """Every entry at the floor of its parts' mean (unused ones stay), and the
    distances taken; one row per part and entry reaches the driver."""
    width = codebooks.shape[2]
    total = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.sum("taken").alias("taken"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).cast("array<long>").alias("sums")
    )
    out, taken = codebooks.copy(), 0
    for r in total.collect():
        taken += r["taken"]
        if r["n"]:
            out[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return out, taken


def first_codebooks(blocks: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, position) from the first vectors by id."""
    width = -(-(blocks.agg(F.max("width")).first()[0] or 0) // parts)
    first = blocks.select(F.explode("first").alias("f")).select("f.id", "f.x")
    rows = first.orderBy(F.col("id").asc_nulls_last(), F.col("x").asc()).limit(entries).collect()
    out = np.zeros((parts, len(rows), width), np.int64)
    for k, r in enumerate(rows):
        x = np.zeros(parts * width, np.int64)
        x[: len(r["x"])] = r["x"]
        out[:, k] = x.reshape(parts, width)
    return out


def fit(blocks: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """(codebooks, blocks with homes) after ``rounds`` rounds."""
    codebooks = first_codebooks(blocks, parts, entries)
    write, base = True, None
    for _ in range(rounds if codebooks.shape[1] else 0):
        if write:
            blocks, write, base = materialize(with_homes(blocks, codebooks)), False, None
            codebooks, _ = moved(codebooks, stored_sums(blocks, codebooks.shape))
            release(blocks.sparkSession)
        else:
            codebooks, taken = moved(codebooks, round_sums(blocks, codebooks))
            base = base or taken
            write = taken > DRIFT * base
    return codebooks, blocks


def encode(blocks: DataFrame, codebooks: np.ndarray, id_col: str, label_col: str) -> DataFrame:
    """(id, label, code, error) of every vector of the blocks."""
    kinds = dict(blocks.dtypes)
    gap = [gaps(c) for c in codebooks]

    def run(batches):
        for b in batches:
            for k, row in enumerate(b.select([c for c in ("n", "width", "x", "home") if c in b.schema.names]).to_pylist()):
                if not row["n"]:
                    continue
                _, codes, dist, _ = _assigned(row, codebooks, gap)
                text = codes.T.astype(np.uint8).tobytes().hex()
                step = 2 * len(codebooks)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(b.schema.get_field_index("ids"))[k].values,
                        b.column(b.schema.get_field_index("labels"))[k].values,
                        pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()),
                        pa.array(dist.sum(0)),
                    ],
                    names=["id", "label", "code", "error"],
                )

    schema = f"id {kinds['ids'][6:-1]}, label {kinds['labels'][6:-1]}, code string, error long"
    used = blocks.select("ids", "labels", "n", "width", "x", *(["home"] if "home" in blocks.columns else []))
    return used.mapInArrow(run, schema).toDF(id_col, label_col, "code", "error")


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code and error of every vector; codebooks by part, entry and
    position).  ``entries`` is at most 256."""
    blocks = materialize(_blocks(vectors, id_col, vec_col, label_col, entries))
    codebooks, blocks = fit(blocks, parts, entries, rounds)
    return encode(blocks, codebooks, id_col, label_col), codebooks


def coded_with_totals(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector."""
    coded, codebooks = compress(vectors.select("vec_id", "embedding", "label"), **options)
    coded = materialize(coded)
    totals = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 8) -> str:
    """DuckDB text of the same codes, by all distances."""
    span = range(width)
    dist = " + ".join(f"(d{i} - e{i}) * (d{i} - e{i})" for i in span)
    out = [
        f"k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, {', '.join(f'q[p * {width} + {i + 1}] AS d{i}' for i in span)} FROM k, (SELECT unnest(range({parts})) AS p) ps)",
        f"c0 AS MATERIALIZED (SELECT p, n - 1 AS e, {', '.join(f'd{i} AS e{i}' for i in span)} FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS n FROM parts) r WHERE n <= {entries})",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, parts.p, any_value(label) AS label, {', '.join(f'any_value(d{i}) AS d{i}' for i in span)}, min(({dist}) * 256 + e) AS best FROM parts JOIN c{r} ON parts.p = c{r}.p GROUP BY vec_id, parts.p)")
        if r < rounds:
            floor = lambda i: f"(s{i} - ((s{i} % n) + n) % n) // n"
            out.append(f"s{r} AS (SELECT p, best % 256 AS e, count(*) AS n, {', '.join(f'CAST(sum(d{i}) AS BIGINT) AS s{i}' for i in span)} FROM a{r} GROUP BY p, best % 256)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, {', '.join(f'CASE WHEN n IS NULL THEN e{i} ELSE CAST({floor(i)} AS BIGINT) END AS e{i}' for i in span)} FROM c{r} c LEFT JOIN s{r} s ON c.p = s.p AND c.e = s.e)")
    numbers = " || ',' || ".join(f"CAST(e{i} AS VARCHAR)" for i in span)
    out.append(f"book AS (SELECT sha256(string_agg({numbers}, ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    out.append(f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return (
        "WITH "
        + ",\n".join(out)
        + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book"
    )


@register("op11_ballcodes", oracle())
def op11_ballcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 8 parts, 16 entries each, 6 rounds."""
    return coded_with_totals(read(spark, sf_dir, "embeddings"))
