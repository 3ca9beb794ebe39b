"""Exact k-nearest-neighbour join (inventory E0) and kNN classification (F2).

By default the join searches pivot cells (:mod:`raresift.operators.pivot_knn`).
The plain grid below is the other way, with the same rows.  Comparing every pair costs n_queries x n_refs distance evaluations whatever the layout;
what the layout decides is memory, parallelism and how many rows move.  The
join is blocked on a grid:

- queries are hashed into ``Qb`` blocks and refs into ``Rb`` blocks (block
  counts from the table sizes, so a cell holds at most ~``block_rows`` rows a
  side); each query row is replicated to the ``Rb`` cells of its row of the
  grid and each ref row to the ``Qb`` cells of its column;
- each cell is one ``cogroup().applyInPandas`` call: numpy computes the
  distances for chunks of queries and keeps only the k best refs per query --
  never all pairs as rows;
- the per-cell top-k lists are merged with a window partitioned by query id
  (``k * Rb`` rows per query).

No group ever holds a whole table; blocks are by id hash, so a hot label or
feature value cannot skew them.  Ties are broken by ref id; distances are
rounded to ``DIST_DIGITS`` before ranking so engines that add in a different
order still rank the same way.  Approximate search for very large tables:
``approx_knn_join`` (``BucketedRandomProjectionLSH``), labelled approximate.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift.functions.missing import required_number, required_numbers
from raresift.operators.pivot_knn import pivot_knn_join
from raresift.session import materialize

DIST_DIGITS = 9
METRICS = ("euclidean", "manhattan")
METHODS = ("pivots", "grid")


def packed(df: DataFrame, features: Sequence[str] | str) -> Column:
    """The feature vector as ``array<double>`` (one array column, or many scalar
    columns).  A missing feature raises: there is no distance to such a row."""
    if isinstance(features, str):
        return required_numbers(F.col(features).cast("array<double>"), f"a feature in {features}")
    return F.array(*[required_number(F.col(c), f"feature {c}") for c in features])


def _cell_topk(k: int, metric: str, exclude_self: bool, extra: list[str], chunk_bytes: int = 64 << 20):
    def fn(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "rid", "distance", *extra]
        if q.empty or r.empty:
            return pd.DataFrame({c: [] for c in cols})
        r = r.sort_values("rid", kind="stable").reset_index(drop=True)
        R = np.stack(r["rx"].to_numpy()).astype(np.float64)
        rid = r["rid"].to_numpy()
        Q = np.stack(q["qx"].to_numpy()).astype(np.float64)
        qid = q["qid"].to_numpy()
        n_r, d = R.shape
        step = max(1, int(chunk_bytes // max(1, n_r * 8)))
        kk = min(k, n_r)
        out_q, out_r, out_d = [], [], []
        for s in range(0, len(Q), step):
            Qc = Q[s : s + step]
            # accumulate over dimensions in order (same summation order as
            # an SQL sum of per-dimension terms), one 2-d array at a time
            D = np.zeros((len(Qc), n_r))
            for j in range(d):
                t = Qc[:, j, None] - R[None, :, j]
                D += t * t if metric == "euclidean" else np.abs(t)
            if metric == "euclidean":
                np.sqrt(D, out=D)
            if exclude_self:
                D[qid[s : s + step, None] == rid[None, :]] = np.inf
            # k-th smallest per row; every entry that can round to <= it is a
            # candidate (more than k only with ties).  Only candidates are
            # rounded; np.nonzero yields them by row and, refs being sorted, by
            # ref id, so lexsort (row, rounded distance, id) is the exact order.
            kth = np.partition(D, kk - 1, axis=1)[:, kk - 1 : kk]
            rows, cols = np.nonzero((D <= kth + 10.0 ** -DIST_DIGITS) & np.isfinite(D))
            dv = np.round(D[rows, cols], DIST_DIGITS)
            o = np.lexsort((cols, dv, rows))
            rows, cols, dv = rows[o], cols[o], dv[o]
            first = np.searchsorted(rows, rows, side="left")
            take = (np.arange(len(rows)) - first) < kk
            out_q.append(qid[s : s + step][rows[take]])
            out_r.append(cols[take])
            out_d.append(dv[take])
        ridx = np.concatenate(out_r)
        res = pd.DataFrame({"qid": np.concatenate(out_q), "rid": rid[ridx], "distance": np.concatenate(out_d)})
        for c in extra:
            res[c] = r[c].to_numpy()[ridx]
        return res

    return fn


def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int = 5,
    features: Sequence[str] | str = "x",
    id_col: str = "row_id",
    metric: str = "euclidean",
    exclude_self: bool = True,
    ref_cols: Sequence[str] = (),
    block_rows: int | None = None,
    sizes: tuple[int, int] | None = None,
    max_queries_per_cell: int = 65_536,
    max_refs_per_cell: int = 262_144,
    method: str = "pivots",
    counter=None,
) -> DataFrame:
    """(query_id, ref_id, rank, distance, ref_cols...): for every query row its
    k nearest ref rows (rank 1..k), the query itself excluded when
    ``exclude_self`` (same id), ties by ref id.

    ``method="pivots"`` searches pivot cells and skips what the triangle
    inequality rules out (:mod:`raresift.operators.pivot_knn`); ``"grid"``
    compares every pair.  Both give the same rows.  ``counter`` (an accumulator)
    is told how many distances the pivot search took.

    Grid shape: each cell holds at most ``max_queries_per_cell`` queries and
    ``max_refs_per_cell`` refs (memory bound per task); within that, ref
    blocks are added until there are about 4 cells per core, so small inputs
    still use every core.  ``block_rows`` forces square blocks (tests);
    ``sizes`` gives (queries, refs) when the caller knows them.  There is one
    partition per cell, so partitions stay bounded however large the tables."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    q = queries.select(F.col(id_col).cast("long").alias("qid"), packed(queries, features).alias("qx"))
    r = refs.select(F.col(id_col).cast("long").alias("rid"), packed(refs, features).alias("rx"), *ref_cols)
    if sizes is None:  # both sizes in one job (scalars; they decide the grid)
        counted = q.select(F.lit(0).alias("_s")).unionByName(r.select(F.lit(1).alias("_s"))).groupBy("_s").count().collect()
        size = {row["_s"]: row["count"] for row in counted}
        sizes = size.get(0, 0), size.get(1, 0)
    n_q, n_r = sizes
    if method == "pivots" and not block_rows:
        found = pivot_knn_join(q, r, k, metric, exclude_self, list(ref_cols), n_q, n_r, max_queries_per_cell, max_refs_per_cell, counter)
        return _ranked(found, k, ref_cols)
    parallel = queries.sparkSession.sparkContext.defaultParallelism
    if block_rows:
        qb = max(1, math.ceil(n_q / block_rows))
        rb = max(1, math.ceil(n_r / block_rows))
    else:
        qb = max(1, math.ceil(n_q / max_queries_per_cell))
        rb = max(1, math.ceil(n_r / max_refs_per_cell))
        # more ref blocks (replicating the queries, the smaller side in the
        # samplers) until the grid keeps every core busy; never below ~1k refs a cell
        want = max(1, math.ceil(4 * parallel / qb))
        rb = max(rb, min(want, max(1, n_r // 1024)))
    q_rep = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int")).withColumn(
        "rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1)))
    )
    r_rep = r.withColumn("rb", F.pmod(F.xxhash64("rid"), F.lit(rb)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))
    )
    extra_fields = [f for f in refs.select(*ref_cols).schema.fields] if ref_cols else []
    schema = T.StructType(
        [
            T.StructField("qid", T.LongType()),
            T.StructField("rid", T.LongType()),
            T.StructField("distance", T.DoubleType()),
            *extra_fields,
        ]
    )
    # explicit, equal partitioning of both sides on the cell key: the cogroup
    # needs no further exchange, and AQE keeps the user-given partition count
    # instead of coalescing the (small but CPU-heavy) cells into one task
    n_part = max(1, qb * rb)
    q_rep = q_rep.repartition(n_part, "qb", "rb")
    r_rep = r_rep.repartition(n_part, "qb", "rb")
    cells = (
        q_rep.groupBy("qb", "rb")
        .cogroup(r_rep.groupBy("qb", "rb"))
        .applyInPandas(_cell_topk(k, metric, exclude_self, list(ref_cols)), schema)
    )
    return _ranked(cells, k, ref_cols)


def _ranked(found: DataFrame, k: int, ref_cols: Sequence[str]) -> DataFrame:
    """The k nearest of each query's lists, numbered."""
    w = Window.partitionBy("qid").orderBy(F.col("distance").asc(), F.col("rid").asc())
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(
        F.col("qid").alias("query_id"), F.col("rid").alias("ref_id"), "rank", "distance", *ref_cols
    )


def knn_classify(
    queries: DataFrame,
    refs: DataFrame,
    k: int = 5,
    features: Sequence[str] | str = "x",
    label_col: str = "Class",
    id_col: str = "row_id",
    metric: str = "euclidean",
    exclude_self: bool = True,
) -> DataFrame:
    """(row_id, score, prediction): score = share of positives among the k
    nearest refs (uniform weights); prediction = score > 0.5 (F2)."""
    scores = knn_scores(queries, refs, [k], features, label_col, id_col, metric, exclude_self)
    return scores.select(id_col, F.col(f"score_{k}").alias("score"), (F.col(f"score_{k}") > 0.5).cast("int").alias("prediction"))


def knn_scores(
    queries: DataFrame,
    refs: DataFrame,
    ks: Sequence[int],
    features: Sequence[str] | str = "x",
    label_col: str = "Class",
    id_col: str = "row_id",
    metric: str = "euclidean",
    exclude_self: bool = True,
) -> DataFrame:
    """(row_id, score_<k>...): the share of positives among the k nearest refs for
    every k of ``ks``, from one search as far as the largest (the first k of its
    ranks are the k nearest)."""
    nb = knn_join(queries, refs, max(ks), features, id_col, metric, exclude_self, ref_cols=[label_col])
    # queries without refs within reach keep no row; callers left-join
    positive = (F.col(label_col) == 1).cast("double")
    agg = nb.groupBy("query_id").agg(*[F.avg(F.when(F.col("rank") <= k, positive)).alias(f"score_{k}") for k in sorted(set(ks))])
    return agg.withColumnRenamed("query_id", id_col)


def approx_knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int = 5,
    features: Sequence[str] | str = "x",
    id_col: str = "row_id",
    bucket_length: float = 1.0,
    num_hash_tables: int = 3,
    max_distance: float | None = None,
    seed: int = 42,
    ref_cols: Sequence[str] = (),
    exclude_self: bool = True,
) -> DataFrame:
    """APPROXIMATE k nearest (Euclidean) with random-projection LSH: pairs are
    only compared inside shared buckets, so some true neighbours can be
    missed and a query may get fewer than k.  Only pairs within
    ``max_distance`` leave the join (default: two buckets, beyond which sharing
    one says little).  Opt-in for tables where the exact grid is too costly
    (same output columns as :func:`knn_join`)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    qv = queries.select(F.col(id_col).alias("qid"), array_to_vector(packed(queries, features)).alias("v"))
    rv = refs.select(F.col(id_col).alias("rid"), array_to_vector(packed(refs, features)).alias("v"), *ref_cols)
    lsh = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=num_hash_tables, seed=seed
    ).fit(rv)
    reach = 2.0 * bucket_length if max_distance is None else float(max_distance)
    pairs = lsh.approxSimilarityJoin(qv, rv, reach, distCol="distance").select(
        F.col("datasetA.qid").alias("qid"), F.col("datasetB.rid").alias("rid"),
        F.round("distance", DIST_DIGITS).alias("distance"), *[F.col(f"datasetB.{c}").alias(c) for c in ref_cols]
    )
    if exclude_self:
        pairs = pairs.where(F.col("qid") != F.col("rid"))
    w = Window.partitionBy("qid").orderBy("distance", "rid")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("qid").alias("query_id"), F.col("rid").alias("ref_id"), "rank", "distance", *ref_cols
    )


# ---------------------------------------------------------------- pyspark.ml wrapper

from pyspark.ml import Estimator, Model  # noqa: E402
from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: E402
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters  # noqa: E402
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter  # noqa: E402


class _KNNParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    metric = Param(Params._dummy(), "metric", "euclidean | manhattan", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique row id column", TypeConverters.toString)


class _KNNWriter(MLWriter):
    """Parameters as Spark ML metadata, reference rows as Parquet beside them."""

    def __init__(self, model: "KNNModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.refs.write.parquet(f"{path.rstrip('/')}/refs")


class _KNNReader(MLReader):
    def load(self, path: str) -> "KNNModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KNNModel(self.sparkSession.read.parquet(f"{path.rstrip('/')}/refs"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Searches:
    """Scores shared by models over the same refs: one search a metric for each
    table asked, as far as the largest k."""

    def __init__(self, ks: dict[str, set[int]]):
        self.ks, self.lock, self.slots = ks, threading.Lock(), []

    def scores(self, df: DataFrame, metric: str, run) -> DataFrame:
        """The scores of ``df`` (the same object for all who share): ``run(ks)``
        by whoever asks first."""
        with self.lock:
            slot = next((x for x in self.slots if x["df"] is df and x["metric"] == metric), None)
            if slot is None:
                slot = {"df": df, "metric": metric, "lock": threading.Lock(), "scores": None}
                self.slots.append(slot)
        with slot["lock"]:
            if slot["scores"] is None:
                slot["scores"] = run(sorted(self.ks[metric]))
            return slot["scores"]


class KNNModel(Model, _KNNParams, MLWritable, MLReadable):
    """Scores rows against the stored reference rows with :func:`knn_join`;
    adds ``probability`` (2-vector), ``rawPrediction`` and ``prediction``.
    A reference row is a neighbour like any other, also of itself, as in the
    usual predict on training rows."""

    def __init__(self, refs: DataFrame | None = None):
        super().__init__()
        self.refs = refs
        self.searches: _Searches | None = None

    def write(self) -> MLWriter:
        return _KNNWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KNNReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        idc, fc, lc = self.getOrDefault(self.idCol), self.getFeaturesCol(), self.getLabelCol()
        k, metric = self.getOrDefault(self.k), self.getOrDefault(self.metric)

        def run(ks):
            # the search reads the queries several times and callers read the scores
            # again: whatever made the rows (other models' joins, too) runs once
            q = materialize(df.select(F.col(idc), vector_to_array(F.col(fc)).alias("_x")))
            return materialize(knn_scores(q, self.refs, ks, "_x", "_y", idc, metric, exclude_self=False))

        shared = self.searches if self.searches and k in self.searches.ks.get(metric, ()) else None
        scores = shared.scores(df, metric, run) if shared else run([k])
        scores = scores.select(idc, F.col(f"score_{k}").alias("_p1"))
        out = df.join(scores, idc, "left")
        p1 = F.coalesce(F.col("_p1"), F.lit(0.0))
        return (
            out.withColumn("probability", array_to_vector(F.array(1 - p1, p1)))
            .withColumn("rawPrediction", array_to_vector(F.array(1 - p1, p1)))
            .withColumn(self.getPredictionCol(), (p1 > 0.5).cast("double"))
            .drop("_p1")
        )


class KNNClassifier(Estimator, _KNNParams):
    """F2 as an Estimator: ``fit`` keeps the (checkpointed) reference rows,
    ``transform`` runs the exact blocked k-nearest join.  Usable inside
    ``CrossValidator`` with the reference's search space (k, metric)."""

    def __init__(self, k: int = 5, metric: str = "euclidean", idCol: str = "row_id", featuresCol: str = "features",
                 labelCol: str = "Class", predictionCol: str = "prediction"):
        super().__init__()
        self._set(k=k, metric=metric, idCol=idCol, featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)

    def _refs(self, df: DataFrame) -> DataFrame:
        return materialize(df.select(
            F.col(self.getOrDefault(self.idCol)),
            vector_to_array(F.col(self.getFeaturesCol())).alias("_x"),
            F.col(self.getLabelCol()).cast("int").alias("_y"),
        ))

    def _model(self, refs: DataFrame) -> KNNModel:
        model = KNNModel(refs)
        model._set(**{p.name: self.getOrDefault(p) for p in (self.k, self.metric, self.idCol, self.featuresCol, self.labelCol, self.predictionCol)})
        return model

    def _fit(self, df: DataFrame) -> KNNModel:
        return self._model(self._refs(df))

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        """Points that differ in k and metric share the reference rows, and those
        of one metric their searches."""
        if any(p not in (self.k, self.metric) for m in paramMaps for p in m):
            return super().fitMultiple(dataset, paramMaps)
        refs, ks = self._refs(dataset), {}
        models = [self.copy(m)._model(refs) for m in paramMaps]
        for m in models:
            ks.setdefault(m.getOrDefault(m.metric), set()).add(m.getOrDefault(m.k))
        searches = _Searches(ks)
        for m in models:
            m.searches = searches
        return iter(enumerate(models))
