"""Exact nearest-neighbour search over a table of vectors (VEC-01, JON-14).

One query vector is compiled into the scan (``nearest``). Many queries are broadcast in blocks of a bounded size and compared by matrix
products on Arrow batches, with the k best of each batch kept before anything is shuffled (``nearest_many``)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Query vectors that one broadcast holds; more queries are served block after block.
QUERY_BLOCK = 4096


def _usable(vec_col: str, dim: int) -> Column:
    """Vectors of the dimension without null components; NaN is a distance, after all others."""
    v = F.col(vec_col)
    return (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull())


def nearest(vecs: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", keep: Sequence[str] = (), where: Column | None = None, threshold: float | None = None, rounded: bool = True) -> DataFrame:
    """(id, keep, distance) of the k nearest, ties to the smaller id. Rows are ranked by the distance itself, which the result gives to six places unless
    ``rounded`` is false. ``where`` filters before ranking (D5); ``threshold`` is a least similarity 1 - distance (D9; a largest distance for l2). Rows of
    another dimension, null vectors and vectors with a null component take no part (VEC-18)."""
    if any(x is None for x in query):
        raise ValueError("the query vector has a null component")
    rows = vecs.where(_usable(vec_col, len(query)))
    rows = rows.where(where) if where is not None else rows
    rows = rows.select(id_col, *keep, V.metric(metric)(F.col(vec_col), query).alias("distance"))
    if threshold is not None:
        rows = rows.where(F.col("distance") <= threshold if metric == "l2" else 1 - F.col("distance") >= threshold)
    best = rows.orderBy("distance", id_col).limit(k)
    return best.withColumn("distance", F.round("distance", 6) + F.lit(0.0)) if rounded else best


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows; equal vectors have equal ones, wherever they stand."""
    if metric == "l2":
        return ((q - x) ** 2).sum(axis=1)
    dot = (q * x).sum(axis=1)
    if metric == "dot":
        return 1 - dot
    n = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1))
    return np.where(n == 0, 1.0, 1 - dot / np.where(n == 0, 1, n))


def _block(queries, metric: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        squares = (q * q).sum(axis=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                b = whole.slice(at, 8192)
                flat = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64)
                x = np.ascontiguousarray(flat.reshape(b.num_rows, q.shape[1]))
                products, own = q @ x.T, (x * x).sum(axis=1)
                if metric == "l2":
                    d, size = squares[:, None] + own[None, :] - 2 * products, squares[:, None] + own[None, :]
                elif metric == "dot":
                    d, size = 1 - products, 1 + np.sqrt(squares[:, None] * own[None, :])
                else:
                    n = np.sqrt(squares[:, None] * own[None, :])
                    d, size = np.where(n == 0, 1.0, 1 - products / np.where(n == 0, 1, n)), np.ones_like(products)
                # The product's rounding depends on the place in the matrix: all that may be among the k best are computed again, one by one.
                d = np.where(np.isnan(d), np.inf, d)
                kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(q), 1), np.inf)
                line, col = np.nonzero(d <= kth + 1e-9 * np.where(np.isfinite(size), size, 0) + 1e-12)
                for i in range(0, len(line), 100_000):
                    r, c = line[i : i + 100_000], col[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), b.column(0).take(pa.array(c)), pa.array(_exact(q[r], x[c], metric))], ["query_id", "id", "distance"])

    return run


def nearest_many(vecs: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query") -> DataFrame:
    """(query_id, id, distance, rank) for every query vector, of any dimension; a query meets the rows of its own. Queries that are null or hold a null component
    have no rows."""
    V.metric(metric)
    spark = vecs.sparkSession
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).cast("array<double>").alias("v")).where("v IS NOT NULL").where(~F.exists("v", lambda x: x.isNull()))
    asked = asked.orderBy(F.size("v"), "q")
    out, offset = None, 0
    while True:
        got = asked.offset(offset).limit(QUERY_BLOCK).collect()  # a bounded block
        if not got and out is not None:
            break
        for dim in sorted({len(r["v"]) for r in got}) or [0]:
            own = [r for r in got if len(r["v"]) == dim]
            shared = spark.sparkContext.broadcast((np.array([r["q"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64).reshape(len(own), dim)))
            rows = vecs.where(_usable(vec_col, dim)).select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"))
            part = rows.mapInArrow(_block(shared, metric, k), "query_id long, id long, distance double")
            out = part if out is None else out.union(part)
        offset += QUERY_BLOCK
        if len(got) < QUERY_BLOCK:
            break
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), (F.round("distance", 6) + F.lit(0.0)).alias("distance"), "rank")


def recall(found: DataFrame, truth: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """(recall): the share of the true neighbours that were found (AGG-15)."""
    t = truth.select(query_id, id_col).distinct()
    return t.join(found.select(query_id, id_col).distinct().withColumn("hit", F.lit(1)), [query_id, id_col], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
