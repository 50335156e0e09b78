"""Tables that grow by segments: inserts, deletes, merges, search over hot and cold segments, index kinds by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import ann, knn


def insert(rows: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """VEC-17: ``new`` (without ids) appended as one more segment; ids continue above the largest one. They grow but need not be dense, so
    no task counts the rows of another; the numbered rows are written first, so a task that runs again gives the same ids. One row of statistics is broadcast."""
    last = rows.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("__last"), F.coalesce(F.max("segment_id"), F.lit(-1)).alias("__segment"))
    dealt = written(new.withColumn("__n", F.monotonically_increasing_id())).join(F.broadcast(last))
    added = dealt.withColumn(id_col, F.col("__last") + 1 + F.col("__n")).withColumn("segment_id", F.col("__segment") + 1)
    return rows.unionByName(added.drop("__last", "__segment", "__n"))


def deleted(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """VEC-19, D22: rows whose external key is deleted leave before any ranking, so none takes a place in a top-k."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def merged(rows: DataFrame, target_rows: int, most: int) -> DataFrame:
    """SET-03, FTS-10: the rows with the segments that are due for a merge as one new segment. Only the list of segments is broadcast."""
    sizes = rows.groupBy("segment_id").agg(F.count("*").alias("n_rows"))
    chosen = ann.merge_candidates(sizes, target_rows, most).select("segment_id", F.lit(True).alias("__due"))
    last = sizes.agg(F.max("segment_id").alias("__last"))
    out = rows.join(F.broadcast(chosen), "segment_id", "left").join(F.broadcast(last))
    return out.withColumn("segment_id", F.when(F.col("__due"), F.col("__last") + 1).otherwise(F.col("segment_id"))).drop("__due", "__last").select(rows.columns)


def planned_search(vecs: DataFrame, query: Sequence[float], k: int = 10, least_hot: int = 0, hot_ms: Sequence[float] = (), cold_ms: Sequence[float] = (), **options) -> tuple[DataFrame, bool]:
    """VEC-28, OPT-04: (hits, whether cold segments were searched). Column ``hot`` marks the rows of hot segments.

    The hot ones are searched first. If they give fewer than ``k`` or ``least_hot`` rows, the cold ones fill the missing places, unless
    k were found and the past latencies (milliseconds, ten cold ones at least) say that cold searches cost over five times as much."""
    k = k if k > 0 else 10
    hot = knn.nearest(vecs.where("hot"), query, k, **options)
    n = hot.count()
    mean = lambda xs: sum(xs) / len(xs)
    dear = n >= k and len(cold_ms) >= 10 and len(hot_ms) > 0 and mean(cold_ms) > 5 * max(mean(hot_ms), 1e-6)
    if n >= max(k, least_hot) or dear:
        return hot, False
    cold = knn.nearest(vecs.where("NOT hot"), query, max(k - n, 1), **options)
    return hot.unionByName(cold).orderBy("distance", options.get("id_col", "vec_id")).limit(k), True


def in_bucket(vecs: DataFrame, bucket: str, query: Sequence[float], k: int = 10, **options) -> DataFrame:
    """UDF-08: a plugin's search sees the rows of one bucket only; the filter reaches the scan."""
    return knn.nearest(vecs.where(F.col("bucket") == bucket), query, k, **options)


def _flat(vecs, query, k, **params):
    return knn.nearest(vecs, query, k, **params)


def _graph(vecs, query, k, id_col="vec_id", vec_col="embedding", **params):
    return ann.graph_search(written(ann.graph_index(vecs, id_col=id_col, vec_col=vec_col, **params)), query, k, id_col)


#: VEC-23: index kinds by their names.
INDEX_KINDS = {"FLAT": _flat, "AUTO": _flat, "HNSW": _graph, "DISKANN": _graph}


def search(vecs: DataFrame, query: Sequence[float], k: int = 10, kind: str = "AUTO", **params) -> DataFrame:
    """The k nearest rows by the index kind of that name; lists of centroids are built apart (``ann.assign``, ``ann.probe``)."""
    if kind.upper() not in INDEX_KINDS:
        raise ValueError(f"unknown index kind {kind}; known are {sorted(INDEX_KINDS)}")
    return INDEX_KINDS[kind.upper()](vecs, query, k, **params)


def centroid_means(members: DataFrame, old: DataFrame, cluster: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    """(cluster, dim, mean): AGG-25. The mean of each cluster's members by dimension; a cluster without members keeps ``old``'s value.
    Sums are partial per task, so a cluster with a third of all rows sends one row of each task for each dimension."""
    parts = members.select(cluster, F.posexplode(vec_col).alias("dim", "x")).groupBy(cluster, "dim").agg(F.avg(F.col("x").cast("double")).alias("new"))
    before = old.select(cluster, F.posexplode(vec_col).alias("dim", "x"))
    return before.join(parts, [cluster, "dim"], "left").select(cluster, "dim", F.coalesce("new", F.col("x").cast("double")).alias("mean"))
