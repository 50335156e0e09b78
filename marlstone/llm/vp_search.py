"""Operator 10: approximate nearest neighbours with a vantage-point tree per shard.

Shards are regions: the leaves of a vantage-point tree over a bounded sample of ``SAMPLE`` rows, with so many leaves that each takes about ``SHARD`` rows of the table. Every row is
dealt to the region that it falls into; a region that more rows fall into (a vector that a third of all rows repeat) is dealt to several shards by a hash of the row
key. Each shard has a vantage-point tree of all its rows: a node's vantage point is the row, of a few candidates, whose distances to a sample spread
most; the median distance divides the other rows into an inner and an outer half, down to leaves.

A query walks the tree of a shard of its own region first, which gives it a k-th distance t. Then it goes to the shards of those regions only that the triangle inequality allows within
t divided by ``relax``, and walks their trees, the nearer half first, entering a half only if the inequality allows
a row nearer than its k-th distance so far there, divided by ``relax`` again: at relax = 1 the search is exact, above it more regions and halves are
skipped. Queries walk a tree together, as arrays, split at each node by which half they enter first. A shard is sent to one task, through which its queries
stream. The k best of all are the result, with distances computed on the original vectors in double precision.

Every row is indexed. In high dimensions distances lie close together, so pruning sets in only well above 1. The tests hold recall at RELAX against brute force.

Defined results: vectors that are null or zero, or hold null or non-finite components, and rows without id take no part; vectors
of different dimensions are not compared; a row never finds itself but does find rows that repeat it; repeated query rows each give
results; fewer candidates than k give all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from . import common, vectors

TOP, RELAX = 10, 5.0
SHARD, LEAF = 8192, 128
#: Rows that the regions are fitted to, and the least number of them in a region.
SAMPLE, REGION = 16_384, 16
SLACK = 1e-9
#: Rows tried as a node's vantage point, and rows that each is tried on.
TRIED, TRIED_ON = 8, 64

_BUILT = "shard long, dim int, ids binary, rkeys binary, vecs binary, radius binary, inner binary, stop binary"
_FOUND = "qkey long, ckey long, query_id long, vec_id long, score double"


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all q to all x, from differences, so equal vectors have equal distances."""
    out = np.empty((len(q), len(x)))
    step = max(1, 2_000_000 // max(1, x.size))
    for i in range(0, len(q), step):
        out[i : i + step] = np.sqrt(((q[i : i + step, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    return out


class Tree:
    """Nodes in preorder over an order of the rows: a node covers rows [start, stop); its vantage point is its first row, the inner half
    is [start + 1, inner) and the outer half [inner, stop). Leaves have inner = -1. Arrays are indexed by start."""

    def __init__(self, x: np.ndarray, radius: np.ndarray, inner: np.ndarray, stop: np.ndarray):
        self.x, self.radius, self.inner, self.stop = x, radius, inner, stop

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF, seed: int = 5) -> tuple[Tree, np.ndarray]:
        """The tree and the order of the rows in it."""
        rng = np.random.default_rng(seed)
        n = len(x)
        order = np.arange(n)
        radius, inner, stop = np.zeros(n), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        todo = [(0, n)]
        while todo:
            a, b = todo.pop()
            if a >= b:
                continue
            stop[a] = b
            if b - a <= leaf:
                continue
            rows = order[a:b]
            tried = rng.choice(b - a, min(TRIED, b - a), replace=False)
            on = rng.choice(b - a, min(TRIED_ON, b - a), replace=False)
            best = tried[distances(x[rows[tried]], x[rows[on]]).var(axis=1).argmax()]
            rows[[0, best]] = rows[[best, 0]]
            d = distances(x[rows[:1]], x[rows[1:]])[0]
            half = (b - a - 1) // 2
            near = np.argsort(d, kind="stable")
            order[a + 1 : b] = rows[1:][near]
            radius[a] = d[near[half - 1]] if half else 0.0
            # Rows at the radius itself may lie in both halves, which the bounds allow for.
            inner[a] = a + 1 + half
            todo += [(a + 1, a + 1 + half), (a + 1 + half, b)]
        return cls(x[order], radius, inner, stop), order

    def search(self, q: np.ndarray, own: np.ndarray, k: int, relax: float, ids: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, distances, distances computed) of the k nearest; own: each query's row here, or -1; ties go to the smaller of ids; bound: distances beyond which
        nothing is wanted."""
        bound = np.full(len(q), np.inf) if bound is None else bound
        dist = np.full((len(q), k), np.inf)
        row = np.full((len(q), k), -1, np.int64)
        spent = 0

        def offer(who: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
            d = np.where(rows[None, :] == own[who][:, None], np.inf, d)
            use = (d <= dist[who, -1:]).any(axis=1)
            who, d = who[use], d[use]
            if not len(who):
                return
            all_d = np.concatenate([dist[who], d], axis=1)
            all_r = np.concatenate([row[who], np.broadcast_to(rows, d.shape)], axis=1)
            all_r = np.where(np.isinf(all_d), -1, all_r)
            pick = np.lexsort((np.where(all_r < 0, np.iinfo(np.int64).max, ids[all_r]), all_d), axis=1)[:, :k]
            lines = np.arange(len(who))[:, None]
            dist[who], row[who] = all_d[lines, pick], all_r[lines, pick]

        def walk(a: int, who: np.ndarray) -> None:
            nonlocal spent
            if a >= len(self.stop) or not len(who):
                return
            b, mid = self.stop[a], self.inner[a]
            if mid < 0:
                rows = np.arange(a, b)
                spent += len(who) * len(rows)
                offer(who, rows, distances(q[who], self.x[rows]))
                return
            d = distances(q[who], self.x[a : a + 1])
            spent += len(who)
            offer(who, np.array([a]), d)
            d = d[:, 0] - self.radius[a]
            inside = d <= 0
            walk(a + 1, who[inside])
            walk(mid, who[~inside])
            t = np.minimum(dist[who, -1], bound[who]) / relax
            # Strictly beyond the bound there is nothing better; at the bound there may be a tie.
            if mid < b:
                walk(mid, who[inside & (-d <= t)])
            walk(a + 1, who[~inside & (d <= t)])

        walk(0, np.arange(len(q)))
        return row, dist, spent


class Regions:
    """The top tree: node i has a vantage point, a radius and two children, nodes (0 and up) or regions (-1 - number)."""

    def __init__(self, x: np.ndarray, rows: int):
        """``rows``: how many the table has for the sample x of it."""
        regions = max(1, min(-(-rows // SHARD), len(x) // REGION))
        tree, _ = Tree.build(x, max(REGION, -(-len(x) // regions)))
        self.points, self.radius, self.children, self.count = [], [], [], 0
        todo = [(0, len(x), None)]
        while todo:
            a, b, parent = todo.pop()
            leaf = a >= b or tree.inner[a] < 0
            number = -1 - self.count if leaf else len(self.points)
            if parent is not None:
                self.children[parent[0]][parent[1]] = number
            if leaf:
                self.count += 1
                continue
            self.points.append(tree.x[a])
            self.radius.append(tree.radius[a])
            self.children.append([0, 0])
            todo += [(a + 1, tree.inner[a], (number, 0)), (tree.inner[a], b, (number, 1))]
        self.points = np.array(self.points).reshape(-1, x.shape[1])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The region of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0 if len(self.points) else -1, np.arange(len(x)))]
        while todo:
            node, who = todo.pop()
            if node < 0:
                out[who] = -1 - node
                continue
            inside = distances(x[who], self.points[node : node + 1])[:, 0] <= self.radius[node]
            todo += [(self.children[node][0], who[inside]), (self.children[node][1], who[~inside])]
        return out

    def reached(self, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, region) for all regions that may hold a row within t of a query."""
        rows, regions = [], []
        t = t * (1 + SLACK) + SLACK
        todo = [(0 if len(self.points) else -1, np.arange(len(q)))]
        while todo:
            node, who = todo.pop()
            if node < 0:
                rows.append(who)
                regions.append(np.full(len(who), -1 - node))
                continue
            d = distances(q[who], self.points[node : node + 1])[:, 0] - self.radius[node]
            todo += [(self.children[node][0], who[d <= t[who]]), (self.children[node][1], who[-d <= t[who]])]
        return np.concatenate(rows), np.concatenate(regions)


def _home_batches(tops):
    """Rows with their region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            for dim, rows in pdf.groupby("dim"):
                yield pa.RecordBatch.from_pandas(rows.assign(region=tops.value[int(dim)].home(vectors.matrix(rows["vec"], dim))), preserve_index=False)

    return run


def _reached_batches(tops, relax: float):
    """Queries with their k-th distance to one row for each region in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            for dim, rows in pdf.groupby("dim"):
                row, region = tops.value[int(dim)].reached(vectors.matrix(rows["vec"], dim), rows["t"].to_numpy() / relax)
                for i in range(0, len(row), 8192):
                    part = rows.iloc[row[i : i + 8192]].assign(region=region[i : i + 8192])
                    yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    return run


def _build_shard(leaf: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        rows = rows.sort_values("rkey", kind="stable")
        tree, order = Tree.build(vectors.matrix(rows["vec"], dim), leaf)
        one = {
            "shard": int(rows["shard"].iloc[0]), "dim": dim, "ids": rows["vec_id"].to_numpy()[order].tobytes(), "rkeys": rows["rkey"].to_numpy()[order].tobytes(),
            "vecs": tree.x.astype("<f8").tobytes(), "radius": tree.radius.tobytes(), "inner": tree.inner.tobytes(), "stop": tree.stop.tobytes(),
        }
        return pd.DataFrame([one])

    return run


def _search_shard(k: int, relax: float):
    def run(s: pd.Series, asked: pd.DataFrame) -> pd.DataFrame:
        dim = int(s["dim"])
        tree = Tree(vectors.matrix([s["vecs"]], dim), np.frombuffer(s["radius"], "<f8"), np.frombuffer(s["inner"], "<i8"), np.frombuffer(s["stop"], "<i8"))
        ids, rkeys = np.frombuffer(s["ids"], "<i8"), np.frombuffer(s["rkeys"], "<i8")
        qkeys = asked["qkey"].to_numpy()
        by = np.argsort(rkeys)
        at = by[np.minimum(np.searchsorted(rkeys, qkeys, sorter=by), len(by) - 1)]
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((rkeys, ids))] = np.arange(len(ids))
        row, dist, _ = tree.search(vectors.matrix(asked["vec"], dim), np.where(rkeys[at] == qkeys, at, -1), k, relax, rank, asked["t"].to_numpy())
        n, m = np.nonzero(row >= 0)
        r = row[n, m]
        return pd.DataFrame({"qkey": qkeys[n], "ckey": rkeys[r], "query_id": asked["query_id"].to_numpy()[n], "vec_id": ids[r], "score": dist[n, m]})

    return run


def nearest(vecs: DataFrame, asked: Column, k: int = TOP, relax: float = RELAX, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asked`` holds, the k nearest other rows found."""
    spark = vecs.sparkSession
    rows = vectors.valid_vectors(vecs, asked, id_col, vec_col, drop_zero=True)
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sample = rows.orderBy(F.xxhash64("rkey"), "rkey").limit(SAMPLE).select("dim", "vec").toArrow()
    # A dimension that the sample misses is one region.
    points = {d: vectors.matrix(sample.filter(pc.field("dim") == d)["vec"].to_pylist(), d) if d else np.zeros((0, 0)) for d in counts}
    tops = spark.sparkContext.broadcast({d: Regions(points[d], n * SHARD // shard_rows) for d, n in counts.items()})
    placed, _ = common.written(rows.mapInArrow(_home_batches(tops), "vec_id long, asked boolean, dim int, vec binary, rkey long, region long"))
    # At most one row for each region: their number is bounded by the sample.
    parts = placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("parts"))
    place = (F.col("dim").cast("long") * (1 << 20) + F.col("region")) * (1 << 24)
    parts = F.broadcast(parts.select(place.alias("base"), "parts"))
    dealt = placed.join(parts, place == F.col("base")).withColumn("shard", F.col("base") + F.pmod(F.xxhash64("rkey"), F.col("parts")))
    index, _ = common.written(dealt.groupBy("shard").applyInPandas(_build_shard(LEAF), _BUILT))
    queries = dealt.where("asked").select("shard", F.col("rkey").alias("qkey"), F.col("vec_id").alias("query_id"), "dim", "vec")
    first, _ = common.written(vectors.met(index, queries.withColumn("t", F.lit(float("inf"))), "shard", _search_shard(k, relax), _FOUND))
    kth = first.groupBy("qkey").agg(F.max("score").alias("far"), F.count("*").alias("n")).select(F.col("qkey").alias("t_qkey"), F.when(F.col("n") >= k, F.col("far")).alias("far"))
    known = queries.join(kth, F.col("qkey") == F.col("t_qkey"), "left").withColumn("t", F.coalesce("far", F.lit(float("inf")))).select("shard", "qkey", "query_id", "dim", "vec", "t")
    reach = known.withColumnRenamed("shard", "own").mapInArrow(_reached_batches(tops, relax), "own long, qkey long, query_id long, dim int, vec binary, t double, region long")
    others = reach.join(parts, place == F.col("base")).select("own", "qkey", "query_id", "dim", "vec", "t", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    others = others.withColumn("shard", F.col("base") + F.col("part")).where(F.col("shard") != F.col("own")).select("shard", "qkey", "query_id", "dim", "vec", "t")
    found = vectors.met(index, others, "shard", _search_shard(k, relax), _FOUND)
    return vectors.best(first.unionByName(found), k, [F.col("score")])


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
