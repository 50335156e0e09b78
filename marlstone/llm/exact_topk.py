"""Operator 1: exact top-k by inner product over a pivot-distance index.

Components x become floor(256 x). Largest inner product is made a nearest-neighbour search by one more coordinate,
sqrt(M - |c|^2) for a candidate c (M the largest squared norm) and 0 for a query, so that
|q - c|^2 = |q|^2 + M - 2 <q, c> and the triangle inequality holds.

Index: each vector is keyed by its nearest pivot and its distance to it and the table is range-sorted by that key, so
a block of up to ``BLOCK`` rows is a run of annuli, each of up to ``ANNULUS`` rows of one pivot. (Range sorting also spreads a hot pivot or a
vector that a third of all rows repeat.) Pivots come from a bounded sample of ``PIVOT_SAMPLE`` rows; every row is indexed.

Search: a query begins in the block where its own key lies, which gives it a first k-th distance t. Since
|d(q, p) - d(c, p)| <= d(q, c), only blocks with a pivot whose distances there come within t of d(q, p) can hold more. Those ranges are looked up in order
of their distances, from a broadcast of up to ``RINGS`` of them and beyond that by an equi-join on the pivot; there are about as many pivots as the root of
the number of rows. A query's vector goes once to each block in its reach, and a block goes to one task, through which its queries stream. Within a block, annuli are
expanded outwards from the query's own distances and stop at the same bound, with t shrinking as
results come. Scores are inner products of whole numbers, so they are exact (in Python's integers where doubles
could round; a score beyond a long is given as the nearest long), and bounds have a small slack against rounding.

Defined results: vectors that are null, or hold null or non-finite components, and rows without id take no part; vectors of
different dimensions are not compared; a row never finds itself but does find rows that repeat it, and repeated
query rows each give results; fewer candidates than k give all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from . import common, vectors

SCALE, TOP = 256, 5
BLOCK, ANNULUS = 8192, 256
LEAST_PIVOTS, PIVOTS, PIVOT_SAMPLE = 24, 256, 2048
#: Ranges (28 bytes each: a block, a pivot, two distances) that are broadcast.
RINGS = 1_000_000
SLACK = 1e-6

_FOUND = "qkey long, ckey long, query_id long, vec_id long, score long"


def quantized(a: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * a)


def _pivots(sample: list[tuple[int, bytes]], big: float, most: int) -> dict[int, np.ndarray]:
    """Up to ``most`` vectors per dimension (with the added coordinate), each next one the farthest from those before."""
    out = {}
    for dim in sorted({d for d, _ in sample}):
        x = vectors.matrix([v for d, v in sample if d == dim], dim) if dim else np.zeros((1, 0))
        x = np.column_stack([x, np.sqrt(np.maximum(big - (x * x).sum(axis=1), 0))])
        chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < min(most, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out[dim] = x[chosen]
    return out


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows (their added coordinate in ``extra``) to the pivots."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p[:-1]) ** 2).sum(axis=1) + (extra - p[-1]) ** 2)
    return out


def _key_batches(pivots, big: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            for dim, rows in pdf.groupby("dim"):
                x = vectors.matrix(rows["vec"], dim)
                p = pivots.value.get(dim, np.zeros((1, dim + 1)))
                d = _distances(x, np.sqrt(np.maximum(big - (x * x).sum(axis=1), 0)), p)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_pandas(rows.assign(pivot=near.astype("int32"), dist=d[np.arange(len(d)), near]), preserve_index=False)

    return run


class _Block:
    """Rows in order of (pivot, distance to it), cut into annuli."""

    def __init__(self, dim: int, pivots: np.ndarray, dists: np.ndarray, ids: np.ndarray, rkeys: np.ndarray, x: np.ndarray):
        self.dim, self.pivots, self.dists, self.ids, self.rkeys, self.x = dim, pivots, dists, ids, rkeys, x
        self.segments = np.flatnonzero(np.concatenate([[True], pivots[1:] != pivots[:-1]]))
        stops = np.append(self.segments[1:], len(ids))
        self.starts = np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(self.segments, stops, strict=True)])
        self.stops = np.append(self.starts[1:], len(ids))

    def rings(self) -> list[tuple[int, float, float]]:
        """(pivot, least, greatest distance) of each pivot's rows."""
        stops = np.append(self.segments[1:], len(self.ids)) - 1
        return [(int(self.pivots[a]), float(self.dists[a]), float(self.dists[b])) for a, b in zip(self.segments, stops, strict=True)]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64) if q.shape[1] else np.zeros((len(q), len(x)), np.int64)
    rows, cols = ([[int(v) for v in r] for r in m] for m in (q, x))
    lim = 2**63 - 1
    return np.array([[max(-lim - 1, min(lim, sum(a * b for a, b in zip(r, c, strict=True)))) for c in cols] for r in rows], np.int64).reshape(len(q), len(x))


def _search(block: _Block, q: np.ndarray, away: np.ndarray, qkeys: np.ndarray, t: np.ndarray, big: float, k: int):
    """The best (row, score) of the block for each query: annuli in the order of their distance from the query's own, until
    the nearest one left is beyond the k-th distance. away: the queries' distances to all pivots; t: their k-th distances so far."""
    starts, stops = block.starts, block.stops
    own = away[:, block.pivots[starts]]
    gap = np.maximum(np.maximum(block.dists[starts][None, :] - own, own - block.dists[stops - 1][None, :]), 0)
    order = np.argsort(gap, axis=1, kind="stable")
    norms = (q * q).sum(axis=1)
    none = np.iinfo(np.int64).min
    score = np.full((len(q), k), none)
    row = np.full((len(q), k), -1)
    t = t.copy()
    rank = np.empty(len(block.ids), np.int64)  # ties go to the smaller id, then to the smaller row key
    rank[np.lexsort((block.rkeys, block.ids))] = np.arange(len(block.ids))
    for step in range(len(starts)):
        at = order[:, step]
        live = np.flatnonzero(gap[np.arange(len(q)), at] <= t * (1 + SLACK) + SLACK)
        if not len(live):
            break
        for a in np.unique(at[live]):
            mine = live[at[live] == a]
            cols = np.arange(starts[a], stops[a])
            s = _products(q[mine], block.x[cols])
            own = block.rkeys[cols][None, :] == qkeys[mine][:, None]
            all_s = np.concatenate([score[mine], s], axis=1)
            all_r = np.concatenate([row[mine], np.where(own, -1, cols[None, :])], axis=1)
            ties = np.where(all_r < 0, np.iinfo(np.int64).max, rank[all_r])
            pick = np.lexsort((ties, ~all_s, all_r < 0), axis=1)[:, :k]  # ~ reverses the order and cannot overflow
            lines = np.arange(len(mine))[:, None]
            score[mine], row[mine] = all_s[lines, pick], all_r[lines, pick]
            full = row[mine, k - 1] >= 0
            kth = np.sqrt(np.maximum(norms[mine] + big - 2.0 * score[mine, k - 1], 0))
            t[mine] = np.where(full, np.minimum(t[mine], kth), t[mine])
    return row, score, t


_BUILT = "kind int, block long, dim int, pivot int, lo double, hi double, ids binary, rkeys binary, pivots binary, dists binary, vecs binary, t double, qkey long, ckey long, query_id long, vec_id long, score long"


def _away(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of queries, whose added coordinate is 0, to the pivots."""
    return _distances(q, np.zeros(len(q)), pivots)


def _build(pivots, big: float, k: int):
    """Sorted rows to blocks (kind 0), to their queries with the k-th distance found at home (kind 1), to what they found there (kind 2) and to the ranges of the blocks' pivots (kind 3)."""
    names = [c.split()[0] for c in _BUILT.split(", ")]

    def frame(kind: int, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).assign(kind=kind)

    def close(part: pd.DataFrame, number: int) -> Iterator[pd.DataFrame]:
        dim = int(part["dim"].iloc[0])
        x = vectors.matrix(part["vec"], dim) if dim else np.zeros((len(part), 0))
        block = _Block(dim, part["pivot"].to_numpy(), part["dist"].to_numpy(), part["vec_id"].to_numpy(), part["rkey"].to_numpy(), x)
        yield frame(0, [{"block": number, "dim": dim, "ids": block.ids.tobytes(), "rkeys": block.rkeys.tobytes(), "pivots": block.pivots.astype("<i4").tobytes(), "dists": block.dists.tobytes(), "vecs": x.astype("<f8").tobytes()}])
        yield frame(3, [{"block": number, "dim": dim, "pivot": p, "lo": lo, "hi": hi} for p, lo, hi in block.rings()])
        asked = np.flatnonzero(part["asked"].to_numpy())
        for i in range(0, len(asked), vectors.QUERY_ROWS):
            own = asked[i : i + vectors.QUERY_ROWS]
            away = _away(x[own], pivots.value.get(dim, np.zeros((1, dim + 1))))
            row, score, t = _search(block, x[own], away, block.rkeys[own], np.full(len(own), np.inf), big, k)
            yield frame(1, [{"block": number, "dim": dim, "vecs": x[j].astype("<f8").tobytes(), "t": t[n], "qkey": block.rkeys[j], "query_id": block.ids[j]} for n, j in enumerate(own)])
            yield frame(2, [{"qkey": block.rkeys[own[n]], "query_id": block.ids[own[n]], "ckey": block.rkeys[r], "vec_id": block.ids[r], "score": score[n, m]} for n in range(len(own)) for m, r in enumerate(row[n]) if r >= 0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held):
                same = held["dim"] == held["dim"].iloc[0]
                n = min(int(same.argmin()) if not same.all() else len(held), BLOCK)
                if n == len(held) and n < BLOCK:
                    break  # the next batch may go on with it
                yield from close(held.iloc[:n], number)
                number += 1
                held = held.iloc[n:].reset_index(drop=True)
        if held is not None and len(held):
            yield from close(held, number)

    return run


def _reach_batches(pivots, rings):
    """Queries to one row for each block in their reach. ``rings``: by (dim, pivot) the blocks and, in order of distance, their ranges; None: to one row for each pivot
    with the distance to it, to be joined."""

    def near(dim: int, d: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = []
        for j in range(d.shape[1]):
            blocks, lo, hi = rings.value.get((dim, j), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
            # Both ends of a pivot's ranges ascend, so those in reach are neighbours.
            first, stop = np.searchsorted(hi, d[:, j] - t, side="left"), np.searchsorted(lo, d[:, j] + t, side="right")
            n = np.maximum(stop - first, 0)
            row = np.repeat(np.arange(len(d)), n)
            pairs.append(np.column_stack([row, blocks[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(row))]]))
        both = np.unique(np.concatenate(pairs), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, some in b.to_pandas().groupby("dim"):
                p = pivots.value.get(dim, np.zeros((1, dim + 1)))
                for i in range(0, len(some), 256):
                    rows = some.iloc[i : i + 256]
                    d = _away(vectors.matrix(rows["vecs"], dim) if dim else np.zeros((len(rows), 0)), p)
                    if rings is None:
                        row, at = np.repeat(np.arange(len(rows)), len(p)), np.full(d.size, -1, np.int64)
                        pivot, qd = np.tile(np.arange(len(p), dtype=np.int32), len(rows)), d.ravel()
                    else:
                        row, at = near(int(dim), d, rows["t"].to_numpy() * (1 + SLACK) + SLACK)
                        pivot, qd = np.full(len(row), -1, np.int32), np.zeros(len(row))
                    yield pa.RecordBatch.from_pandas(rows.iloc[row].assign(at=at, pivot=pivot, qd=qd)[["qkey", "query_id", "home", "dim", "vecs", "t", "at", "pivot", "qd"]], preserve_index=False)

    return run


def _expand(pivots, big: float, k: int):
    def run(b: pd.Series, asked: pd.DataFrame) -> pd.DataFrame:
        dim = int(b["dim"])
        ids, rkeys = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["rkeys"], "<i8")
        block = _Block(dim, np.frombuffer(b["pivots"], "<i4"), np.frombuffer(b["dists"], "<f8"), ids, rkeys, vectors.matrix([b["vecs"]], dim) if dim else np.zeros((len(ids), 0)))
        q = vectors.matrix(asked["vecs"], dim) if dim else np.zeros((len(asked), 0))
        row, score, _ = _search(block, q, _away(q, pivots.value.get(dim, np.zeros((1, dim + 1)))), asked["qkey"].to_numpy(), asked["t"].to_numpy(), big, k)
        n, m = np.nonzero(row >= 0)
        r = row[n, m]
        return pd.DataFrame({"qkey": asked["qkey"].to_numpy()[n], "ckey": block.rkeys[r], "query_id": asked["query_id"].to_numpy()[n], "vec_id": block.ids[r], "score": score[n, m]})

    return run


def _ranges(rings: DataFrame, most: int):
    """A broadcast of the ranges by (dim, pivot), or None if there are more than ``most``."""
    got = rings.limit(most + 1).toArrow()
    if got.num_rows > most:
        return None
    pdf = got.to_pandas().sort_values(["dim", "pivot", "lo", "hi"])
    table_ = {(int(d), int(p)): (g["block"].to_numpy(), g["lo"].to_numpy(), np.maximum.accumulate(g["hi"].to_numpy())) for (d, p), g in pdf.groupby(["dim", "pivot"])}
    return rings.sparkSession.sparkContext.broadcast(table_)


def exact_top_k(vecs: DataFrame, asked: Column, k: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", rings_most: int = RINGS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asked`` holds the k other rows of highest integer inner product."""
    spark = vecs.sparkSession
    rows = vectors.valid_vectors(vecs, asked, id_col, vec_col, quantized)
    counted = rows.mapInArrow(_square_batches, "square double").agg(F.max("square").alias("most"), F.count("*").alias("n")).first()
    big, most = float(counted["most"] or 0.0), max(LEAST_PIVOTS, min(PIVOTS, int(counted["n"] ** 0.5)))
    sample = rows.orderBy(F.xxhash64("rkey"), "rkey").limit(PIVOT_SAMPLE).select("dim", "vec").collect()
    pivots = spark.sparkContext.broadcast(_pivots([(r["dim"], bytes(r["vec"])) for r in sample], big, most))
    keyed = rows.mapInArrow(_key_batches(pivots, big), "vec_id long, asked boolean, dim int, vec binary, rkey long, pivot int, dist double")
    n = common.partitions(spark)
    index = keyed.repartitionByRange(n, "dim", "pivot", "dist", "vec_id", "rkey").sortWithinPartitions("dim", "pivot", "dist", "vec_id", "rkey")
    built, _ = common.written(index.mapInPandas(_build(pivots, big, k), _BUILT))
    blocks = built.where("kind = 0")
    queries = built.where("kind = 1").select("qkey", "query_id", F.col("block").alias("home"), "dim", "vecs", "t")
    at_home = built.where("kind = 2").select("qkey", "ckey", "query_id", "vec_id", "score")
    rings = built.where("kind = 3").select("block", "dim", "pivot", "lo", "hi")
    ranges = _ranges(rings, rings_most)
    reach = queries.mapInArrow(_reach_batches(pivots, ranges), "qkey long, query_id long, home long, dim int, vecs binary, t double, at long, pivot int, qd double")
    if ranges is None:
        in_reach = F.greatest(F.col("lo") - F.col("qd"), F.col("qd") - F.col("hi")) <= F.col("t") * (1 + SLACK) + SLACK
        reach = reach.drop("at").join(rings.withColumnRenamed("block", "at"), ["dim", "pivot"]).where(in_reach).dropDuplicates(["qkey", "at"])
    there = reach.where(F.col("at") != F.col("home")).select(F.col("at").alias("block"), "qkey", "query_id", "vecs", "t")
    found = vectors.met(blocks.select("block", "dim", "ids", "rkeys", "pivots", "dists", "vecs"), there, "block", _expand(pivots, big, k), _FOUND)
    return vectors.best(at_home.unionByName(found), k, [F.col("score").desc()])


def _square_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([float((np.frombuffer(v.as_py(), "<f8") ** 2).sum()) for v in b.column("vec")], pa.float64())], ["square"])


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
