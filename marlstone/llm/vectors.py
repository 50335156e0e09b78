"""What the two vector searches share: reading valid vectors, dealing queries to index blocks and merging results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Queries that meet a block together.
QUERY_ROWS = 4096


def _valid_batches(transform, drop_zero: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, asked = b.column(0), b.column(1)
            keep, dims, blobs = [], [], []
            for i, x in enumerate(b.column(2)):
                v = x.as_py()
                if v is None or ids[i].as_py() is None or any(c is None for c in v):
                    continue
                a = np.array(v, np.float64)
                if not np.isfinite(a).all() or drop_zero and not a.any():
                    continue
                keep.append(i)
                dims.append(len(a))
                blobs.append(transform(a).astype("<f8").tobytes())
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), asked.take(take), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "asked", "dim", "vec"])

    return run


def identity(a: np.ndarray) -> np.ndarray:
    return a


def valid_vectors(df: DataFrame, asked: Column, id_col: str, vec_col: str, transform=identity, drop_zero: bool = False) -> DataFrame:
    """A written table (vec_id, asked, dim, vec, rkey) of the rows that take part; rkey tells repeated rows apart and vec holds
    doubles. Rows whose id is null, and vectors that are null or hold null or non-finite components, take no part."""
    common.bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.mapInArrow(_valid_batches(transform, drop_zero), "vec_id long, asked boolean, dim int, vec binary")
    return common.written(rows.withColumn("rkey", F.monotonically_increasing_id()))[0]


def matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, dim)


def met(blocks: DataFrame, asked: DataFrame, key: str, work: Callable[[pd.Series, pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``work(block, queries)`` for each block (one row for each ``key``) and the queries with its key, QUERY_ROWS of them at most at a time. Rows are dealt by key and sorted so that
    the block comes first: it is sent once, however many queries meet it, and a task holds one block and streams them."""
    own, theirs = [c for c in blocks.columns if c != key], [c for c in asked.columns if c != key]
    left = blocks.select(key, F.lit(0).alias("kind"), F.struct(*own).alias("b"))
    right = asked.select(key, F.lit(1).alias("kind"), F.struct(*theirs).alias("q"))
    both = left.unionByName(right, allowMissingColumns=True).repartition(common.partitions(blocks.sparkSession), key).sortWithinPartitions(key, "kind")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for b in batches:
            keys, kinds = b.column(key).to_pylist(), b.column("kind").to_pylist()
            i = 0
            while i < b.num_rows:
                if kinds[i] == 0:
                    at, block = keys[i], pd.Series(b.column("b")[i].as_py())
                    i += 1
                    continue
                j = i
                while j < b.num_rows and j - i < QUERY_ROWS and kinds[j] == 1 and keys[j] == keys[i]:
                    j += 1
                if keys[i] == at:
                    queries = pa.RecordBatch.from_arrays(b.column("q").slice(i, j - i).flatten(), theirs).to_pandas()
                    found = work(block, queries)
                    if found is not None and len(found):
                        yield pa.RecordBatch.from_pandas(found[names], preserve_index=False)
                i = j

    return both.mapInArrow(run, schema)


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Of (qkey, ckey, query_id, vec_id, score) the first k of each qkey, with their rank."""
    w = Window.partitionBy("qkey").orderBy(*order, "vec_id", "ckey")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
