"""Object-catalog operators: listings, versions, usage, quotas, deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def list_objects(objects: DataFrame, bucket: str, prefix: str = "", start_after: str = "", max_keys: int = 1000) -> DataFrame:
    """Keys of a bucket under a prefix and after a marker, in order, ``max_keys`` at most (SRC-02, LST-01, TOP-10, D16). The conditions are
    plain comparisons on bucket and key, so they reach the scan."""
    rows = objects.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix))
    rows = rows.where(F.col("key") > start_after) if start_after else rows
    return rows.orderBy("key").limit(max_keys)


def get_object(objects: DataFrame, where: dict) -> DataFrame:
    """The rows with exactly these values (SRC-01); the equalities reach the scan. No such object is no row."""
    for c, v in where.items():
        objects = objects.where(F.col(c) == F.lit(v))
    return objects


def list_page(objects: DataFrame, bucket: str, prefix: str = "", start_after: str = "", max_keys: int = 1000) -> DataFrame:
    """One page with its truncation flag and next marker on each row (LST-02): one row more than the page is read."""
    rows = list_objects(objects, bucket, prefix, start_after, max_keys + 1)
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("key")))  # of a page's rows
    whole = Window.partitionBy()
    rows = rows.withColumn("is_truncated", F.count("*").over(whole) > max_keys).where(F.col("place") <= max_keys)
    return rows.withColumn("next_marker", F.when(F.col("is_truncated"), F.max("key").over(whole))).drop("place")


def list_delimited(objects: DataFrame, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """(bucket, entry, is_prefix, n, size): distinct common prefixes with what they hold, and the leaf objects (SRC-03, D16)."""
    under = objects.where(F.col("key").startswith(prefix))
    common = scalars.common_prefix(F.col("key"), prefix, delimiter)
    rows = under.select("bucket", F.coalesce(common, F.col("key")).alias("entry"), common.isNotNull().alias("is_prefix"), "size")
    return rows.groupBy("bucket", "entry", "is_prefix").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def latest(versions: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The last version of each key, without keys whose last version is a delete marker (WIN-01). An aggregation, so each task sends one
    row per key, however many versions a key has."""
    rest = [c for c in versions.columns if c not in keys and c not in order]
    top = versions.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("v")).select(*keys, "v.*")
    return top.where(~deleted) if deleted is not None else top


def last_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order (WIN-03, WIN-09, AGG-09): tasks drop the others before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def usage(objects: DataFrame, by: Sequence[str] = ("bucket",)) -> DataFrame:
    """(by, n_objects, size) (AGG-04, AGG-05)."""
    return objects.groupBy(*by).agg(F.count("*").alias("n_objects"), F.sum("size").alias("size"))


def over_quota(used: DataFrame, quotas: DataFrame) -> DataFrame:
    """Usage with max_objects and max_size and whether a limit above 0 is exceeded."""
    both = used.join(F.broadcast(quotas), "bucket", "left")
    over = lambda have, most: (F.coalesce(most, F.lit(0)) > 0) & (have > most)
    return both.withColumn("over_quota", over(F.col("n_objects"), F.col("max_objects")) | over(F.col("size"), F.col("max_size")))


def page_by_offset(rows: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page by offset with the total number of rows (SRC-19)."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def delete_action(rows: DataFrame, as_of: Column) -> DataFrame:
    """What a delete request does to each object (SNK-14): retained, marked, removed, or nothing for a missing one."""
    held = (F.col("retain_until") > as_of) & ~F.coalesce(F.col("bypass"), F.lit(False))
    action = F.when(~F.col("found"), "missing").when(held, "forbidden").when(F.col("versioned"), "marked").otherwise("removed")
    return rows.withColumn("action", action)


def complete_uploads(parts: DataFrame) -> DataFrame:
    """(upload_id, n_parts, size, parts): parts in the order of their numbers (SNK-16)."""
    return parts.groupBy("upload_id").agg(F.count("*").alias("n_parts"), F.sum("size").alias("size"), F.sort_array(F.collect_list("part_number")).alias("parts"))


def append_offsets(chunks: DataFrame) -> DataFrame:
    """Each chunk of a resumable upload with the offset it should have and whether the client's differs (SNK-17)."""
    before = Window.partitionBy("upload_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    expected = F.coalesce(F.sum("size").over(before), F.lit(0))
    return chunks.withColumn("expected_offset", expected).withColumn("conflict", F.col("offset") != expected)


def conditional_get(rows: DataFrame) -> DataFrame:
    """The status of a conditional read (FLT-16) from etag, modified_at, delete_marker, if_match, if_none_match and if_modified_since."""
    status = (
        F.when(F.col("delete_marker"), 404)
        .when(F.col("if_match").isNotNull() & (F.col("if_match") != F.col("etag")), 412)
        .when(F.col("if_none_match") == F.col("etag"), 304)
        .when(F.col("if_none_match").isNull() & (F.col("modified_at") <= F.col("if_modified_since")), 304)
        .otherwise(200)
    )
    return rows.withColumn("status", status)


def moved(objects: DataFrame, source: str, target: str) -> DataFrame:
    """Objects with those of the source tier moved to the target (SNK-06)."""
    return objects.withColumn("tier", F.when(F.col("tier") == source, F.lit(target)).otherwise(F.col("tier")))


def expired(rows: DataFrame, created: str, ttl: str, as_of: Column) -> DataFrame:
    """The rows whose time to live, an interval, is over, with ``expires_at`` (SRC-07, SRC-08, STR-19, FLT-20). The bound is put to the column itself, so it reaches the scan."""
    due = rows.where(F.col(created) <= as_of - F.expr(ttl))
    return due.withColumn("expires_at", F.col(created) + F.expr(ttl))


def content_checksum(rows: DataFrame, by: Sequence[str], value: Column, order: str, span: int = 1000) -> DataFrame:
    """A checksum of each group's rows in the order of a whole number (AGG-21): SHA-256 of the rows' hashes over spans of ``span`` of it, of those over spans of spans, and
    of the rest, so no group holds the hashes of all its rows."""
    joined = lambda c: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(c, "h"))), lambda x: x["h"]))
    level = rows.select(*by, F.col(order).alias("__o"), F.sha2(value, 256).alias("h"), F.lit(1).cast("long").alias("n"))
    for _ in range(2):
        level = level.groupBy(*by, F.floor(F.col("__o") / span).alias("__s")).agg(F.sha2(joined("__o"), 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("__s", "__o")
    return level.groupBy(*by).agg(F.sha2(joined("__o"), 256).alias("checksum"), F.sum("n").alias("n"))


def evicted(rows: DataFrame, seq: str, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(kept, gone): the ``most`` rows that came last, and the others, first in first out (WIN-09). The bound between them is one number."""
    bound = rows.select(F.col(seq).alias("__s")).orderBy(F.desc("__s")).limit(most).agg(F.min("__s").alias("__bound"))
    both = rows.join(F.broadcast(bound))
    return both.where(F.col(seq) >= F.col("__bound")).drop("__bound"), both.where(F.col(seq) < F.col("__bound")).drop("__bound")
