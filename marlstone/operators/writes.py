"""Writes as table operators: put, create, queue and replication state, access rules, lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog


def put_objects(versions: DataFrame, new: DataFrame, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions after, refused): new versions (bucket, key, version, size, delete_marker) are appended unless their bucket's usage with
    all of them would exceed its quota (SNK-01, SNK-05); the latest version of a key is a view over the table."""
    live = catalog.latest(versions, ["bucket", "key"], ["version"], F.col("delete_marker"))
    used = catalog.usage(live.unionByName(new)).select("bucket", "n_objects", "size")
    over = catalog.over_quota(used, quotas).where("over_quota").select("bucket")
    return versions.unionByName(new.join(F.broadcast(over), "bucket", "left_anti")), new.join(F.broadcast(over), "bucket", "left_semi")


def create_buckets(buckets: DataFrame, names: DataFrame) -> DataFrame:
    """(bucket, status): created, or exists for a name that is there or comes twice (SNK-03)."""
    first = names.groupBy("bucket").agg(F.min("request").alias("first"))
    there = buckets.select("bucket").distinct().withColumn("there", F.lit(True))
    first = first.join(there, "bucket", "left")
    status = F.when(F.coalesce("there", F.lit(False)) | (F.col("request") > F.col("first")), "exists").otherwise("created")
    return names.join(first, "bucket").select("request", "bucket", status.alias("status"))


def queue_states(attempts: DataFrame, most: int, base_ms: int, cap_ms: int) -> DataFrame:
    """(task_id, status, attempts, next_at_ms): a durable queue's state from the log of attempts (task_id, attempt, at_ms, outcome, known)
    (STR-11): done, dead (unknown kind, or attempts used up) or pending with its next time."""
    last = attempts.groupBy("task_id").agg(F.max(F.struct("attempt", "at_ms", "outcome", "known")).alias("l")).select("task_id", "l.*")
    status = F.when(F.col("outcome") == "ok", "done").when(~F.col("known") | (F.col("attempt") >= most), "dead").otherwise("pending")
    delay = F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), F.col("attempt") - 1)).cast("long")
    return last.select("task_id", status.alias("status"), F.col("attempt").alias("attempts"), F.when(status == "pending", F.col("at_ms") + delay).alias("next_at_ms"))


def claims(pending: DataFrame, now_ms: int, workers: int) -> DataFrame:
    """The next tasks to run: highest priority, then oldest (TOP-07); ``workers`` is the feature's limit."""
    return pending.where(F.col("next_at_ms") <= now_ms).orderBy(F.desc("priority"), "created_ms", "task_id").limit(workers)


def vector_access(requests: DataFrame, sensitive: Sequence[str], auto_index: Sequence[str]) -> DataFrame:
    """allow, the denials (which do not take allow back) and auto_index for vector actions (FLT-18) from role, action, bucket, content_type and size."""
    role, action = F.col("role"), F.col("action")
    allow = (role == "admin") | ((role == "editor") & action.isin("vector:search", "vector:index", "vector:delete")) | ((role == "viewer") & (action == "vector:search"))
    binary = F.col("content_type").startswith("image/") | F.col("content_type").startswith("video/") | (F.col("content_type") == "application/octet-stream")
    return requests.withColumns(
        {
            "allow": allow,
            "deny_sensitive": F.col("bucket").isin(*sensitive) & (role != "admin"),
            "deny_binary": (action == "vector:index") & binary,
            "auto_index": F.col("bucket").isin(*auto_index) & ~binary & (F.col("size") < 10 << 20),
        }
    )


def role_access(requests: DataFrame) -> DataFrame:
    """FLT-17: admins all, owners their own, others by the permission ``bucket:action``, and reads of public buckets."""
    listed = F.array_contains("permissions", F.concat("bucket", F.lit(":"), "action"))
    own = F.col("user") == F.col("owner")
    public = F.col("public") & F.col("action").isin("get", "list")
    return requests.withColumn("allow", F.coalesce((F.col("role") == "admin") | own | listed | public, F.lit(False)))


def lifecycle(objects: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """(bucket, key, action): expire or the tier to move to, by the age of the object and its bucket's first matching rule (LIF-01).
    Rules are configuration, broadcast."""
    age = F.date_diff(as_of, F.col("modified_at"))
    hit = (objects["bucket"] == rules["rule_bucket"]) & F.col("key").startswith(F.col("prefix"))
    due = objects.join(F.broadcast(rules), hit).withColumn("age", age)
    action = F.when(F.col("age") >= F.col("expire_days"), F.lit("expire")).when(F.col("age") >= F.col("transition_days"), F.col("tier_to"))
    due = due.withColumn("action", action).where("action IS NOT NULL")
    return due.groupBy("bucket", "key").agg(F.min_by("action", "ordinal").alias("action"))


def promoted_segments(accesses: DataFrame, least: int = 100) -> DataFrame:
    """Cold segments with enough accesses to become hot (VEC-27)."""
    return accesses.groupBy("segment_id").agg(F.count("*").alias("accesses")).where(F.col("accesses") >= least)
