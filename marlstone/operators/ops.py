"""Operational analytics: percentiles, histograms, task statistics, recovery, replication, backups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_lower(rows: DataFrame, by: Sequence[str], value: str, percents: Sequence[int], cells: int = 4096) -> DataFrame:
    """(by, n, p50, ...): the sorted sample's element floor((n - 1) * p / 100) (AGG-14). Equal values are counted before the shuffle; the counts are added up by
    ``cells`` equal steps of each group's range, and only values in the steps that hold a percentile are put in order, so no group's values go to one task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    ends = counts.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum("c").alias("n"))
    step = F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (cells - 1)).cast("long")
    placed = counts.join(ends, list(by)).withColumn("__cell", F.coalesce(F.when(F.col("__hi") > F.col("__lo"), step), F.lit(0)))
    sums = placed.groupBy(*by, "__cell").agg(F.sum("c").alias("__in"), F.first("n").alias("n"))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0)))
    target = lambda p: F.floor((F.col("n") - 1) * p / 100)
    held = reduce(or_, [(F.col("__before") <= target(p)) & (target(p) < F.col("__before") + F.col("__in")) for p in percents])
    inside = placed.join(sums.where(held).select(*by, "__cell", "__before"), [*by, "__cell"])
    upto = F.col("__before") + F.sum("c").over(Window.partitionBy(*by, "__cell").orderBy(value))
    pick = [F.min(F.when(F.col("__upto") > target(p), F.col(value))).alias(f"p{p}") for p in percents]
    return inside.withColumn("__upto", upto).groupBy(*by).agg(F.first("n").alias("n"), *pick)


def histogram(rows: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """(by, le, n): cumulative counts of a fixed-bucket histogram, +Inf last (AGG-16, SNK-11): one pass of conditional sums."""
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(F.count(value).alias("total"), *sums)
    entries = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return wide.select(*by, F.explode(entries).alias("e")).select(*by, "e.le", "e.n")


def task_stats(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, runs, ok, failed, max_retries, avg_duration, success_rate) (AGG-11, AGG-12)."""
    ok = F.sum(F.col("success").cast("long"))
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), ok.alias("ok"), (F.count("*") - ok).alias("failed"), F.max("retries").alias("max_retries"),
        F.round(F.avg("duration"), 6).alias("avg_duration"), F.round(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)), 6).alias("success_rate"),
    )


def hit_rate(hits: Column, misses: Column, empty: float = 0.0) -> Column:
    """AGG-22: the rate of an empty cache is a convention."""
    return F.when(hits + misses == 0, F.lit(empty)).otherwise(hits / (hits + misses))


def last_terminal(log: DataFrame, execution: str, kind: str, order: Sequence[str], terminal: Sequence[str]) -> DataFrame:
    """(execution, last): each execution's last terminal event (STR-15, RPL-01)."""
    return log.where(F.col(kind).isin(*terminal)).groupBy(execution).agg(F.max_by(kind, F.struct(*order)).alias("last"))


def to_replay(log: DataFrame, execution: str, kind: str, order: Sequence[str], terminal: Sequence[str], failed: Sequence[str]) -> DataFrame:
    """The executions whose last terminal event is a failure (JON-12)."""
    return last_terminal(log, execution, kind, order, terminal).where(F.col("last").isin(*failed))


def delta(rows: DataFrame, lsn: str, since: int) -> DataFrame:
    """An incremental backup: what is newer than the last one (BKP-01, D18); the bound reaches the scan."""
    return rows.where(F.col(lsn) > since)


def restored(full: DataFrame, increments: Sequence[DataFrame], keys: Sequence[str], lsn: str) -> DataFrame:
    """The last state of each key over a full backup and its increments (SET-06)."""
    rows = full
    for i in increments:
        rows = rows.unionByName(i)
    rest = [c for c in rows.columns if c not in keys and c != lsn]
    return rows.groupBy(*keys).agg(F.max(F.struct(lsn, *rest)).alias("v")).select(*keys, "v.*")


def expired_backups(backups: DataFrame, as_of: Column, retention_days: Sequence[int]) -> DataFrame:
    """Backups older than every retention window (BKP-02)."""
    return backups.where(F.date_diff(as_of, F.col("created_at")) > max(retention_days))


def replication_status(jobs: DataFrame) -> DataFrame:
    """(bucket, pending, failed, completed) over each job's latest status (AGG-19, RPL-01)."""
    last = jobs.groupBy("bucket", "job_id").agg(F.max_by("status", "seq").alias("status"))
    count = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return last.groupBy("bucket").agg(count("pending"), count("failed"), count("completed"))


def capped_metrics(points: DataFrame, plugin: str, name: str, seq: str, most: int) -> DataFrame:
    """(plugin, kept, overflow): metric names in the order first seen, ``most`` of them kept per plugin (AGG-18)."""
    first = points.groupBy(plugin, name).agg(F.min(seq).alias("first"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(plugin).orderBy("first", name))
    kept = F.col("place") <= most
    return first.withColumn("place", place).groupBy(plugin).agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(kept, 0).otherwise(F.col("n"))).alias("overflow"))


def scrubbed(objects: DataFrame, tiers: Sequence[str] = ()) -> DataFrame:
    """(checked, corrupt, unreadable) over objects of the tiers (all if none is named): stored against recomputed SHA-256 (INT-01, AGG-28, FLT-19)."""
    rows = objects.where(F.col("tier").isin(*tiers)) if tiers else objects
    bad = F.col("content").isNotNull() & (F.sha2("content", 256) != F.col("checksum"))
    return rows.agg(F.count("*").alias("checked"), F.sum(bad.cast("long")).alias("corrupt"), F.sum(F.col("content").isNull().cast("long")).alias("unreadable"))


def rejections(calls: DataFrame, level: str, caller: str) -> DataFrame:
    """(level, calls, callers): AGG-23. Calls by the level that refused them, or that none did."""
    return calls.groupBy(level).agg(F.count("*").alias("calls"), F.count_distinct(caller).alias("callers"))


def executions(rows: DataFrame, bucket: str = "", object_key: str = "") -> DataFrame:
    """FLT-21: an empty bucket or key means any."""
    for c, v in (("bucket", bucket), ("object_key", object_key)):
        rows = rows.where(F.col(c) == v) if v else rows
    return rows


def newest(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The n last rows by ``order``, the last first (INT-02, TOP-11): a top-k, without a full sort."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def verified(objects: DataFrame) -> DataFrame:
    """The objects with ``read``, the content where its SHA-256 is the stored one, and ``fault``: null, ``missing`` or ``corrupt`` (INT-03). Nothing corrupt is read."""
    good = F.sha2("content", 256) == F.col("checksum")
    fault = F.when(F.col("content").isNull(), "missing").when(~F.coalesce(good, F.lit(False)), "corrupt")
    return objects.withColumn("fault", fault).withColumn("read", F.when(fault.isNull(), F.col("content")))


def prefetched(requests: DataFrame, most: int, levels: Sequence[str] = ("critical", "high", "normal", "low")) -> DataFrame:
    """The next ``most`` requests (request_id, level, at): by level, then in order of arrival; one of an unknown level is of the last (TOP-09)."""
    place = F.lit(len(levels) - 1)
    for i, name in enumerate(levels):
        place = F.when(F.col("level") == name, i).otherwise(place)
    return requests.withColumn("__place", place).orderBy("__place", "at", "request_id").limit(most).drop("__place")
