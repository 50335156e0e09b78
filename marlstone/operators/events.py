"""Event routing and event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates, scalars


def matches(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with the rules that match them (JON-06, JON-07). Rules are configuration: a small table, broadcast."""
    rule = {"patterns": F.col("patterns"), "bucket": F.col("rule_bucket"), "prefix": F.col("prefix"), "suffix": F.col("suffix")}
    return events.join(F.broadcast(rules), predicates.rule_match(F.col("event_type"), F.col("bucket"), F.col("key"), rule))


def deliveries(matched: DataFrame) -> DataFrame:
    """Each match with its outcome: only webhooks are delivered, others fail (STR-03)."""
    return matched.withColumn("outcome", F.when(F.col("destination") == "webhook", F.lit("delivered")).otherwise(F.lit("failed")))


def retry_schedule(failed: DataFrame, retries: int, base_ms: int, cap_ms: int) -> DataFrame:
    """One row for each retry of a dead letter with its delay and the time since the failure (STR-04)."""
    attempt = failed.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries - 1))))
    delay = scalars.retry_delay_ms(F.col("attempt"), base_ms, cap_ms)
    upto = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("attempt")), lambda i: scalars.retry_delay_ms(i, base_ms, cap_ms)), F.lit(0).cast("long"), lambda s, x: s + x)
    return attempt.withColumn("delay_ms", delay).withColumn("at_ms", upto)


def tumbling(events: DataFrame, ts: str, duration: str, keys: Sequence[str] = ()) -> DataFrame:
    """(window_start, keys, n); the same call serves streams and tables (STR-20)."""
    w = F.window(F.col(ts).cast("timestamp"), duration)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sliding(events: DataFrame, ts: str, duration: str, slide: str, keys: Sequence[str] = ()) -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp"), duration, slide)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: Sequence[str]) -> DataFrame:
    """(keys, session_start, n): runs of events with gaps below ``gap`` (STR-17)."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), "n")


def concurrency(intervals: DataFrame, key: str, start: str, end: str, limit: int) -> DataFrame:
    """(key, at, running, over) at each acquisition: a sweep over starts and ends, ends first at equal times (STR-09)."""
    edges = intervals.select(key, F.col(start).alias("at"), F.lit(1).alias("step")).union(intervals.select(key, F.col(end).alias("at"), F.lit(-1).alias("step")))
    per = edges.groupBy(key, "at").agg(F.sum("step").alias("net"), F.sum((F.col("step") > 0).cast("long")).alias("starts"))
    running = F.sum("net").over(Window.partitionBy(key).orderBy("at"))
    return per.withColumn("running", running).where("starts > 0").select(key, "at", "running", (F.col("running") > limit).alias("over"))
