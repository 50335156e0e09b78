"""Structured Streaming forms: ingest, routing, windows with watermarks, dead letters, limiters.

Every flow ends in ``run_available``: all input there is, once, with a checkpoint, so a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import events, sequential
from ..sources.tables import shared_folder


def read(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """A file stream with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run the stream over what is there; returns the folder of the rows. With ``each``, batches go to it instead."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if each is not None:
        query = writer.foreachBatch(each).outputMode(mode).start()
    elif mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").outputMode(mode).start()
    else:
        # Complete results replace each other; the batch number keeps a repeated batch from being written twice.
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows")).outputMode(mode).start()
    query.awaitTermination()
    return f"{folder}/rows"


def windowed(stream: DataFrame, ts: str, duration: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped (STR-20)."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return events.sliding(timed, ts, duration, slide, keys) if slide else events.tumbling(timed, ts, duration, keys)


def deduplicated(stream: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """One row for each id within the watermark (STR-20)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def routed(stream: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with their rules and outcomes: a stream joined with a small broadcast table (STR-01 to STR-03, STR-14, STR-18)."""
    return events.deliveries(events.matches(stream, rules))


def route_to_tables(stream: DataFrame, rules: DataFrame, delivered: str, dead: str, retries: int, base_ms: int, cap_ms: int) -> None:
    """Deliveries to one table, the failed with their retry schedule to another (STR-04, SNK-10). Each batch has its own folder, so a
    batch that is run again replaces itself."""

    def each(df: DataFrame, n: int) -> None:
        ok = df.where("outcome = 'delivered'")
        ok.write.mode("overwrite").parquet(f"{delivered}/batch={n}")
        events.retry_schedule(df.where("outcome = 'failed'"), retries, base_ms, cap_ms).write.mode("overwrite").parquet(f"{dead}/batch={n}")

    run_available(routed(stream, rules), each=each)


def limited(stream: DataFrame, key: str, ts: str, limit: int, window_ms: int, precision_ms: int = 100) -> DataFrame:
    """(key, event_id, at_ms, allowed): the sliding-window limiter as keyed state (STR-05). Within a batch a key's rows are put in order of time."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = sequential.SlidingWindow(limit, window_ms, precision_ms)
        if state.exists:
            buckets, counts = state.get
            machine.counts = dict(zip(buckets, counts, strict=True))
        rows = pd.concat(list(frames)).sort_values(["at_ms", "event_id"], kind="stable")
        rows["allowed"] = [machine.allow(int(t)) for t in rows["at_ms"]]
        state.update((list(machine.counts), list(machine.counts.values())))
        yield rows[["key", "event_id", "at_ms", "allowed"]]

    timed = stream.select(F.col(key).alias("key"), "event_id", F.expr(f"unix_millis(CAST({ts} AS TIMESTAMP))").alias("at_ms"))
    return timed.groupBy("key").applyInPandasWithState(step, "key long, event_id long, at_ms long, allowed boolean", "buckets array<long>, counts array<long>", "append", GroupStateTimeout.NoTimeout)
