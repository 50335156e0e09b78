"""Sinks that write what they are given to a shared folder, and their readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from . import lake

#: Bytes of a log file.
LOG_BYTES = 100 << 20
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_lines(lines: DataFrame, folder: str, most_bytes: int = LOG_BYTES) -> str:
    """Lines (value) as text files of about ``most_bytes`` at most (SNK-08, SNK-09): a task begins a new file after as many lines as an average line allows. Returns the folder."""
    mean = lines.agg(F.avg(F.octet_length("value") + 1).alias("m")).first()["m"] or 1.0
    lines.write.option("maxRecordsPerFile", max(1, int(most_bytes / mean))).mode("append").text(folder)
    return folder


def write_wal(rows: DataFrame, folder: str, kind: str, at: Column, columns: Sequence[str]) -> str:
    """Log entries as JSON lines, each with its checksum (SNK-07). Returns the folder."""
    lake.wal_entries(rows, kind, at, columns).write.mode("append").options(**_TIMES).json(folder)
    return folder


def read_wal(spark: SparkSession, folder: str) -> DataFrame:
    """(type, data, time, crc, intact) of a written log."""
    rows = spark.read.schema("type string, data string, time timestamp_ntz, crc long").options(**_TIMES).json(folder)
    return rows.withColumn("intact", F.crc32("data") == F.col("crc"))


def signed_deliveries(events: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(body, signature): the webhook's JSON body and its HMAC-SHA256 (SNK-10, SCL-24)."""
    body = events.select(F.to_json(F.struct(*columns)).alias("body"))
    return body.withColumn("signature", scalars.hmac_sha256_hex(F.col("body"), F.lit(key)))


def shards(contents: DataFrame, id_col: str, data_shards: int = 4) -> DataFrame:
    """(id, shard, part): the content, after its length in 8 bytes, cut into equal shards with zeros behind the last (SNK-13)."""
    size, padding = scalars.shard_sizes(F.octet_length("content").cast("long"), data_shards)
    head = F.unhex(F.lpad(F.hex(F.octet_length("content").cast("long")), 16, "0"))
    whole = F.concat(head, F.col("content"), F.unhex(F.repeat(F.lit("00"), padding.cast("int"))))
    rows = contents.select(id_col, whole.alias("w"), size.cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(data_shards - 1))).alias("shard"))
    return rows.select(id_col, "shard", F.substring("w", F.col("shard") * F.col("s") + 1, F.col("s")).alias("part"))


def joined_shards(parts: DataFrame, id_col: str) -> DataFrame:
    """(id, content) of the shards."""
    each = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("shard", F.hex("part").alias("h")))).alias("l"))
    whole = F.array_join(F.transform("l", lambda x: x["h"]), "")
    size = F.conv(F.substring(whole, 1, 16), 16, 10).cast("int")
    return each.select(id_col, F.unhex(F.substring(whole, F.lit(17), 2 * size)).alias("content"))
