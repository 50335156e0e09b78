"""Sources and sinks of the lake: blobs, text to be indexed, configuration, logs, metric and result formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.pipelines import Pipeline, Step

# Content types whose text is indexed, by prefix, and the suffixes that vectors take besides.
TEXT_TYPES = ("text/", "application/json", "application/xml", "application/javascript", "application/x-yaml", "application/yaml")
TEXT_SUFFIXES = ("+json", "+xml", "+yaml")
#: Bytes of an object's text that are indexed.
INDEXED_BYTES = 1 << 20


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of any store Spark can open (SRC-09); without the content column only listings are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def is_text(content_type: Column, for_vectors: bool = False) -> Column:
    """SRC-11."""
    out = F.lit(False)
    for p in TEXT_TYPES:
        out = out | content_type.startswith(p)
    if for_vectors:
        for s in TEXT_SUFFIXES:
            out = out | content_type.contains(s)
    return out


def indexed_text(objects: DataFrame, content: str = "content", content_type: str = "content_type", most: int | None = INDEXED_BYTES) -> DataFrame:
    """Objects of text types with the ``text`` of their first ``most`` bytes, a bound that is part of the index's definition; None takes them whole."""
    rows = objects.where(is_text(F.col(content_type)))
    data = F.col(content).cast("binary")
    return rows.withColumn("text", (data if most is None else F.substring(data, 1, most)).cast("string"))


def load_pipelines(text: str) -> list[Pipeline]:
    """Pipelines of a YAML text (SRC-16): a list under ``pipelines`` of name, trigger, filter, enabled, priority and steps."""
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        import json

        raw = json.loads(text)  # JSON is YAML; the only form taken where no YAML reader is installed
    out = []
    for p in (raw or {}).get("pipelines", []):
        steps = tuple(Step(s.get("name", s["plugin"]), s["plugin"], s.get("on_error", "fail")) for s in p.get("steps", []))
        out.append(Pipeline(p["name"], p.get("trigger", "on_put"), steps, p.get("filter", ""), p.get("enabled", True), p.get("priority", 0)))
    return out


def event_log(spark: SparkSession, path: str, since: str | None = None, workflow: str | None = None, failed_only: bool = False) -> DataFrame:
    """Workflow events from JSON lines (SRC-17): (execution_id, workflow, type, time, error), in order of time."""
    rows = spark.read.schema("execution_id string, workflow string, type string, time timestamp, error string").json(path)
    rows = rows.where(F.col("time") >= F.lit(since).cast("timestamp")) if since else rows
    rows = rows.where(F.col("workflow") == workflow) if workflow else rows
    return (rows.where(F.col("type").endswith("failed")) if failed_only else rows).orderBy("time", "execution_id")


def bulk_import(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """JSON or Parquet files as vectors to be inserted (SRC-18)."""
    return spark.read.format(kind).schema(schema).load(path)


def wal_entries(rows: DataFrame, kind: str, at: Column, columns: Sequence[str]) -> DataFrame:
    """(type, data, time, crc): log entries with the checksum of their JSON (SNK-07)."""
    data = F.to_json(F.struct(*columns))
    return rows.select(F.lit(kind).alias("type"), data.alias("data"), at.alias("time")).withColumn("crc", F.crc32("data"))


def audit_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON object a row (SNK-09), to be written as text."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def exposition(series: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """Lines ``name{label="..."} value`` (SNK-11)."""
    parts = [F.concat(F.lit(f'{n}="'), F.replace(F.replace(F.col(n).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for n in labels]
    return series.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("value"))


def user_metadata(headers: Column, prefix: str = "x-amz-meta-") -> Column:
    """The headers with the prefix, in any case, as a map without it (PRJ-03)."""
    own = F.map_filter(headers, lambda k, _: F.lower(k).startswith(prefix))
    return F.transform_keys(own, lambda k, _: F.substring(F.lower(k), len(prefix) + 1, 1 << 20))


def projected(json: Column, paths: dict[str, str]) -> list[Column]:
    """Named JSON paths of result documents (PRJ-02, SNK-12): ``a.b[0]`` and ``a[*].b``."""
    return [F.get_json_object(json, "$." + p).alias(n) for n, p in paths.items()]


def query_preview(text: Column, size: int = 64) -> Column:
    """PRJ-04."""
    return T.truncated(text, size)
