"""Registered queries: codecs, text sources, writes, queues, access rules, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import writes
from ..sources import codecs, lake
from ..sources.tables import table
from .registry import query


# SRC-14: vectors to bytes and back, bit for bit.
@query("src_vector_codec", "SELECT vec_id, len(embedding)::INT AS dim, (4 + 4 * len(embedding))::INT AS n_bytes, true AS same FROM embeddings")
def src_vector_codec(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("data", codecs.encoded_vectors(F.col("embedding"))).withColumn("back", codecs.decoded_vectors(F.col("data")))
    return e.select("vec_id", F.size("embedding").alias("dim"), F.octet_length("data").alias("n_bytes"), (F.col("back") == F.col("embedding")).alias("same"))


# SRC-11: what is indexed of objects of several types.
@query(
    "src_indexed_text",
    """SELECT doc_id, strlen(text)::INT AS n_bytes FROM documents WHERE doc_id % 3 <> 2""",  # the others are images
)
def src_indexed_text(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "text/plain").when(F.col("doc_id") % 3 == 1, "application/json").otherwise("image/png")
    o = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), kind.alias("content_type"))
    return lake.indexed_text(o, most=None).select("doc_id", F.octet_length("text").alias("n_bytes"))


# PRJ-02, SNK-12.
@query("prj_json_paths", "SELECT event_id, props->>'$.k' AS k FROM events")
def prj_json_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *lake.projected(F.col("props"), {"k": "k"}))


# PRJ-04.
@query("prj_preview", "SELECT item_id, CASE WHEN strlen(text) > 20 THEN hex(array_slice(encode(text), 1, 20)) || '2E2E2E' ELSE hex(encode(text)) END AS preview_hex FROM benchmark")
def prj_preview(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.hex(lake.query_preview(F.col("text"), 20).cast("binary")).alias("preview_hex"))


# SNK-11: the lines of a counter family.
@query("snk_exposition", """SELECT 'events_total{event_type="' || event_type || '"} ' || count(*) AS value FROM events GROUP BY event_type""")
def snk_exposition(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return lake.exposition(n, "events_total", ["event_type"], "n")


# SNK-09.
@query("snk_audit", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def snk_audit(spark, sf_dir):
    return lake.audit_lines(table(spark, sf_dir, "events"), ["event_id", "event_type"])


_VERSIONS = "SELECT 'b' || (conv_id % 3) AS bucket, conv_id AS key, turn AS version, length(text)::BIGINT AS size, role = 'system' AS delete_marker FROM conversations"


# SNK-01, SNK-05, AGG-04.
@query(
    "snk_put_objects",
    f"""WITH v AS ({_VERSIONS}), old AS (SELECT * FROM v WHERE version < 2), new AS (SELECT * FROM v WHERE version >= 2),
live AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY version DESC) AS r FROM old) WHERE r = 1 AND NOT delete_marker),
u AS (SELECT bucket, count(*) AS n FROM (SELECT bucket FROM live UNION ALL SELECT bucket FROM new) GROUP BY bucket), o AS (SELECT bucket FROM u WHERE bucket = 'b1' AND n > 5)
SELECT bucket, count(*) AS n_versions FROM (SELECT bucket FROM old UNION ALL SELECT bucket FROM new WHERE bucket NOT IN (SELECT bucket FROM o)) GROUP BY bucket""",
)
def snk_put_objects(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    v = c.select(F.concat(F.lit("b"), (F.col("conv_id") % 3).cast("string")).alias("bucket"), F.col("conv_id").alias("key"), F.col("turn").alias("version"), F.length("text").cast("long").alias("size"), (F.col("role") == "system").alias("delete_marker"))
    quotas = spark.createDataFrame([("b1", 5, 0)], "bucket string, max_objects long, max_size long")
    after, _ = writes.put_objects(v.where("version < 2"), v.where("version >= 2"), quotas)
    return after.groupBy("bucket").agg(F.count("*").alias("n_versions"))


# SNK-03.
@query(
    "snk_create_buckets",
    "SELECT o_orderkey AS request, o_orderpriority AS bucket, CASE WHEN o_orderpriority = '5-LOW' OR row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) > 1 THEN 'exists' ELSE 'created' END AS status FROM orders",
)
def snk_create_buckets(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderpriority").alias("bucket"))
    return writes.create_buckets(spark.createDataFrame([("5-LOW",)], "bucket string"), names)


# STR-11, AGG-13, FLT-20.
@query(
    "str_queue_states",
    """WITH a AS (SELECT user_id AS task_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS attempt, epoch_us(ts) // 1000 AS at_ms, CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'failed' END AS outcome, user_id % 11 <> 0 AS known FROM events),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt DESC) = 1), s AS (SELECT *, CASE WHEN outcome = 'ok' THEN 'done' WHEN NOT known OR attempt >= 4 THEN 'dead' ELSE 'pending' END AS status FROM l)
SELECT task_id, status, attempt AS attempts, CASE WHEN status = 'pending' THEN at_ms + least(300000, 1000 * 2 ** (attempt - 1))::BIGINT END AS next_at_ms FROM s""",
)
def str_queue_states(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    a = e.select(
        F.col("user_id").alias("task_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("attempt"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.when(F.col("event_type") == "purchase", "ok").otherwise("failed").alias("outcome"), (F.col("user_id") % 11 != 0).alias("known"),
    )
    return writes.queue_states(a, 4, 1000, 300_000)


# FLT-18.
@query(
    "flt_vector_access",
    """WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'editor' ELSE 'viewer' END AS role, CASE WHEN doc_id % 2 = 0 THEN 'vector:search' ELSE 'vector:index' END AS action, source AS bucket, CASE WHEN doc_id % 5 = 0 THEN 'image/png' ELSE 'text/plain' END AS content_type, n_chars AS size FROM documents)
SELECT doc_id, role = 'admin' OR role = 'editor' OR action = 'vector:search' AS allow, bucket IN ('src0', 'src1') AND role <> 'admin' AS deny_sensitive, action = 'vector:index' AND content_type = 'image/png' AS deny_binary,
 bucket = 'src2' AND content_type <> 'image/png' AND size < 10485760 AS auto_index FROM r""",
)
def flt_vector_access(spark, sf_dir):
    i = F.col("doc_id")
    r = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 3 == 0, "admin").when(i % 3 == 1, "editor").otherwise("viewer").alias("role"), F.when(i % 2 == 0, "vector:search").otherwise("vector:index").alias("action"),
        F.col("source").alias("bucket"), F.when(i % 5 == 0, "image/png").otherwise("text/plain").alias("content_type"), F.col("n_chars").alias("size"),
    )
    return writes.vector_access(r, ["src0", "src1"], ["src2"]).select("doc_id", "allow", "deny_sensitive", "deny_binary", "auto_index")


# LIF-01.
@query(
    "lif_actions",
    """SELECT o_orderstatus AS bucket, o_orderkey AS key, CASE WHEN age >= 1500 THEN 'expire' ELSE 'COLD' END AS action FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS age FROM orders WHERE o_orderstatus IN ('F', 'O'))
WHERE (o_orderstatus = 'F' AND age >= 700) OR (o_orderstatus = 'O' AND age >= 1500)""",
)
def lif_actions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("bucket"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").cast("date").alias("modified_at"))
    rules = spark.createDataFrame([(1, "F", "", 1500, 700, "COLD"), (2, "O", "", 1500, None, None)], "ordinal int, rule_bucket string, prefix string, expire_days int, transition_days int, tier_to string")
    return writes.lifecycle(o, rules, F.lit("2000-01-01").cast("date")).withColumn("key", F.col("key").cast("long"))


# VEC-27.
@query("vec_promoted_segments", "SELECT user_id % 40 AS segment_id, count(*) AS accesses FROM events GROUP BY 1 HAVING count(*) >= 100")
def vec_promoted_segments(spark, sf_dir):
    return writes.promoted_segments(table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("segment_id")))


# VEC-25, AGG-20, VEC-20, SET-02.
@query("vec_stats", "SELECT label AS segment_id, count(*) AS n_vectors, min(len(embedding))::INT AS dim, max(vec_id) AS last_id FROM embeddings GROUP BY label")
def vec_stats(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("segment_id")).agg(F.count("*").alias("n_vectors"), F.min(F.size("embedding")).alias("dim"), F.max("vec_id").alias("last_id"))
