"""Registered queries: catalog, tiering, events, scalars and operational analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import catalog, events, ops, tiering
from ..sources.tables import table
from .registry import query

AS_OF = "2024-01-31 00:00:00"


def doc_objects(spark, sf_dir: str) -> DataFrame:
    """documents as objects: bucket, key, size, tier."""
    d = table(spark, sf_dir, "documents")
    key = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("source").alias("bucket"), key.alias("key"), F.col("n_chars").alias("size"), "doc_id")


_DOC_OBJECTS = "(SELECT source AS bucket, lang || '/' || doc_id || '.txt' AS key, n_chars AS size, doc_id FROM documents)"


def page_objects(spark, sf_dir: str) -> DataFrame:
    """pages as objects: host and path."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("bucket"), F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("key"),
        F.octet_length("html").cast("long").alias("size"), "page_id",
    )


_PAGE_OBJECTS = r"(SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS bucket, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS key, strlen(html)::BIGINT AS size, page_id FROM pages)"


def event_log(spark, sf_dir: str) -> DataFrame:
    """events as access events: bucket, key, an object-store event type."""
    kind = (
        F.when(F.col("event_type") == "signup", "s3:ObjectCreated:Put").when(F.col("event_type") == "purchase", "s3:ObjectCreated:CompleteMultipartUpload")
        .when(F.col("event_type") == "error", "s3:ObjectRemoved:Delete").when(F.col("event_type") == "view", "s3:ObjectAccessed:Get").otherwise("s3:ObjectAccessed:Head")
    )
    key = F.concat(F.when(F.col("user_id") % 2 == 0, F.lit("images/")).otherwise(F.lit("logs/")), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit(".jpg")).otherwise(F.lit(".txt")))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "value", "props", F.concat(F.lit("bucket"), (F.col("user_id") % 4).cast("string")).alias("bucket"), key.alias("key"), kind.alias("event_type"))


_EVENT_LOG = """(SELECT event_id, ts, user_id, value, props, 'bucket' || (user_id % 4) AS bucket,
 (CASE WHEN user_id % 2 = 0 THEN 'images/' ELSE 'logs/' END) || event_id || (CASE WHEN event_id % 3 = 0 THEN '.jpg' ELSE '.txt' END) AS key,
 CASE event_type WHEN 'signup' THEN 's3:ObjectCreated:Put' WHEN 'purchase' THEN 's3:ObjectCreated:CompleteMultipartUpload' WHEN 'error' THEN 's3:ObjectRemoved:Delete'
 WHEN 'view' THEN 's3:ObjectAccessed:Get' ELSE 's3:ObjectAccessed:Head' END AS event_type FROM events)"""


# LST-01, SRC-02.
@query("cat_list_v1", f"SELECT key, size FROM {_DOC_OBJECTS} WHERE bucket = 'src0' AND starts_with(key, 'en/') ORDER BY key LIMIT 1000")
def cat_list_v1(spark, sf_dir):
    return catalog.list_objects(doc_objects(spark, sf_dir), "src0", "en/").select("key", "size")


# SRC-03, SCL-08, D16.
@query(
    "cat_list_delimiter",
    f"""SELECT bucket, CASE WHEN instr(key, '/') > 0 THEN substring(key, 1, instr(key, '/')) ELSE key END AS entry, instr(key, '/') > 0 AS is_prefix, count(*) AS n, sum(size)::BIGINT AS size
FROM {_PAGE_OBJECTS} GROUP BY ALL""",
)
def cat_list_delimiter(spark, sf_dir):
    return catalog.list_delimited(page_objects(spark, sf_dir))


# LST-02, TOP-10.
@query(
    "cat_list_page",
    f"""WITH r AS (SELECT key, size FROM {_DOC_OBJECTS} WHERE bucket = 'src1' AND key > 'en/2' ORDER BY key LIMIT 11),
m AS (SELECT *, count(*) OVER () > 10 AS is_truncated, row_number() OVER (ORDER BY key) AS place FROM r)
SELECT key, size, is_truncated, CASE WHEN is_truncated THEN max(key) OVER () END AS next_marker FROM m WHERE place <= 10""",
)
def cat_list_page(spark, sf_dir):
    return catalog.list_page(doc_objects(spark, sf_dir).select("bucket", "key", "size"), "src1", start_after="en/2", max_keys=10).drop("bucket")


# WIN-01, D29: conversations as versions of a key; a system turn stands for a delete marker.
@query(
    "cat_latest_version",
    "SELECT conv_id, turn, role, length(text)::INT AS size FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AND role <> 'system'",
)
def cat_latest_version(spark, sf_dir):
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    return catalog.latest(v, ["conv_id"], ["turn"], F.col("role") == "system")


# SRC-04, SRC-05, WIN-03.
@query("cat_versions", "SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC))::INT AS place FROM conversations QUALIFY place <= 3")
def cat_versions(spark, sf_dir):
    return catalog.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 3)


# AGG-04, AGG-05, AGG-20.
@query("cat_bucket_usage", f"SELECT bucket, count(*) AS n_objects, sum(size)::BIGINT AS size FROM {_DOC_OBJECTS} GROUP BY bucket")
def cat_bucket_usage(spark, sf_dir):
    return catalog.usage(doc_objects(spark, sf_dir))


@query(
    "cat_quota",
    f"""WITH q(bucket, max_objects, max_size) AS (VALUES ('src0', 10::BIGINT, 0::BIGINT), ('src1', 0, 100000), ('src2', 1000000, 1000000000)),
u AS (SELECT bucket, count(*) AS n_objects, sum(size)::BIGINT AS size FROM {_DOC_OBJECTS} GROUP BY bucket)
SELECT u.*, max_objects, max_size, coalesce(max_objects > 0 AND n_objects > max_objects, false) OR coalesce(max_size > 0 AND size > max_size, false) AS over_quota FROM u LEFT JOIN q USING (bucket)""",
)
def cat_quota(spark, sf_dir):
    q = spark.createDataFrame([("src0", 10, 0), ("src1", 0, 100_000), ("src2", 1_000_000, 1_000_000_000)], "bucket string, max_objects long, max_size long")
    return catalog.over_quota(catalog.usage(doc_objects(spark, sf_dir)), q).withColumn("over_quota", F.coalesce("over_quota", F.lit(False)))


# SRC-07, SRC-08, STR-19, FLT-20: an upload begun by each event expires after five days.
@query("cat_expired", "SELECT event_id, ts + INTERVAL 5 DAY AS expires_at FROM events WHERE ts + INTERVAL 5 DAY <= TIMESTAMP '2024-01-12 00:00:00'")
def cat_expired(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return catalog.expired(e, "ts", "INTERVAL 5 DAY", F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")).select("event_id", "expires_at")


# SRC-19.
@query("cat_keys_offset", f"SELECT key, size, count(*) OVER () AS total FROM {_DOC_OBJECTS} WHERE bucket = 'src3' ORDER BY key LIMIT 15 OFFSET 20")
def cat_keys_offset(spark, sf_dir):
    return catalog.page_by_offset(doc_objects(spark, sf_dir).where("bucket = 'src3'").select("key", "size"), ["key"], 20, 15)


# SNK-02, SNK-04, SET-04.
@query("cat_delete_cascade", f"SELECT bucket, count(*) AS n_objects, sum(size)::BIGINT AS size FROM {_DOC_OBJECTS} WHERE bucket NOT IN ('src0', 'src7') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY bucket")
def cat_delete_cascade(spark, sf_dir):
    dropped = spark.createDataFrame([("src0",), ("src7",)], "bucket string")
    junk = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    left = doc_objects(spark, sf_dir).join(F.broadcast(dropped), "bucket", "left_anti").join(junk, "doc_id", "left_anti")
    return catalog.usage(left)


# SNK-14, SNK-15, FLT-16: delete requests for objects, some missing, retained or versioned.
@query(
    "cat_delete_actions",
    """WITH r AS (SELECT doc_id, doc_id % 5 <> 0 AS found, TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 60) * INTERVAL 1 DAY AS retain_until, doc_id % 7 = 0 AS bypass, doc_id % 2 = 0 AS versioned FROM documents)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN NOT found THEN 'missing' WHEN retain_until > TIMESTAMP '2024-01-31 00:00:00' AND NOT bypass THEN 'forbidden' WHEN versioned THEN 'marked' ELSE 'removed' END AS action FROM r) GROUP BY action""",
)
def cat_delete_actions(spark, sf_dir):
    i = F.col("doc_id")
    until = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((i % 60).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (i % 5 != 0).alias("found"), until.alias("retain_until"), (i % 7 == 0).alias("bypass"), (i % 2 == 0).alias("versioned"))
    return catalog.delete_action(rows, F.lit(AS_OF).cast("timestamp_ntz")).groupBy("action").agg(F.count("*").alias("n"))


# SNK-16, SNK-17: line items as the parts of an order's upload.
@query(
    "cat_complete_uploads",
    "SELECT l_orderkey AS upload_id, count(*) AS n_parts, sum(l_quantity)::BIGINT AS size, array_to_string(list_sort(list(l_linenumber)), ',') AS parts FROM lineitem GROUP BY l_orderkey",
)
def cat_complete_uploads(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("part_number"), F.col("l_quantity").cast("long").alias("size"))
    return catalog.complete_uploads(parts).withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ","))


# SNK-06, SCL-09.
@query("cat_move_tier", "SELECT CASE WHEN tier = 'HOT' THEN 'WARM' ELSE tier END AS tier, count(*) AS n FROM (SELECT CASE WHEN n_chars < 1000 THEN 'HOT' ELSE 'COLD' END AS tier FROM documents) GROUP BY 1")
def cat_move_tier(spark, sf_dir):
    o = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") < 1000, "HOT").otherwise("COLD").alias("tier"))
    return catalog.moved(o, "HOT", "WARM").groupBy("tier").agg(F.count("*").alias("n"))


_AGE = "(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 1e6"
_SCORES = f"""s AS (SELECT user_id, count(*) AS accesses, min(age) AS last_age, least(100.0, sum(exp(age * (-ln(2) / 604800.0))) / 10) AS frequency FROM (SELECT user_id, {_AGE} AS age FROM events) GROUP BY user_id),
a AS (SELECT *, CASE WHEN last_age < 3600 THEN 100.0 WHEN last_age < 86400 THEN 80.0 WHEN last_age < 604800 THEN 50.0 WHEN last_age < 2592000 THEN 20.0 ELSE 0.0 END::DOUBLE AS recency FROM s)"""


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# AGG-08, AGG-09, SCL-20.
@query("tier_frequency", f"WITH {_SCORES} SELECT user_id, accesses, round(frequency, 6) AS frequency FROM a")
def tier_frequency(spark, sf_dir):
    return tiering.access_scores(table(spark, sf_dir, "events"), ["user_id"], "ts", _as_of()).select("user_id", "accesses", F.round("frequency", 6).alias("frequency"))


@query("tier_recency", f"WITH {_SCORES} SELECT user_id, round(last_age, 6) AS last_age, recency FROM a")
def tier_recency(spark, sf_dir):
    return tiering.access_scores(table(spark, sf_dir, "events"), ["user_id"], "ts", _as_of()).select("user_id", F.round("last_age", 6).alias("last_age"), "recency")


def _tier_objects(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "image/png").when(F.col("c_mktsegment") == "MACHINERY", "video/mp4").when(F.col("c_mktsegment") == "HOUSEHOLD", "text/plain").otherwise("application/pdf")
    return c.select(
        F.col("c_custkey").alias("user_id"), kind.alias("content_type"), (F.abs("c_acctbal") * 200_000).cast("long").alias("size"), (F.col("c_nationkey") * 12).alias("priority"),
        F.when(F.col("c_nationkey") < 8, "HOT").when(F.col("c_nationkey") < 16, "WARM").otherwise("COLD").alias("tier"), (F.col("c_custkey") % 10 == 0).alias("pinned"),
    )


_SCORED = f"""WITH {_SCORES}, o AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 80.0 WHEN 'MACHINERY' THEN 60.0 WHEN 'HOUSEHOLD' THEN 70.0 ELSE 50.0 END AS content,
 trunc(abs(c_acctbal) * 200000)::BIGINT AS size, c_nationkey * 12 AS priority, CASE WHEN c_nationkey < 8 THEN 'HOT' WHEN c_nationkey < 16 THEN 'WARM' ELSE 'COLD' END AS tier, c_custkey % 10 = 0 AS pinned FROM customer),
z AS (SELECT *, CASE WHEN size < 1048576 THEN 80.0 WHEN size < 104857600 THEN 60.0 WHEN size < 1073741824 THEN 40.0 ELSE 20.0 END AS size_score FROM o JOIN a USING (user_id)),
f AS (SELECT user_id, tier, pinned, round(greatest(0.0, least(100.0, 0.4 * frequency + 0.3 * recency + 0.1 * content - 0.1 * size_score + 0.1 * priority)), 6)::DOUBLE AS score FROM z),
t AS (SELECT *, CASE WHEN score > 80 THEN 'HOT' WHEN score > 60 THEN 'WARM' WHEN score > 20 THEN 'COLD' ELSE 'ARCHIVE' END AS target_tier FROM f)"""


# TIR-01, TIR-02, SCL-21, JON-10.
@query("tier_score", _SCORED + " SELECT user_id, score, target_tier FROM t")
def tier_score(spark, sf_dir):
    return tiering.scored(_tier_objects(spark, sf_dir), table(spark, sf_dir, "events"), ["user_id"], "ts", _as_of()).select("user_id", "score", "target_tier")


# TIR-03, TIR-04, TOP-12.
@query("tier_decisions", _SCORED + " SELECT user_id, tier, target_tier, score, 'score ' || printf('%.2f', score) || ': ' || tier || ' to ' || target_tier AS reason FROM t WHERE tier <> target_tier AND NOT pinned")
def tier_decisions(spark, sf_dir):
    scored = tiering.scored(_tier_objects(spark, sf_dir), table(spark, sf_dir, "events"), ["user_id"], "ts", _as_of())
    return tiering.decisions(scored).select("user_id", "tier", "target_tier", "score", "reason")


# WIN-05.
@query("win_rolling_10m", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def win_rolling_10m(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return tiering.trailing_counts(e, ["event_type"], "ts", 600).select("event_id", "in_window")


# AGG-10, TIR-05, JON-11.
@query(
    "tier_hotspots",
    """SELECT user_id, max(c) AS peak FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS c FROM events)
GROUP BY user_id HAVING max(c) > 5.0 AND max(c) > 6""",
)
def tier_hotspots(spark, sf_dir):
    return tiering.hotspots(table(spark, sf_dir, "events"), ["user_id"], "ts", 86_400, least=6)


# WIN-03, AGG-26.
@query("win_last_n", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS place FROM events QUALIFY place <= 5")
def win_last_n(spark, sf_dir):
    return catalog.last_n(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).drop("ts")


# WIN-04.
@query("win_timeline", "SELECT user_id, max(ts) AS latest, count(*) AS n FROM events GROUP BY user_id ORDER BY latest DESC, user_id LIMIT 50")
def win_timeline(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("latest"), F.count("*").alias("n")).orderBy(F.desc("latest"), "user_id").limit(50)


RULES = [
    ("created", ["s3:ObjectCreated:*"], "*", "", "", "webhook"),
    ("images", ["s3:ObjectCreated:Put", "s3:ObjectAccessed:*"], "*", "images/", ".jpg", "webhook"),
    ("deletes", ["s3:ObjectRemoved:Delete"], "bucket1", "logs/", "", "queue"),
    ("none", ["s3:ObjectRemoved:DeleteMarkerCreated"], "*", "", "", "webhook"),
]


def rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, patterns array<string>, rule_bucket string, prefix string, suffix string, destination string")


_RULES = "r(rule_id, patterns, rule_bucket, prefix, suffix, destination) AS (VALUES " + ", ".join(f"('{r[0]}', {r[1]}, '{r[2]}', '{r[3]}', '{r[4]}', '{r[5]}')" for r in RULES) + ")"
_MATCHED = f"""WITH {_RULES}, m AS (SELECT e.*, r.* FROM {_EVENT_LOG} e JOIN r ON len(list_filter(patterns, lambda p: p = event_type OR (p LIKE '%:*' AND starts_with(event_type, p[:-2])))) > 0
 AND (rule_bucket = '*' OR rule_bucket = bucket) AND starts_with(key, prefix) AND ends_with(key, suffix))"""


# JON-06, JON-07, FLT-10, FLT-11, STR-02.
@query("evt_rule_match", _MATCHED + " SELECT event_id, rule_id FROM m")
def evt_rule_match(spark, sf_dir):
    return events.matches(event_log(spark, sf_dir), rules(spark)).select("event_id", "rule_id")


# STR-03, AGG-13.
@query("evt_route_counts", _MATCHED + " SELECT rule_id, CASE WHEN destination = 'webhook' THEN 'delivered' ELSE 'failed' END AS outcome, count(*) AS n FROM m GROUP BY ALL")
def evt_route_counts(spark, sf_dir):
    return events.deliveries(events.matches(event_log(spark, sf_dir), rules(spark))).groupBy("rule_id", "outcome").agg(F.count("*").alias("n"))


# STR-04, SCL-19.
@query(
    "evt_retry_schedule",
    """SELECT event_id, a::INT AS attempt, least(16000, 1000 * 2 ** a)::BIGINT AS delay_ms, list_sum(list_transform(range(0, a + 1), lambda i: least(16000, 1000 * 2 ** i)))::BIGINT AS at_ms
FROM (SELECT event_id, unnest(range(0, 6)) AS a FROM events WHERE event_type = 'error')""",
)
def evt_retry_schedule(spark, sf_dir):
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id")
    return events.retry_schedule(failed, 6, 1000, 16_000)


# STR-20.
@query("evt_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def evt_tumbling(spark, sf_dir):
    w = events.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"])
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "evt_sliding",
    """SELECT window_start, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS window_start FROM events) GROUP BY ALL""",
)
def evt_sliding(spark, sf_dir):
    w = events.sliding(table(spark, sf_dir, "events"), "ts", "24 hours", "6 hours", ["event_type"])
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# STR-17.
@query(
    "evt_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def evt_session(spark, sf_dir):
    w = events.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", ["user_id"])
    return w.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


# STR-09.
@query(
    "evt_concurrency",
    """WITH e AS (SELECT user_id, ts AS at_ts, 1 AS step FROM events UNION ALL SELECT user_id, ts + INTERVAL 3 HOUR, -1 FROM events),
p AS (SELECT user_id, at_ts, sum(step) AS net, sum((step > 0)::INT) AS starts FROM e GROUP BY ALL), r AS (SELECT *, sum(net) OVER (PARTITION BY user_id ORDER BY at_ts)::BIGINT AS running FROM p)
SELECT user_id, at_ts, running, running > 2 AS over FROM r WHERE starts > 0""",
)
def evt_concurrency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 3 HOUR")).alias("until"))
    return events.concurrency(e, "user_id", "ts", "until", 2).withColumnRenamed("at", "at_ts")


# SCL-01, SCL-02, PIP-03.
_PII = "text"
for _p, _s in S.pii_rules():
    _PII = f"regexp_replace({_PII}, '{_p}', '\\1{_s}\\2', 'g')"


@query("pip_pii_redact", f"SELECT doc_id, r <> text AS changed, sha256(r) AS sha FROM (SELECT doc_id, text, {_PII} AS r FROM documents)")
def pip_pii_redact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", S.redact_pii(F.col("text")).alias("r"))
    return d.select("doc_id", (F.col("r") != F.col("text")).alias("changed"), F.sha2("r", 256).alias("sha"))


@query("scl_mask", "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '****' ELSE substring(c_name, 1, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) END AS masked FROM customer")
def scl_mask(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.mask_string(F.col("c_name")).alias("masked"))


# SCL-03.
@query(
    "scl_parse_size",
    """SELECT p_partkey, s AS size_text, CASE WHEN u = '' THEN NULL ELSE n::BIGINT * (CASE u WHEN 'B' THEN 1 WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1099511627776 END) END::BIGINT AS bytes
FROM (SELECT p_partkey, s, regexp_extract(upper(trim(s)), '^(\\d+)\\s*(B|KB|MB|GB|TB)$', 1) AS n, regexp_extract(upper(trim(s)), '^(\\d+)\\s*(B|KB|MB|GB|TB)$', 2) AS u
FROM (SELECT p_partkey, p_size || CASE p_partkey % 6 WHEN 0 THEN 'gb' WHEN 1 THEN ' MB' WHEN 2 THEN 'B' WHEN 3 THEN 'Kb ' WHEN 4 THEN 'xb' ELSE 'TB' END AS s FROM part))""".replace("\\\\", "\\"),
)
def scl_parse_size(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("gb", " MB", "B", "Kb ", "xb", "TB")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = p.select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("size_text"))
    return p.withColumn("bytes", S.parse_size(F.col("size_text")))


# SCL-04.
@query(
    "scl_format_size",
    """SELECT p_partkey, CASE WHEN n >= 1099511627776 THEN (n // 1099511627776) || 'TB' WHEN n >= 1073741824 THEN (n // 1073741824) || 'GB' WHEN n >= 1048576 THEN (n // 1048576) || 'MB' WHEN n >= 1024 THEN (n // 1024) || 'KB' ELSE n || 'B' END AS formatted
FROM (SELECT p_partkey, p_partkey * p_partkey * p_size::BIGINT * 17 AS n FROM part)""",
)
def scl_format_size(spark, sf_dir):
    n = F.col("p_partkey") * F.col("p_partkey") * F.col("p_size").cast("long") * 17
    return table(spark, sf_dir, "part").select("p_partkey", S.format_size(n).alias("formatted"))


# FTS-06.
@query("scl_sha_docid", "SELECT doc_id, substring(sha256(source || '#' || doc_id || '#v1'), 1, 16) AS hex_id FROM documents")
def scl_sha_docid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.document_id_hex(F.col("source"), F.col("doc_id").cast("string"), F.lit("v1")).alias("hex_id"))


# SCL-05, SCL-06.
@query("scl_checksum", "SELECT doc_id, sha256(text) AS sha, md5(text) AS etag FROM documents")
def scl_checksum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("etag"))


# SCL-07, SCL-08.
@query("scl_prefixes", rf"SELECT page_id, regexp_extract(key, '^(.*/)', 1) AS parent, CASE WHEN starts_with(key, 'en/') AND instr(substring(key, 4), '/') > 0 THEN 'en/' || substring(substring(key, 4), 1, instr(substring(key, 4), '/')) END AS common FROM {_PAGE_OBJECTS}")
def scl_prefixes(spark, sf_dir):
    return page_objects(spark, sf_dir).select("page_id", S.parent_prefix(F.col("key")).alias("parent"), S.common_prefix(F.col("key"), "en/", "/").alias("common"))


# SRC-10.
@query("scl_byte_range", "SELECT doc_id, CASE WHEN text <> '' THEN hex(array_slice(encode(text), 1, 10)) END AS head, CASE WHEN strlen(text) > 7 THEN hex(array_slice(encode(text), 8, strlen(text))) END AS rest, hex(array_slice(encode(text), greatest(strlen(text) - 6, 1), strlen(text))) AS tail FROM documents")
def scl_byte_range(spark, sf_dir):
    data = F.col("text").cast("binary")
    part = lambda r: F.hex(S.byte_range(data, r))
    return table(spark, sf_dir, "documents").select("doc_id", part("bytes=0-9").alias("head"), part("bytes=7-").alias("rest"), part("bytes=-7").alias("tail"))


# SCL-11.
@query(
    "scl_worker",
    """SELECT user_id, (list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(user_id::VARCHAR, ''), lambda c: ascii(c)::HUGEINT)), lambda h, x: (xor(h::BIGINT, x::BIGINT)::HUGEINT * 16777619) % 4294967296) % 16)::INT AS worker
FROM (SELECT DISTINCT user_id FROM events)""",
)
def scl_worker(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select("user_id", S.fnv1a_worker(F.col("user_id").cast("string")).alias("worker"))


# PIP-04, SCL-23, PRJ-01.
@query("pip_metadata", "SELECT doc_id, 'text/plain' AS content_type, octet_length(encode(text))::INT AS bytes, lang FROM documents")
def pip_metadata(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("text/plain").alias("content_type"), F.octet_length("text").alias("bytes"), "lang")


# AGG-14.
@query(
    "agg_percentile_lower",
    """SELECT event_type, count(*) AS n, list_sort(list(value))[1 + ((count(*) - 1) * 50 // 100)] AS p50, list_sort(list(value))[1 + ((count(*) - 1) * 95 // 100)] AS p95,
 list_sort(list(value))[1 + ((count(*) - 1) * 99 // 100)] AS p99 FROM events GROUP BY event_type""",
)
def agg_percentile_lower(spark, sf_dir):
    return ops.percentile_lower(table(spark, sf_dir, "events"), ["event_type"], "value", [50, 95, 99])


# AGG-17.
@query("agg_status_class", "SELECT CASE WHEN c BETWEEN 100 AND 499 THEN (c // 100) || 'xx' ELSE '5xx' END AS status, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT 100 + event_id % 520 AS c, value FROM events) GROUP BY 1")
def agg_status_class(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(S.status_class(F.lit(100) + F.col("event_id") % 520).alias("status"), "value")
    return e.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# AGG-16, SNK-11.
@query(
    "agg_histogram",
    """SELECT event_type, b.le, CASE WHEN b.le = '+Inf' THEN count(value) ELSE sum((value <= b.x)::BIGINT)::BIGINT END AS n FROM events, (VALUES ('1', 1.0), ('5', 5.0), ('10', 10.0), ('25', 25.0), ('50', 50.0), ('+Inf', NULL)) b(le, x) GROUP BY event_type, b.le""",
)
def agg_histogram(spark, sf_dir):
    return ops.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [1, 5, 10, 25, 50])


def task_runs(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("task_type"), (F.col("event_type") != "error").alias("success"), (k % 4).alias("retries"), F.col("value").alias("duration"))


# AGG-11, AGG-12.
@query(
    "agg_task_stats",
    """SELECT task_type, count(*) AS runs, sum(success::BIGINT)::BIGINT AS ok, (count(*) - sum(success::BIGINT))::BIGINT AS failed, max(retries) AS max_retries, round(avg(duration), 6) AS avg_duration, round(avg(success::INT::DOUBLE), 6) AS success_rate
FROM (SELECT user_id % 8 AS task_type, event_type <> 'error' AS success, (props->>'$.k')::INT % 4 AS retries, value AS duration FROM events) GROUP BY task_type""",
)
def agg_task_stats(spark, sf_dir):
    return ops.task_stats(task_runs(spark, sf_dir), ["task_type"])


@query("agg_success_rate", "SELECT round(avg((event_type <> 'error')::INT::DOUBLE), 6) AS success_rate FROM events")
def agg_success_rate(spark, sf_dir):
    return ops.task_stats(task_runs(spark, sf_dir), []).select("success_rate")


# AGG-18.
@query(
    "agg_capped_metrics",
    """WITH f AS (SELECT user_id % 3 AS plugin, user_id AS name, min(event_id) AS first, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY plugin ORDER BY first, name) AS p FROM f)
SELECT plugin, sum(CASE WHEN p <= 20 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN p <= 20 THEN 0 ELSE n END)::BIGINT AS overflow FROM r GROUP BY plugin""",
)
def agg_capped_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("plugin"), F.col("user_id").alias("name"), "event_id")
    return ops.capped_metrics(p, "plugin", "name", "event_id", 20)


# AGG-21.
@query(
    "agg_content_checksum",
    """WITH a AS (SELECT source, doc_id // 1000 AS s, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY ALL),
b AS (SELECT source, s // 1000 AS s2, sha256(string_agg(h, '' ORDER BY s)) AS h, sum(n) AS n FROM a GROUP BY ALL) SELECT source, sha256(string_agg(h, '' ORDER BY s2)) AS checksum, sum(n)::BIGINT AS n FROM b GROUP BY source""",
)
def agg_content_checksum(spark, sf_dir):
    return catalog.content_checksum(table(spark, sf_dir, "documents"), ["source"], F.col("text"), "doc_id")


# STR-15, JON-12, SRC-17.
@query("flow_last_terminal", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id")
def flow_last_terminal(spark, sf_dir):
    return ops.last_terminal(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], ["error", "purchase"])


@query("flow_to_replay", "SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id) WHERE last = 'error'")
def flow_to_replay(spark, sf_dir):
    return ops.to_replay(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], ["error", "purchase"], ["error"]).select("user_id")


# AGG-27.
@query(
    "flow_metrics",
    """SELECT user_id % 5 AS workflow, sum((event_type = 'signup')::BIGINT)::BIGINT AS started, sum((event_type = 'purchase')::BIGINT)::BIGINT AS completed, sum((event_type = 'error')::BIGINT)::BIGINT AS failed,
 (sum((event_type = 'signup')::BIGINT) - sum((event_type = 'purchase')::BIGINT) - sum((event_type = 'error')::BIGINT))::BIGINT AS running FROM events GROUP BY 1""",
)
def flow_metrics(spark, sf_dir):
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("workflow"))
    return g.agg(n("signup").alias("started"), n("purchase").alias("completed"), n("error").alias("failed"), (n("signup") - n("purchase") - n("error")).alias("running"))


# BKP-01, D18.
@query("bkp_delta", "SELECT event_id, user_id, value FROM events WHERE event_id > 7000")
def bkp_delta(spark, sf_dir):
    return ops.delta(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id", 7000)


# SET-06.
@query("bkp_restore", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def bkp_restore(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return ops.restored(e.where("event_id <= 5000"), [e.where("event_id > 5000 AND event_id <= 8000"), ops.delta(e, "event_id", 8000)], ["user_id"], "event_id")


# BKP-02.
@query("bkp_retention", "SELECT o_orderkey, o_orderdate FROM orders WHERE date_diff('day', o_orderdate::DATE, DATE '1999-01-31') > 365")
def bkp_retention(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"))
    return ops.expired_backups(b, F.lit("1999-01-31").cast("date"), [7, 30, 365]).select("o_orderkey", F.col("created_at").alias("o_orderdate"))


# AGG-19, RPL-01.
@query(
    "rpl_status",
    """WITH j AS (SELECT 'b' || (user_id % 3) AS bucket, user_id AS job_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'pending' END AS status FROM events),
l AS (SELECT bucket, job_id, arg_max(status, seq) AS status FROM j GROUP BY ALL)
SELECT bucket, sum((status = 'pending')::BIGINT)::BIGINT AS pending, sum((status = 'failed')::BIGINT)::BIGINT AS failed, sum((status = 'completed')::BIGINT)::BIGINT AS completed FROM l GROUP BY bucket""",
)
def rpl_status(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    j = table(spark, sf_dir, "events").select(F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("bucket"), F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"))
    return ops.replication_status(j)


# INT-01, AGG-28, FLT-19: every 50th stored checksum is wrong.
@query("int_scrub", "SELECT count(*) AS checked, sum((doc_id % 50 = 0)::BIGINT)::BIGINT AS corrupt, 0::BIGINT AS unreadable FROM documents WHERE n_chars >= 1000")
def int_scrub(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored = F.when(F.col("doc_id") % 50 == 0, F.lit("0")).otherwise(F.sha2("text", 256))
    o = d.select(F.col("text").cast("binary").alias("content"), stored.alias("checksum"), F.when(F.col("n_chars") < 1000, "HOT").otherwise("COLD").alias("tier"))
    return ops.scrubbed(o, ["COLD"])


# FLT-13.
@query("pol_glob", "SELECT url, page_id FROM pages WHERE url LIKE 'http%://%.example.com/__/%'")
def pol_glob(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(P.glob_match(F.col("url"), "http*://*.example.com/??/*")).select("url", "page_id")


# SCL-17.
@query(
    "pol_cidr",
    """SELECT event_id, c.cidr, CASE WHEN c.cidr = '*' THEN true ELSE (ip // (2 ** (32 - c.bits))::BIGINT) = (c.net // (2 ** (32 - c.bits))::BIGINT) END AS inside
FROM (SELECT event_id, (10 * 16777216 + (user_id % 3) * 65536 + (user_id % 7) * 256 + event_id % 256)::BIGINT AS ip FROM events),
(VALUES ('10.0.0.0/8', 167772160::BIGINT, 8), ('10.1.0.0/16', 167837696, 16), ('10.2.3.0/24', 167904000, 24), ('10.0.0.128/25', 167772288, 25), ('*', 0, 0)) c(cidr, net, bits)""",
)
def pol_cidr(spark, sf_dir):
    ip = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 3).cast("string"), (F.col("user_id") % 7).cast("string"), (F.col("event_id") % 256).cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", ip.alias("ip"))
    ranges = F.array(*[F.lit(c) for c in ("10.0.0.0/8", "10.1.0.0/16", "10.2.3.0/24", "10.0.0.128/25", "*")])
    e = e.select("event_id", "ip", F.explode(ranges).alias("cidr"))
    return e.select("event_id", "cidr", P.ip_in_range_v4(F.col("ip"), F.col("cidr")).alias("inside"))
