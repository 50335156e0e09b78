"""Registered queries: policies, pipelines, quantizers and indexes, sequential decisions, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import ann, knn, pipelines, policy, sequential
from ..sources.tables import table, written
from ..streaming import flows
from . import lake
from .registry import query
from .search import query_vector, vecs

_REQUESTS = """q AS (SELECT event_id AS request_id, 'user' || (user_id % 5) AS principal, CASE event_type WHEN 'signup' THEN 's3:PutObject' WHEN 'purchase' THEN 's3:DeleteObject' WHEN 'error' THEN 'iam:CreateUser' WHEN 'view' THEN 's3:GetObject' ELSE 's3:ListBucket' END AS action,
 'arn:aws:s3:::bucket' || (user_id % 4) || '/' || (CASE WHEN event_id % 2 = 0 THEN 'public/' ELSE 'private/' END) || event_id AS resource FROM events)"""


def requests(spark, sf_dir: str) -> DataFrame:
    action = (
        F.when(F.col("event_type") == "signup", "s3:PutObject").when(F.col("event_type") == "purchase", "s3:DeleteObject").when(F.col("event_type") == "error", "iam:CreateUser")
        .when(F.col("event_type") == "view", "s3:GetObject").otherwise("s3:ListBucket")
    )
    resource = F.concat(F.lit("arn:aws:s3:::bucket"), (F.col("user_id") % 4).cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit("/public/")).otherwise(F.lit("/private/")), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("user"), (F.col("user_id") % 5).cast("string")).alias("principal"), action.alias("action"), resource.alias("resource"))


# (ordinal, sid, policy type, effect, owner, principals, actions, not actions, resources, not resources)
STATEMENTS = [
    (1, "org-s3", "scp", "Allow", None, None, ["s3:*"], None, ["*"], None),
    (2, "org-nodelete", "scp", "Deny", None, None, ["s3:DeleteObject"], None, ["arn:aws:s3:::bucket3/*"], None),
    (3, "read", "identity", "Allow", "user0", None, ["s3:Get*", "s3:List*"], None, ["*"], None),
    (4, "all", "identity", "Allow", "user1", None, ["*"], None, ["*"], None),
    (5, "no-private", "identity", "Deny", "user1", None, ["s3:*"], None, ["arn:aws:s3:::*/private/*"], None),
    (6, "write", "identity", "Allow", "user2", None, None, ["s3:Get*"], ["arn:aws:s3:::bucket?/*"], None),
    (7, "edge", "boundary", "Allow", "user2", None, ["s3:PutObject"], None, ["*"], None),
    (8, "public", "resource", "Allow", None, ["*"], ["s3:GetObject"], None, ["arn:aws:s3:::bucket0/public/*"], None),
    (9, "closed", "resource", "Deny", None, ["user3"], ["s3:*"], None, None, ["arn:aws:s3:::bucket1/*"]),
]


def statements(spark) -> DataFrame:
    a = "array<string>"
    return spark.createDataFrame(STATEMENTS, f"ordinal int, sid string, policy_type string, effect string, owner string, principals {a}, actions {a}, not_actions {a}, resources {a}, not_resources {a}")


def _sql_value(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" if isinstance(v, str) else "[" + ", ".join(f"'{x}'" for x in v) + "]"


_LIKE = "len(list_filter({1}, lambda g: {0} LIKE replace(replace(g, '*', '%'), '?', '_'))) > 0"
_HITS = f"""{_REQUESTS}, s(ordinal, sid, policy_type, effect, owner, principals, actions, not_actions, resources, not_resources) AS (VALUES {", ".join("(" + ", ".join(_sql_value(v) for v in s) + ")" for s in STATEMENTS)}),
h AS (SELECT q.*, s.ordinal, s.sid, s.policy_type, s.effect FROM q LEFT JOIN s ON (owner IS NULL OR owner = principal) AND (principals IS NULL OR {_LIKE.format("principal", "principals")})
 AND (CASE WHEN not_actions IS NOT NULL THEN NOT ({_LIKE.format("action", "not_actions")}) ELSE {_LIKE.format("action", "actions")} END)
 AND (CASE WHEN not_resources IS NOT NULL THEN NOT ({_LIKE.format("resource", "not_resources")}) ELSE {_LIKE.format("resource", "resources")} END)),
f AS (SELECT request_id, principal, arg_min(CASE WHEN policy_type = 'scp' AND effect = 'Deny' THEN sid END, ordinal) AS scp_deny, arg_min(CASE WHEN policy_type = 'scp' AND effect = 'Allow' THEN sid END, ordinal) AS scp_allow,
 arg_min(CASE WHEN policy_type IN ('identity', 'resource') AND effect = 'Deny' THEN sid END, ordinal) AS deny, arg_min(CASE WHEN policy_type = 'identity' AND effect = 'Allow' THEN sid END, ordinal) AS identity,
 arg_min(CASE WHEN policy_type = 'resource' AND effect = 'Allow' THEN sid END, ordinal) AS resource, arg_min(CASE WHEN policy_type = 'boundary' AND effect = 'Allow' THEN sid END, ordinal) AS boundary FROM h GROUP BY ALL)"""


# POL-01, POL-03, POL-05, POL-06, POL-08, JON-08, JON-09, SET-05.
@query(
    "pol_decision",
    f"""WITH {_HITS} SELECT request_id, CASE WHEN scp_deny IS NOT NULL OR scp_allow IS NULL OR deny IS NOT NULL THEN 'deny' WHEN identity IS NOT NULL THEN CASE WHEN principal = 'user2' AND boundary IS NULL THEN 'deny' ELSE 'allow' END
 WHEN resource IS NOT NULL THEN 'allow' ELSE 'implicit_deny' END AS decision, CASE WHEN scp_deny IS NOT NULL THEN 'scp:' || scp_deny WHEN scp_allow IS NULL THEN 'scp' WHEN deny IS NOT NULL THEN 'explicit:' || deny
 WHEN identity IS NOT NULL THEN CASE WHEN principal = 'user2' AND boundary IS NULL THEN 'boundary' ELSE 'identity:' || identity END WHEN resource IS NOT NULL THEN 'resource:' || resource ELSE 'none' END AS matched_by FROM f""",
)
def pol_decision(spark, sf_dir):
    return policy.evaluate(requests(spark, sf_dir), statements(spark))


# POL-02: with the boundary, without the organisation's gate.
@query(
    "pol_boundary",
    f"""WITH {_HITS} SELECT request_id, CASE WHEN deny IS NOT NULL THEN 'deny' WHEN identity IS NOT NULL THEN CASE WHEN principal = 'user2' AND boundary IS NULL THEN 'deny' ELSE 'allow' END WHEN resource IS NOT NULL THEN 'allow' ELSE 'implicit_deny' END AS decision FROM f""",
)
def pol_boundary(spark, sf_dir):
    return policy.evaluate(requests(spark, sf_dir), statements(spark), with_scp=False).select("request_id", "decision")


CONDITIONS = [
    ("c1", "StringEquals", "type", ["click", "view"]), ("c2", "StringNotEquals", "type", ["click"]), ("c3", "StringLike", "type", ["*i?k", "sign*"]), ("c4", "StringNotLike", "type", ["p*"]),
    ("c5", "NumericLessThan", "value", ["20"]), ("c6", "NumericGreaterThan", "value", ["20.5"]), ("c7", "NumericEquals", "user", ["7", "8"]), ("c8", "IpAddress", "ip", ["10.1.0.0/16"]), ("c9", "NotIpAddress", "ip", ["10.1.0.0/16"]),
    ("c10", "Bool", "even", ["TRUE"]), ("c11", "Null", "absent", ["true"]), ("c12", "Null", "type", ["true"]), ("c13", "StringEquals", "absent", ["x"]), ("c14", "DateLessThan", "day", ["2024-01-15T00:00:00Z"]),
]


# POL-07, SCL-13 to SCL-17, D19.
@query(
    "pol_conditions",
    """WITH e AS (SELECT event_type AS t, value AS v, user_id AS u, ts::DATE AS d FROM events), c AS (SELECT t IN ('click', 'view') AS c1, t <> 'click' AS c2, t LIKE '%i_k' OR t LIKE 'sign%' AS c3, NOT t LIKE 'p%' AS c4, v < 20 AS c5, v > 20.5 AS c6, u IN (7, 8) AS c7,
 u % 3 = 1 AS c8, u % 3 <> 1 AS c9, u % 2 = 0 AS c10, true AS c11, false AS c12, false AS c13, d < DATE '2024-01-15' AS c14 FROM e)
SELECT k AS condition, sum(v::BIGINT)::BIGINT AS n FROM (UNPIVOT c ON COLUMNS(*) INTO NAME k VALUE v) GROUP BY k""",
)
def pol_conditions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    context = F.create_map(
        F.lit("type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"), F.lit("user"), F.col("user_id").cast("string"), F.lit("even"), (F.col("user_id") % 2 == 0).cast("string"),
        F.lit("ip"), F.concat(F.lit("10."), (F.col("user_id") % 3).cast("string"), F.lit(".0.9")), F.lit("day"), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00Z")),
    )
    c = spark.createDataFrame(CONDITIONS, "condition string, operator string, key string, expected array<string>")
    both = e.select(context.alias("context")).join(F.broadcast(c))
    hit = policy.condition_matches(F.col("operator"), F.col("key"), F.col("expected"), F.col("context"))
    return both.groupBy("condition").agg(F.sum(hit.cast("long")).alias("n"))


# FLT-12: the condition language over typed columns.
@query("flt_condition", "SELECT event_id FROM events WHERE (event_type IN ('click', 'view') AND NOT value > 50) OR (starts_with(event_type, 'sig') AND hour(ts) >= 12 AND length(event_type) = 6)")
def flt_condition(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = "(type in ['click', 'view'] && !(value > 50)) || (type.startsWith('sig') && time.getHours() >= 12 && size(type) == 6)"
    return e.where(P.compile_condition(text, {"type": F.col("event_type"), "value": F.col("value"), "time": F.col("ts")}, {"type": "string", "value": "number", "time": "time"})).select("event_id")


PIPELINES = [
    pipelines.Pipeline("text", "on_put", (pipelines.Step("pii", "encrypt_pii"),), "content_type == 'text/*' and size > 2KB"),
    pipelines.Pipeline("french", "on_put", (pipelines.Step("meta", "extract_metadata"),), 'metadata.lang == "fr" or metadata.lang == "de"'),
    pipelines.Pipeline("any", "on_put", (pipelines.Step("meta", "extract_metadata"),)),
    pipelines.Pipeline("off", "on_put", (pipelines.Step("meta", "extract_metadata"),), enabled=False),
    pipelines.Pipeline("read", "on_get", (pipelines.Step("meta", "extract_metadata"),)),
]


def lake_objects(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, F.lit("image/png")).otherwise(F.lit("text/plain"))
    return d.select("doc_id", "text", kind.alias("content_type"), F.col("n_chars").alias("size"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))


# FLT-07 to FLT-09, D12 to D15.
@query(
    "pip_filter_match",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 <> 0 AND n_chars > 2048 THEN 'text' END, CASE WHEN lang IN ('fr', 'de') THEN 'french' END, 'any'], lambda x: x IS NOT NULL), ',') AS pipelines FROM documents""",
)
def pip_filter_match(spark, sf_dir):
    return pipelines.matching(lake_objects(spark, sf_dir), PIPELINES, "on_put").select("doc_id", F.array_join("pipelines", ",").alias("pipelines"))


# PIP-01 to PIP-05, PIP-07, UDF-01, UDF-02.
@query(
    "pip_execution_log",
    """SELECT status, count(*) AS n FROM (SELECT unnest(CASE WHEN doc_id % 4 = 0 THEN ['compress:ok', 'video:skipped', 'pii:ok', 'last:ok'] ELSE ['compress:skipped', 'video:skipped', 'pii:ok', 'last:error'] END) AS status FROM documents) GROUP BY status""",
)
def pip_execution_log(spark, sf_dir):
    s = pipelines.Step
    p = pipelines.Pipeline("all", "on_put", (s("compress", "compress_image", "skip"), s("video", "transcode_video", "skip"), s("pii", "encrypt_pii"), s("last", "thumbnail")))
    done = pipelines.execute(lake_objects(spark, sf_dir), p, pipelines.default_registry())
    log = done.select(F.explode("steps").alias("s")).select(F.concat("s.name", F.lit(":"), "s.status").alias("status"))
    return log.groupBy("status").agg(F.count("*").alias("n"))


# AGG-24, VEC-08.
@query("vec_sq8_train", "SELECT (d - 1)::INT AS dim, min(embedding[d]::DOUBLE) AS lo, max(embedding[d]::DOUBLE) AS hi FROM embeddings, range(1, 65) r(d) GROUP BY d")
def vec_sq8_train(spark, sf_dir):
    return ann.scalar_ranges(vecs(spark, sf_dir))


@query(
    "vec_sq8_roundtrip",
    """WITH x AS (SELECT vec_id, d, embedding[d]::DOUBLE AS x FROM embeddings, range(1, 65) r(d)), r AS (SELECT d, min(x) AS lo, max(x) AS hi FROM x GROUP BY d),
c AS (SELECT vec_id, d, x, lo, hi, CASE WHEN hi = lo THEN 0 ELSE floor(least(1.0, greatest(0.0, (x - lo) / (hi - lo))) * 255) END AS c FROM x JOIN r USING (d))
SELECT vec_id, sum(c)::BIGINT AS code_sum, round(max(abs(lo + c / 255 * (hi - lo) - x)), 6) AS worst FROM c GROUP BY vec_id""",
)
def vec_sq8_roundtrip(spark, sf_dir):
    v = vecs(spark, sf_dir)
    c = ann.scalar_codes(v, ann.scalar_ranges(v))
    worst = F.array_max(F.zip_with("decoded", F.col("embedding").cast("array<double>"), lambda a, b: F.abs(a - b)))
    return c.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.round(worst, 6).alias("worst"))


def label_centroids(spark, sf_dir: str) -> DataFrame:
    """Fixed centroids: the first vector of each label."""
    return vecs(spark, sf_dir).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centroid")).select(F.col("label").alias("cid"), F.col("centroid").cast("array<double>").alias("centroid"))


_E = "list_transform(embedding, lambda x: x::DOUBLE)"
_IVF = f"""v AS (SELECT vec_id, label, {_E} AS e FROM embeddings), c AS (SELECT label AS cid, arg_min(e, vec_id) AS ce FROM v GROUP BY label),
d AS (SELECT vec_id, e, cid, round(list_sum(list_transform(list_zip(e, ce), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance FROM v, c),
a AS (SELECT vec_id, e, cid, distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cid) = 1)"""


# JON-13, VEC-10.
@query("vec_ivf_assign", f"WITH {_IVF} SELECT vec_id, cid, round(distance, 6) AS distance FROM a")
def vec_ivf_assign(spark, sf_dir):
    return ann.assign(vecs(spark, sf_dir), label_centroids(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


# VEC-10, VEC-11, OPT-07.
@query(
    "vec_ivf_probe",
    f"""WITH {_IVF}, q AS (SELECT e AS qe FROM v ORDER BY vec_id LIMIT 1), p AS (SELECT cid FROM c, q ORDER BY round(list_sum(list_transform(list_zip(ce, qe), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), cid LIMIT 3)
SELECT vec_id, round(list_sum(list_transform(list_zip(e, qe), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM a, q WHERE cid IN (SELECT cid FROM p) ORDER BY distance, vec_id LIMIT 10""",
)
def vec_ivf_probe(spark, sf_dir):
    c = label_centroids(spark, sf_dir)
    v = vecs(spark, sf_dir)
    return ann.probe(v, ann.assign(v, c), c, query_vector(spark, sf_dir), 3, 10)


# VEC-07, VEC-09, VEC-15, VEC-16, OPT-08: approximate; the tests hold its recall.
@query("vec_pq_search")
def vec_pq_search(spark, sf_dir):
    v = vecs(spark, sf_dir)
    pq = ann.train_pq(v, bits=5)
    return ann.stitched_search(v, ann.encode_pq(v, pq), pq, query_vector(spark, sf_dir))


# VEC-12 to VEC-14, GRF-01, GRF-02, SRC-13: the graphs are built once and written, the search reads them; approximate, the tests hold its recall.
@query("vec_graph_search")
def vec_graph_search(spark, sf_dir):
    return ann.graph_search(written(ann.graph_index(vecs(spark, sf_dir))), query_vector(spark, sf_dir))


# EMB-01, VEC-21, VEC-22: texts embedded and searched by an embedded text.
@query("vec_search_by_text")
def vec_search_by_text(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), ann.hash_embedding(F.col("text"), 16).alias("embedding"))
    probe = spark.createDataFrame([("the thing",)], "text string").select(ann.hash_embedding(F.col("text"), 16).alias("v")).first().v
    return knn.nearest(b, probe, 5)


# VEC-26.
@query("vec_merge_candidates", "SELECT label AS segment_id, count(*) AS n_rows FROM embeddings GROUP BY label ORDER BY n_rows, segment_id LIMIT 3")
def vec_merge_candidates(spark, sf_dir):
    s = vecs(spark, sf_dir).groupBy(F.col("label").alias("segment_id")).agg(F.count("*").alias("n_rows"))
    return ann.merge_candidates(s, 1000, 10)


def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), (F.col("event_type") != "error").alias("ok"))


# STR-05, WIN-06: decisions depend on decisions before, which SQL cannot express; the tests compare with plain loops.
@query("lim_sliding_window")
def lim_sliding_window(spark, sf_dir):
    def machine():
        w = sequential.SlidingWindow(3, 6 * 3_600_000, 60_000)
        return lambda r: w.allow(r.at_ms)

    return sequential.fold(_calls(spark, sf_dir), ["user_id"], ["at_ms", "event_id"], machine, "allowed", "boolean")


# STR-06.
@query("lim_token_bucket")
def lim_token_bucket(spark, sf_dir):
    def machine():
        b = sequential.TokenBucket(1 / 7200, 2)
        return lambda r: b.allow(r.at_ms)

    return sequential.fold(_calls(spark, sf_dir), ["user_id"], ["at_ms", "event_id"], machine, "allowed", "boolean")


# STR-08, WIN-08.
@query("lim_breaker")
def lim_breaker(spark, sf_dir):
    def machine():
        b = sequential.Breaker(0.4, 5, 12 * 3_600_000)
        return lambda r: b.record(r.at_ms, r.ok)

    return sequential.fold(_calls(spark, sf_dir), ["user_id"], ["at_ms", "event_id"], machine, "state", "string")


# STR-21.
@query("lim_lockout")
def lim_lockout(spark, sf_dir):
    def machine():
        b = sequential.Lockout(2, 86_400_000, 43_200_000)
        return lambda r: b.attempt(r.at_ms, r.ok)

    return sequential.fold(_calls(spark, sf_dir), ["user_id"], ["at_ms", "event_id"], machine, "outcome", "string")


# UDF-06, D26.
@query("state_operations")
def state_operations(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "purchase", "cas").when(F.col("event_type") == "error", "delete").otherwise("get")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("op"), F.get_json_object("props", "$.k").cast("long").alias("k"))

    def machine():
        s = sequential.VersionedState()
        return lambda r: "{}:{}".format(*s.apply(r.op, str(r.k), r.k % 4))

    return sequential.fold(e, ["user_id"], ["event_id"], machine, "status", "string")


def _events_path(sf_dir: str) -> str:
    """As a pattern, since a file stream takes no single file but by pattern; it matches that one name, file or folder."""
    return f"{sf_dir.rstrip('/')}/event[s].parquet"


# STR-01, STR-20: the same counts as evt_tumbling, from a stream.
@query("str_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stream = flows.read(spark, _events_path(sf_dir), e)
    rows = flows.run_available(flows.windowed(stream, "ts", "1 day", "31 days", ["event_type"]), "complete")
    return spark.read.parquet(rows).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# STR-02, STR-03, STR-14, STR-18.
@query("str_routed", lake._MATCHED + " SELECT event_id, rule_id, CASE WHEN destination = 'webhook' THEN 'delivered' ELSE 'failed' END AS outcome FROM m")
def str_routed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stream = flows.read(spark, _events_path(sf_dir), e)
    kind = (
        F.when(F.col("event_type") == "signup", "s3:ObjectCreated:Put").when(F.col("event_type") == "purchase", "s3:ObjectCreated:CompleteMultipartUpload")
        .when(F.col("event_type") == "error", "s3:ObjectRemoved:Delete").when(F.col("event_type") == "view", "s3:ObjectAccessed:Get").otherwise("s3:ObjectAccessed:Head")
    )
    key = F.concat(F.when(F.col("user_id") % 2 == 0, F.lit("images/")).otherwise(F.lit("logs/")), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit(".jpg")).otherwise(F.lit(".txt")))
    log = stream.select("event_id", F.concat(F.lit("bucket"), (F.col("user_id") % 4).cast("string")).alias("bucket"), key.alias("key"), kind.alias("event_type"))
    rows = flows.run_available(flows.routed(log, lake.rules(spark)).select("event_id", "rule_id", "outcome"))
    return spark.read.parquet(rows)
