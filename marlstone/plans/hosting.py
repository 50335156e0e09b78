"""Registered queries: plugins and hooks, segments, embeddings, admission, names and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embedding
from ..functions import scalars as S
from ..functions import text as T
from ..operators import catalog, hosting, ops, pipelines, policy, segments
from ..operators.sequential import fold
from ..sources import sinks
from ..sources.tables import shared_folder, table, written
from .registry import query
from .rules import _HITS, requests, statements
from .search import TOKENS, _Q, knn_sql, query_vector, vecs


# SRC-01: one object; none is no row.
@query("src_point_lookup", "SELECT source, doc_id, n_chars FROM documents WHERE source = 'src1' AND doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src1')")
def src_point_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    first = d.where("source = 'src1'").agg(F.min("doc_id")).first()[0]
    return catalog.get_object(d, {"source": "src1", "doc_id": first})


# SCL-12: a resource name made of a bucket and a key and taken apart.
@query("scl_resource_names", "SELECT doc_id, 'arn:aws:s3:::' || source || '/' || lang || '/' || doc_id AS arn, source AS bucket, lang || '/' || doc_id AS key FROM documents")
def scl_resource_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    arn = S.resource_name(F.col("source"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")))
    bucket, key = S.resource_parts(F.col("arn"))
    return d.select("doc_id", arn.alias("arn")).select("doc_id", "arn", bucket.alias("bucket"), key.alias("key"))


# SCL-22: metadata as JSON, as a map and as JSON again.
@query("scl_metadata_json", "SELECT event_id, props->>'$.k' AS k, json(props) AS again FROM events")
def scl_metadata_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.try_element_at("m", F.lit("k")).cast("string").alias("k"), F.to_json("m").alias("again"))


# POL-04: the role's statements and the session's own together; no gate, no boundary.
@query(
    "pol_temporary",
    f"""WITH {_HITS} SELECT request_id, CASE WHEN deny IS NOT NULL THEN 'deny' WHEN identity IS NOT NULL OR action = 's3:GetObject' OR resource IS NOT NULL THEN 'allow' ELSE 'implicit_deny' END AS decision,
 CASE WHEN deny IS NOT NULL THEN 'explicit:' || deny WHEN identity IS NOT NULL THEN 'identity:' || identity WHEN action = 's3:GetObject' THEN 'identity:session' WHEN resource IS NOT NULL THEN 'resource:' || resource ELSE 'none' END AS matched_by
 FROM f JOIN (SELECT request_id, action FROM q) USING (request_id)""",
)
def pol_temporary(spark, sf_dir):
    s = statements(spark)
    inline = spark.createDataFrame([(99, "session", "identity", "Allow", None, None, ["s3:GetObject"], None, ["*"], None)], s.schema)
    return policy.evaluate_temporary(requests(spark, sf_dir), s, inline)


# JON-15.
@query(
    "grf_dependency_edges",
    "SELECT DISTINCT 'p' || n_nationkey AS name, 'p' || need AS needs, need IN (SELECT n_nationkey FROM nation) AS installed FROM (SELECT n_nationkey, unnest([n_regionkey, n_nationkey + 1]) AS need FROM nation)",
)
def grf_dependency_edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    return hosting.dependency_edges(n.select(name(F.col("n_nationkey")).alias("name"), F.array(name(F.col("n_regionkey")), name(F.col("n_nationkey") + 1)).alias("depends_on")))


#: What the plugins named by the brands need.
_NEEDS = {f"Brand#{a}{b}": [f"Brand#{a}{b + 2}"] if b <= 3 else [f"Brand#{a + 1}1"] if b == 5 and a < 5 else [] for a in range(1, 6) for b in range(1, 6)}
_ORDER = ", ".join(f"('{n}', {i})" for i, n in enumerate(pipelines.topological_order(_NEEDS)))


# TOP-08, GRF-03: all hooks, in the order in which they run.
@query(
    "top_hook_order",
    f"""WITH o(p_brand, plugin_order) AS (VALUES {_ORDER})
SELECT p_partkey AS seq, p_brand AS plugin, p_size AS priority, row_number() OVER (ORDER BY plugin_order NULLS LAST, p_brand, p_size DESC, p_partkey) AS place FROM part LEFT JOIN o USING (p_brand)""",
)
def top_hook_order(spark, sf_dir):
    hooks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("plugin"), F.col("p_size").alias("priority"))
    return hosting.placed_hooks(hooks, _NEEDS).select("seq", "plugin", "priority", "place")


# TOP-11: backups, the newest first, and increments by where they start.
@query("top_backups", "(SELECT o_orderkey AS backup, o_orderdate AS at, 'newest' AS list FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20) UNION ALL (SELECT o_orderkey, o_orderdate, 'increments' FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 20)")
def top_backups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("backup"), F.col("o_orderdate").alias("at"))
    newest = ops.newest(o, ["at", "backup"], 20).withColumn("list", F.lit("newest"))
    return newest.unionByName(o.where("backup > 1000").orderBy("backup").limit(20).withColumn("list", F.lit("increments")))


# AGG-23: calls by the level that refused them, here by plain limits of running counts.
@query(
    "agg_limiter_levels",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS m FROM events)
SELECT CASE WHEN n > 30 THEN 'user' WHEN m > 5 THEN 'api' ELSE 'allowed' END AS level, count(*) AS calls, count(DISTINCT user_id) AS callers FROM e GROUP BY 1""",
)
def agg_limiter_levels(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    m = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select("user_id", F.when(n > 30, "user").when(m > 5, "api").otherwise("allowed").alias("level"))
    return ops.rejections(e, "level", "user_id")


# AGG-25: label 99 has no members and keeps its old centre.
@query(
    "agg_centroid_means",
    """WITH x AS (SELECT label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, dim, round(avg(x), 6) + 0.0 AS mean FROM x GROUP BY ALL UNION ALL SELECT 99, i::INT, 0.5 FROM range(64) r(i)""",
)
def agg_centroid_means(spark, sf_dir):
    e = vecs(spark, sf_dir)
    zero = e.select("label").distinct().withColumn("embedding", F.array_repeat(F.lit(0.0), 64))
    old = zero.unionByName(spark.range(1).select(F.lit(99).alias("label"), F.array_repeat(F.lit(0.5), 64).alias("embedding")))
    return segments.centroid_means(e, old, "label").withColumn("mean", F.round("mean", 6) + F.lit(0.0))


# EMB-02, EMB-04, UDF-10: held against a plain loop in the tests.
@query("emb_seeded")
def emb_seeded(spark, sf_dir):
    embed = embedding.provider("seeded", dim=16)
    return table(spark, sf_dir, "benchmark").select("item_id", embed(F.col("text")).alias("embedding"))


# FLT-21.
@query("flt_executions", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 7")
def flt_executions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("bucket"), F.col("l_suppkey").cast("string").alias("object_key"))
    return ops.executions(li, "R", "7").select("l_orderkey", "l_linenumber")


# FTS-15: the helper's ranks start at the constant itself.
@query("fts_rrf_scores", "SELECT doc_id, round(1.0 / (60 + r), 6) AS score FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)")
def fts_rrf_scores(spark, sf_dir):
    from ..operators import hybrid

    top = table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return hybrid.rank_from_zero(top, "n_chars", ["doc_id"]).select("doc_id", F.round(hybrid.rrf(F.col("rank")), 6).alias("score"))


# INT-02: the newest repairs.
@query("int_repair_history", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def int_repair_history(spark, sf_dir):
    return ops.newest(table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts"), ["ts", "event_id"], 100).select("event_id", "user_id")


# PIP-08.
@query("pip_write_tasks", "SELECT source AS bucket, doc_id AS key, unnest(list_filter([CASE WHEN doc_id % 3 <> 0 THEN 'vectorize' END, CASE WHEN doc_id % 5 <> 0 THEN 'fts' END, 'pipeline'], lambda x: x IS NOT NULL)) AS kind FROM documents")
def pip_write_tasks(spark, sf_dir):
    i = F.col("doc_id")
    return hosting.write_tasks(table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), i.alias("key"), (i % 3 == 0).alias("skip_vectorize"), (i % 5 == 0).alias("skip_fts")))


# RPL-02.
@query(
    "rpl_rules",
    "SELECT 'r' || n_nationkey AS rule_id, CASE WHEN n_nationkey BETWEEN 5 AND 9 THEN 'new' ELSE n_name END AS target FROM nation WHERE n_nationkey % 4 <> 0 OR n_nationkey > 20",
)
def rpl_rules(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("rule_id"), F.col("n_name").alias("target"))
    added = n.where("n_nationkey BETWEEN 5 AND 9").select("rule_id", F.lit("new").alias("target"))
    return hosting.replication_rules(n.drop("n_nationkey"), added, n.where("n_nationkey % 4 = 0 AND n_nationkey <= 20").select("rule_id"))


_SCHEDULES = ", ".join(f"('{a}', '{b}', {c}, {d}, {e}, {f}, {g})" for a, b, c, d, e, f, g in hosting.SCHEDULES)


# STR-12, STR-13.
@query(
    "sch_retry_delays",
    f"""WITH s(task, schedule, concurrency, retries, first_s, longest_s, growth) AS (VALUES {_SCHEDULES})
SELECT task, retry::INT AS retry, least(longest_s, first_s * growth ** (retry - 1))::DOUBLE AS delay_s FROM (SELECT *, unnest(range(1, retries + 1)) AS retry FROM s)""",
)
def sch_retry_delays(spark, sf_dir):
    return hosting.retry_delays(spark.createDataFrame(list(hosting.SCHEDULES), "task string, schedule string, concurrency int, retries int, first_s int, longest_s int, growth double"))


# STR-10: every user's calls against the usual rate, some with their own for a while.
@query("str_user_limits")
def str_user_limits(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    own = F.when(F.col("user_id") % 3 == 0, F.lit(0.01))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at_ms"), own.alias("own_rate"), F.lit(1_704_700_000_000).alias("expires_ms"))

    def machine():
        limit = hosting.UserLimit(0.0005, 2)
        return lambda r: limit.admit(r.at_ms, r.own_rate, r.expires_ms)

    return fold(e, ["user_id"], ["at_ms", "event_id"], machine, "allowed", "boolean").select("user_id", "event_id", "allowed")


# STR-16.
@query("str_admission")
def str_admission(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("pool"), "event_id", at.alias("at_ms"), (F.col("value") * 100_000).cast("long").alias("takes_ms"))

    def machine():
        pool = hosting.Admission(workers=2, queue=3, rate=0.001, burst=5)
        return lambda r: pool.arrive(r.at_ms, r.takes_ms)[0]

    return fold(e, ["pool"], ["at_ms", "event_id"], machine, "result", "string").select("pool", "event_id", "result")


# UDF-09, FLT-13.
@query(
    "udf_manifest_errors",
    """SELECT p_partkey, CASE WHEN NOT regexp_matches(lower(replace(p_brand, '#', '-')), '^[a-z][a-z0-9-]{1,62}[a-z0-9]$') THEN 'name' WHEN p_size > 40 THEN 'version' WHEN p_size % 4 > 2 THEN 'tier' WHEN p_size % 5 = 0 THEN 'capabilities' END AS error FROM part""",
)
def udf_manifest_errors(spark, sf_dir):
    z = F.col("p_size")
    name = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    version = F.when(z > 40, F.lit("one.two")).otherwise(F.concat(F.lit("1."), z.cast("string"), F.lit(".0-rc.1")))
    caps = F.when(z % 5 == 0, F.array(F.lit("state:kv"), F.lit("disk:write"))).otherwise(F.array(F.lit("state:kv"), F.lit("vector:search:src1")))
    return table(spark, sf_dir, "part").select("p_partkey", hosting.manifest_error(name, version, z % 4, caps).alias("error"))


# UDF-04, UDF-07.
@query(
    "udf_hook_decisions",
    """SELECT event_id, CASE WHEN event_type = 'click' AND value > 50 THEN 'limit' WHEN user_id % 7 = 0 THEN 'quota' END AS decided_by, CASE WHEN (event_type = 'click' AND value > 50) OR user_id % 7 = 0 THEN 'deny' ELSE 'allow' END AS decision FROM events""",
)
def udf_hook_decisions(spark, sf_dir):
    hooks = [
        hosting.Hook("limit", lambda: F.col("value") <= 50, lambda: F.col("event_type") == "click"),
        hosting.Hook("scan", lambda: F.when(F.col("user_id") % 2 == 0, F.lit(True)), on_failure="log_and_allow"),
        hosting.Hook("quota", lambda: F.when(F.col("user_id") % 7 != 0, F.lit(True))),
    ]
    return hosting.admitted(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), hooks).select("event_id", "decided_by", "decision")


# UDF-08.
@query("udf_bucket_search", f"WITH {_Q}, {knn_sql(where='label = 3')} SELECT vec_id, distance FROM n")
def udf_bucket_search(spark, sf_dir):
    return segments.in_bucket(vecs(spark, sf_dir).withColumn("bucket", F.col("label").cast("string")), "3", query_vector(spark, sf_dir))


# VEC-17, VEC-24: ids are dealt by task, so only what they must satisfy is compared.
@query(
    "vec_insert_segment",
    "SELECT count(*) AS n_rows, count(*) AS n_ids, 1 AS last_segment, count(*) FILTER (label = 0) AS n_new, true AS above FROM embeddings",
)
def vec_insert_segment(spark, sf_dir):
    e = vecs(spark, sf_dir).select("vec_id", "label", "embedding")
    rows = segments.insert(e.where("label <> 0").withColumn("segment_id", F.lit(0)), e.where("label = 0").drop("vec_id"))
    above = F.min(F.when(F.col("segment_id") == 1, F.col("vec_id"))) > F.max(F.when(F.col("segment_id") == 0, F.col("vec_id")))
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_ids"), F.max("segment_id").alias("last_segment"), F.count_if(F.col("segment_id") == 1).alias("n_new"), above.alias("above"))


# VEC-19, VEC-23, D22.
@query("vec_deleted_search", f"WITH {_Q}, {knn_sql(where='label <> 2')} SELECT vec_id, distance FROM n")
def vec_deleted_search(spark, sf_dir):
    e = vecs(spark, sf_dir)
    return segments.search(segments.deleted(e, e.where("label = 2"), ["vec_id"]), query_vector(spark, sf_dir), kind="FLAT")


# SET-01, SET-03, FTS-10, FTS-11, VEC-26.
@query(
    "set_merged_segments",
    """WITH d AS (SELECT *, doc_id // 16 AS s FROM documents), z AS (SELECT s, count(*) AS n FROM d GROUP BY s), c AS (SELECT s FROM z ORDER BY n, s LIMIT 3)
SELECT CASE WHEN s IN (SELECT s FROM c) THEN (SELECT max(s) + 1 FROM z) ELSE s END AS segment_id, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM d GROUP BY 1""",
)
def set_merged_segments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 16).alias("segment_id"))
    return segments.merged(d, 1024, 10).groupBy("segment_id").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


# VEC-28, OPT-04: 4 hot rows are found, so cold ones fill the rest.
@query(
    "vec_hot_first",
    f"""WITH {_Q}, {knn_sql(where="vec_id < 4", name="h")}, {knn_sql(where="vec_id >= 4", k=6, name="c")}
SELECT vec_id, distance FROM h UNION ALL SELECT vec_id, distance FROM c""",
)
def vec_hot_first(spark, sf_dir):
    return segments.planned_search(vecs(spark, sf_dir).withColumn("hot", F.col("vec_id") < 4), query_vector(spark, sf_dir))[0]


# SNK-08: the access log, written in files of a bounded size and read again.
@query("snk_access_log", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || user_id || ' ' || event_type || ' ' || event_id AS value FROM events")
def snk_access_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string")).alias("value"))
    return spark.read.text(sinks.write_lines(lines, shared_folder(spark, "log"), most_bytes=1 << 20))


# SNK-13: shards written, read again and joined; the storage below Spark keeps the copies.
@query("snk_shards", "SELECT page_id, ceil((8 + strlen(html)) / 4)::BIGINT AS shard_size, (4 * ceil((8 + strlen(html)) / 4) - 8 - strlen(html))::BIGINT AS padding, sha256(html) AS sha FROM pages")
def snk_shards(spark, sf_dir):
    size, padding = S.shard_sizes(F.octet_length("html").cast("long"))
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"), size.alias("shard_size"), padding.alias("padding"))
    back = sinks.joined_shards(written(sinks.shards(p.select("page_id", "content"), "page_id")), "page_id")
    return p.drop("content").join(back, "page_id").select("page_id", "shard_size", "padding", F.sha2("content", 256).alias("sha"))


# FTS-11, SET-01: what each segment of the text index holds.
@query("fts_segment_lengths", f"SELECT doc_id // 1024 AS segment_id, count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms, count(*) >= 1024 AS full_segment FROM (SELECT doc_id, {TOKENS} AS t FROM documents) GROUP BY 1")
def fts_segment_lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1024).alias("segment_id"), T.token_count(F.col("text")).alias("n"))
    return d.groupBy("segment_id").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms"), (F.count("*") >= 1024).alias("full_segment"))


# VEC-13: what a graph search expands; held against the number of rows in the tests.
@query("vec_graph_stats")
def vec_graph_stats(spark, sf_dir):
    from ..operators import ann

    return ann.graph_stats(written(ann.graph_index(vecs(spark, sf_dir))), query_vector(spark, sf_dir))
