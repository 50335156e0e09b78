"""Registered queries: files and codecs, sinks that are read back, rules of access, plugins' hosts, small scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embedding, images
from ..functions import predicates as P
from ..functions import scalars as S
from ..functions import text as T
from ..operators import catalog, fts, hosting, knn, ops, pipelines, policy, sequential, writes
from ..sources import codecs, lake, sinks
from ..sources.tables import shared_folder, table, written
from .registry import query
from .search import _E, _Q, TOKENS, docs, knn_sql, query_vector, vecs


def _lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")).alias("value"))


# SRC-09: blobs written by a sink, listed and read.
@query(
    "src_blobs",
    "SELECT event_type AS folder, sum(strlen(event_id || ',' || event_type || ',' || user_id) + 1)::BIGINT AS bytes, count(*) AS n_lines FROM events GROUP BY event_type",
)
def src_blobs(spark, sf_dir):
    folder = shared_folder(spark, "blobs")
    _lines(spark, sf_dir).write.partitionBy("event_type").text(folder)
    b = lake.blobs(spark, folder).where(F.col("path").contains("/event_type=")).withColumn("folder", F.regexp_extract("path", "/event_type=([^/]+)/", 1))
    lines = F.length(F.col("content").cast("string")) - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return b.groupBy("folder").agg(F.sum("length").alias("bytes"), F.sum(lines.cast("long")).alias("n_lines"))


# SRC-12: vectors as .fvecs files and back.
@query("src_fvecs", f"SELECT label, count(*) AS n, round(sum(list_sum(e)), 4) + 0.0 AS total FROM (SELECT label, {_E} AS e FROM embeddings) GROUP BY label")
def src_fvecs(spark, sf_dir):
    files = written(codecs.vector_files(vecs(spark, sf_dir), F.concat(F.lit("l"), F.col("label").cast("string")), "vec_id", with_ids=False))
    rows = codecs.decoded_fvecs(files).withColumn("label", F.regexp_extract("path", "^l(-?[0-9]+)-", 1).cast("int"))
    total = F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    return rows.groupBy("label").agg(F.count("*").alias("n"), (F.round(total, 4) + F.lit(0.0)).alias("total"))


# SRC-13: segment files, written and read.
@query("src_segment_files", f"SELECT vec_id, vec_id // 256 AS segment, len(e)::INT AS dim, round(e[1], 6) + 0.0 AS first, round(e[len(e)], 6) + 0.0 AS last FROM (SELECT vec_id, {_E} AS e FROM embeddings)")
def src_segment_files(spark, sf_dir):
    dim = len(query_vector(spark, sf_dir))
    files = written(codecs.vector_files(vecs(spark, sf_dir), F.lit("segment"), "vec_id", with_ids=True, rows_per_file=256))
    rows = codecs.decoded_segments(files, dim).withColumn("e", F.col("embedding").cast("array<double>"))
    part = lambda i, n: (F.round(F.element_at("e", i), 6) + F.lit(0.0)).alias(n)
    return rows.select("vec_id", F.substring_index("path", "-", -1).cast("long").alias("segment"), F.size("e").alias("dim"), part(1, "first"), part(-1, "last"))


# SRC-15: postings through their code.
@query(
    "src_posting_codec",
    f"""WITH p AS (SELECT term, doc_id, i FROM (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM (SELECT doc_id, {TOKENS} AS t FROM documents WHERE lang = 'de')))
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, sum(i)::BIGINT AS places FROM p GROUP BY term""",
)
def src_posting_codec(spark, sf_dir):
    at = docs(spark, sf_dir).where("lang = 'de'").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("i", "term"))
    p = at.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("i")).alias("positions"))
    back = codecs.decoded_postings(codecs.coded_postings(p))
    sums = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"), F.sum(sums).alias("places"))


_CONFIG = """{"pipelines": [{"name": "redact", "trigger": "on_put", "filter": "content_type == 'text/*'", "priority": 5, "steps": [{"plugin": "pii_redact"}, {"plugin": "metadata", "on_error": "continue"}]},
 {"name": "thumbs", "trigger": "on_get", "enabled": false, "steps": [{"name": "small", "plugin": "thumbnail"}]}]}"""


# SRC-16: a configuration's steps, one row each.
@query(
    "src_pipeline_config",
    "SELECT * FROM (VALUES ('redact', 'on_put', true, 5, 0, 'pii_redact', 'pii_redact', 'fail'), ('redact', 'on_put', true, 5, 1, 'metadata', 'metadata', 'continue'), ('thumbs', 'on_get', false, 0, 0, 'small', 'thumbnail', 'fail')) t(pipeline, on_event, enabled, priority, place, step, plugin, on_error)",
)
def src_pipeline_config(spark, sf_dir):
    rows = [(p.name, p.trigger, p.enabled, p.priority, i, s.name, s.plugin, s.on_error) for p in lake.load_pipelines(_CONFIG) for i, s in enumerate(p.steps)]
    return spark.createDataFrame(rows, "pipeline string, on_event string, enabled boolean, priority int, place int, step string, plugin string, on_error string")


# SRC-18: a bulk import of JSON lines.
@query("src_bulk_import", "SELECT event_type, count(*) AS n, max(event_id) AS last, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def src_bulk_import(spark, sf_dir):
    folder = shared_folder(spark, "import")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.json(folder)
    rows = lake.bulk_import(spark, folder, "json", "event_id long, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.round(F.sum("value"), 4).alias("total"))


# SNK-07: the log of changes, written, read and checked.
@query("snk_wal", """SELECT 'put' AS type, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS data, ts AS time, true AS intact FROM events""")
def snk_wal(spark, sf_dir):
    folder = sinks.write_wal(table(spark, sf_dir, "events"), shared_folder(spark, "wal"), "put", F.col("ts"), ["event_id", "user_id"])
    return sinks.read_wal(spark, folder).select("type", "data", "time", "intact")


# The key of 64 bytes, by which SQL can state the code: hash(outer pad, hash(inner pad, body)).
_KEY = "k" * 64
_PADS = ["".join(f"{ord(c) ^ pad:02X}" for c in _KEY) for pad in (0x36, 0x5C)]


# SNK-10, SCL-24.
@query(
    "snk_webhook",
    f"""SELECT body, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(body)))) AS signature FROM (SELECT '{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}' AS body FROM events)""",
)
def snk_webhook(spark, sf_dir):
    return sinks.signed_deliveries(table(spark, sf_dir, "events"), ["event_id", "event_type"], _KEY)


# FLT-14.
@query(
    "flt_capabilities",
    """WITH w AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'storage:read' WHEN 1 THEN 'storage:read:src1' WHEN 2 THEN 'storage:readable' ELSE 'vector:search' END AS wanted, unnest(['storage:read', 'storage:*', 'vector:search:src1', '*']) AS held FROM part)
SELECT p_partkey, held, wanted, held = wanted OR starts_with(wanted, held || ':') OR (ends_with(held, '*') AND starts_with(wanted, held[:-2])) AS allowed FROM w""",
)
def flt_capabilities(spark, sf_dir):
    k = F.col("p_partkey") % 4
    wanted = F.when(k == 0, "storage:read").when(k == 1, "storage:read:src1").when(k == 2, "storage:readable").otherwise("vector:search")
    held = F.explode(F.array(*[F.lit(x) for x in ("storage:read", "storage:*", "vector:search:src1", "*")]))
    w = table(spark, sf_dir, "part").select("p_partkey", wanted.alias("wanted"), held.alias("held"))
    return w.select("p_partkey", "held", "wanted", P.capability_match(F.col("held"), F.col("wanted")).alias("allowed"))


# FLT-15.
@query(
    "flt_egress",
    r"""WITH p AS (SELECT page_id, url, (page_id % 3)::INT AS tier FROM pages), n AS (SELECT *, regexp_replace(regexp_replace(url, '^(https://[^/:]+):443(/|$)', '\1\2'), '^(http://[^/:]+):80(/|$)', '\1\2') AS plain FROM p)
SELECT page_id, CASE tier WHEN 0 THEN false WHEN 2 THEN true ELSE regexp_full_match(plain, 'https://.*\.example\.com/..?/.*', 's') OR starts_with(plain, 'https://m.') END AS allowed FROM n""",
)
def flt_egress(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    patterns = F.array(F.lit("https://*.example.com/?/*"), F.lit("https://*.example.com/??/*"), F.lit("https://m.*"))
    return p.select("page_id", P.url_allowed(F.col("url"), (F.col("page_id") % 3).cast("int"), patterns).alias("allowed"))


# FLT-17.
@query(
    "flt_role_access",
    """WITH r AS (SELECT event_id, CASE WHEN user_id % 13 = 0 THEN 'admin' ELSE 'user' END AS role, 'u' || (user_id % 5) AS usr, 'u' || (event_id % 5) AS owner, 'b' || (event_id % 3) AS bucket, CASE event_id % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'list' ELSE 'put' END AS action, event_id % 7 = 0 AS pub, user_id % 2 = 0 AS writes FROM events)
SELECT event_id, role = 'admin' OR usr = owner OR (writes AND bucket = 'b1' AND action = 'put') OR (pub AND action IN ('get', 'list')) AS allow FROM r""",
)
def flt_role_access(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    r = table(spark, sf_dir, "events").select(
        "event_id", F.when(u % 13 == 0, "admin").otherwise("user").alias("role"), name("u", u % 5).alias("user"), name("u", e % 5).alias("owner"), name("b", e % 3).alias("bucket"),
        F.when(e % 4 == 0, "get").when(e % 4 == 1, "list").otherwise("put").alias("action"), (e % 7 == 0).alias("public"), F.when(u % 2 == 0, F.array(F.lit("b1:put"))).otherwise(F.array().cast("array<string>")).alias("permissions"),
    )
    return writes.role_access(r).select("event_id", "allow")


# PRJ-03.
@query("prj_user_metadata", "SELECT doc_id, lang AS md_lang, source AS md_source, 2::INT AS n FROM documents")
def prj_user_metadata(spark, sf_dir):
    headers = F.create_map(F.lit("X-Amz-Meta-Lang"), "lang", F.lit("Content-Type"), F.lit("text/plain"), F.lit("x-amz-meta-SOURCE"), "source", F.lit("x-amz-date"), F.lit("now"))
    d = docs(spark, sf_dir).select("doc_id", lake.user_metadata(headers).alias("m"))
    return d.select("doc_id", F.col("m.lang").alias("md_lang"), F.col("m.source").alias("md_source"), F.size("m").alias("n"))


# AGG-15: recall of the nearest rows of half the table against those of all.
@query(
    "agg_recall",
    f"""WITH v AS (SELECT vec_id, label, {_E} AS e FROM embeddings), q AS (SELECT label::BIGINT AS query_id, arg_min(e, vec_id) AS qe FROM v GROUP BY label),
d AS (SELECT query_id, vec_id, 1 - list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS raw FROM v, q),
t AS (SELECT query_id, vec_id FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw, vec_id) <= 10),
f AS (SELECT query_id, vec_id FROM d WHERE vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw, vec_id) <= 10)
SELECT count(f.vec_id) / count(*)::DOUBLE AS recall FROM t LEFT JOIN f ON t.query_id = f.query_id AND t.vec_id = f.vec_id""",
)
def agg_recall(spark, sf_dir):
    v = vecs(spark, sf_dir)
    asked = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query")).select(F.col("label").cast("long").alias("query_id"), "query")
    return knn.recall(knn.nearest_many(v.where("vec_id % 2 = 0"), asked), knn.nearest_many(v, asked), "query_id", "vec_id")


# AGG-22: both conventions for an empty cache.
@query(
    "agg_hit_rate",
    "SELECT user_id, round(CASE WHEN h + m = 0 THEN 0.0 ELSE h / (h + m) END, 6)::DOUBLE AS rate, round(CASE WHEN h + m = 0 THEN 1.0 ELSE h / (h + m) END, 6)::DOUBLE AS rate_or_one FROM (SELECT user_id, sum((event_type = 'view')::INT) AS h, sum((event_type = 'click')::INT) AS m FROM events GROUP BY user_id)",
)
def agg_hit_rate(spark, sf_dir):
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(n("view").alias("h"), n("click").alias("m"))
    rate = lambda empty: F.round(ops.hit_rate(F.col("h"), F.col("m"), empty), 6)
    return c.select("user_id", rate(0.0).alias("rate"), rate(1.0).alias("rate_or_one"))


# WIN-09: a text index that keeps the last documents.
@query(
    "win_evicted",
    "SELECT seq < (SELECT min(doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 150)) AS gone, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM (SELECT doc_id AS seq, n_chars FROM documents) GROUP BY 1",
)
def win_evicted(spark, sf_dir):
    kept, gone = catalog.evicted(docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), "n_chars"), "seq", 150)
    both = kept.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))
    return both.groupBy("gone").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


# TOP-07: the tasks that 25 workers claim next.
@query(
    "top_claims",
    "SELECT event_id AS task_id FROM events WHERE epoch_us(ts) // 1000 <= 1704800000000 ORDER BY user_id % 5 DESC, epoch_us(ts) // 1000, event_id LIMIT 25",
)
def top_claims(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    pending = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), (F.col("user_id") % 5).alias("priority"), at.alias("created_ms"), at.alias("next_at_ms"))
    return writes.claims(pending, 1_704_800_000_000, 25).select("task_id")


# FTS-07: documents added and replaced, with the index's statistics after it.
@query(
    "fts_upserted",
    f"SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avg_length, sum(len(t))::BIGINT AS n_terms FROM (SELECT {TOKENS} AS t FROM (SELECT text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT text FROM benchmark))",
)
def fts_upserted(spark, sf_dir):
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return fts.statistics(fts.upsert(docs(spark, sf_dir).select("doc_id", "text"), new, ["doc_id"])).withColumn("avg_length", F.round("avg_length", 6))


# VEC-18: rows of other dimensions, here the longer ones of label 4, take no part.
@query("vec_same_dimension", f"WITH {_Q}, {knn_sql(where='label <> 4')} SELECT vec_id, distance FROM n")
def vec_same_dimension(spark, sf_dir):
    longer = F.when(F.col("label") == 4, F.concat("embedding", F.array(F.lit(1.0).cast("float")))).otherwise(F.col("embedding"))
    return knn.nearest(vecs(spark, sf_dir).withColumn("embedding", longer), query_vector(spark, sf_dir))


def _lengths():
    """A client that gives each text its length and number of spaces."""
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


# EMB-03: a remote provider with a client that needs no network.
@query("emb_remote", "SELECT item_id, length(text)::DOUBLE AS x, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS y FROM benchmark")
def emb_remote(spark, sf_dir):
    e = embedding.provider("remote", client=_lengths, block=16)(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", e.alias("e")).select("item_id", F.col("e")[0].alias("x"), F.col("e")[1].alias("y"))


# SCL-10.
@query(
    "scl_output_path",
    "SELECT page_id, 'out/' || page_id || '-' || substring(md5(url), 1, 8) || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.json' ELSE '' END AS path FROM pages",
)
def scl_output_path(spark, sf_dir):
    k = F.col("page_id") % 3
    mime = F.when(k == 0, "image/png").when(k == 1, "application/json").otherwise("application/x-own")
    return table(spark, sf_dir, "pages").select("page_id", S.output_path(F.lit("out/{key}-{uuid}"), F.col("page_id").cast("string"), F.md5("url"), mime).alias("path"))


# SCL-18.
@query(
    "scl_name_match",
    "SELECT doc_id, arn = 'arn:aws:s3:::src1/en/7' OR starts_with(arn, 'arn:aws:s3:::src2/') OR lower(arn) = 'arn:aws:s3:::src3/de/9' AS matched FROM (SELECT doc_id, 'arn:aws:s3:::' || source || '/' || CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END || '/' || doc_id AS arn FROM documents)",
)
def scl_name_match(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    arn = S.resource_name(F.col("source"), F.concat_ws("/", lang, F.col("doc_id").cast("string")))
    d = docs(spark, sf_dir).select("doc_id", arn.alias("arn"))
    hit = lambda p: policy.name_match(F.lit(p), F.col("arn"))
    first = (F.col("arn") == "arn:aws:s3:::src1/en/7") | hit("arn:aws:s3:::src2/*") | hit("arn:aws:s3:::SRC3/de/9")
    return d.select("doc_id", first.alias("matched"))


# SCL-25.
@query("scl_tag_match", "SELECT event_id, t <> '' AND t = (user_id % 3)::VARCHAR AS matched FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE (event_id % 3)::VARCHAR END AS t FROM events)")
def scl_tag_match(spark, sf_dir):
    t = F.when(F.col("event_id") % 4 == 0, "").otherwise((F.col("event_id") % 3).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.sensitive_equal(t, (F.col("user_id") % 3).cast("string")).alias("matched"))


# SCL-26.
@query("scl_label_key", "SELECT labels, count(*) AS n FROM (SELECT 'kind=' || event_type || ',shard=' || (user_id % 3) AS labels FROM events) GROUP BY labels")
def scl_label_key(spark, sf_dir):
    m = F.create_map(F.lit("shard"), (F.col("user_id") % 3).cast("string"), F.lit("kind"), F.col("event_type"))
    return table(spark, sf_dir, "events").select(S.label_key(m).alias("labels")).groupBy("labels").agg(F.count("*").alias("n"))


# PIP-06: facts of images made of a header for each part: a PNG of its size, a GIF, or no image.
@query(
    "pip_image_facts",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' END AS format, CASE WHEN p_partkey % 3 < 2 THEN p_size END::INT AS width, CASE WHEN p_partkey % 3 < 2 THEN p_size + 256 END::INT AS height, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN false END AS alpha FROM part",
)
def pip_image_facts(spark, sf_dir):
    k, w = F.col("p_partkey"), F.col("p_size").cast("int")
    big = lambda c: F.lpad(F.hex(c), 8, "0")
    little = lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w), big(w + 256), F.lit("08"), F.when(k % 2 == 0, "06").otherwise("02"), F.lit("000000"))
    gif = F.concat(F.lit("474946383961"), little(w), little(w + 256))
    content = F.unhex(F.when(k % 3 == 0, png).when(k % 3 == 1, gif).otherwise(F.lit("00010203")))
    return table(spark, sf_dir, "part").select("p_partkey", images.facts(content).alias("f")).select("p_partkey", "f.*")


# STR-07: decisions depend on those before; the tests compare with a plain loop.
@query("lim_multi_level")
def lim_multi_level(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("user_id") % 4).alias("site"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))

    def machine():
        window = lambda n: lambda: sequential.SlidingWindow(n, 6 * 3_600_000, 60_000)
        m = sequential.MultiLevel([("site", lambda r: "", window(400)), ("user", lambda r: r.user_id, window(3)), ("api", lambda r: r.event_type, window(120))], ["0"])
        return lambda r: m.admit(r, str(r.user_id), r.at_ms)

    return sequential.fold(e, ["site"], ["at_ms", "event_id"], machine, "level", "string").select("event_id", "site", "level")


# UDF-03: a step's plugin is the engine's own or, where it has none, an installed one.
@query("udf_resolved", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang || '!' END AS out FROM documents")
def udf_resolved(spark, sf_dir):
    inside, outside = pipelines.Registry(), pipelines.Registry()
    inside.plugins["upper"] = lambda c: F.upper(c)
    outside.plugins["upper"] = lambda c: F.lit("never")
    outside.plugins["mark"] = lambda c: F.concat(c, F.lit("!"))
    step = lambda name: hosting.resolved(name, inside, outside)(F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, step("upper")).otherwise(step("mark")).alias("out"))


# UDF-05: plugins' calls to their host, by their capabilities.
@query(
    "udf_host_calls",
    """WITH c AS (SELECT event_id AS call_id, 'p' || (user_id % 3) AS plugin, CASE event_type WHEN 'view' THEN 'storage.get' WHEN 'click' THEN 'event.emit' WHEN 'error' THEN 'state.put' ELSE 'net.dial' END AS import, 'src' || (event_id % 3) AS bucket, user_id AS key FROM events),
a AS (SELECT *, import = 'net.dial' AS unknown, CASE plugin WHEN 'p0' THEN import IN ('storage.get', 'event.emit') WHEN 'p1' THEN import = 'storage.get' AND bucket = 'src1' ELSE false END AS held FROM c)
SELECT call_id, CASE WHEN unknown THEN 'unknown' WHEN NOT held THEN 'denied' WHEN import = 'event.emit' THEN 'queued' WHEN d.doc_id IS NULL THEN 'not_found' ELSE 'ok' END AS status,
 CASE WHEN held AND import = 'storage.get' THEN d.n_chars END AS size FROM a LEFT JOIN documents d ON d.source = a.bucket AND d.doc_id = a.key""",
)
def udf_host_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "storage.get").when(F.col("event_type") == "click", "event.emit").when(F.col("event_type") == "error", "state.put").otherwise("net.dial")
    calls = e.select(F.col("event_id").alias("call_id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("plugin"), kind.alias("import"), F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("bucket"), F.col("user_id").alias("key"))
    grants = spark.createDataFrame([("p0", "storage:*"), ("p0", "event:publish"), ("p1", "storage:read:src1"), ("p2", "vector:search")], "plugin string, capability string")
    objects = docs(spark, sf_dir).select(F.col("source").alias("bucket"), F.col("doc_id").alias("key"), F.col("n_chars").alias("size"))
    return hosting.host_calls(calls, grants, objects).select("call_id", "status", "size")


# INT-03: every 50th stored checksum is wrong.
@query("int_verified_reads", "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'corrupt' END AS fault, CASE WHEN doc_id % 50 <> 0 THEN strlen(text) END::INT AS n_bytes FROM documents")
def int_verified_reads(spark, sf_dir):
    stored = F.when(F.col("doc_id") % 50 == 0, F.lit("0")).otherwise(F.sha2("text", 256))
    o = docs(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("content"), stored.alias("checksum"))
    return ops.verified(o).select("doc_id", "fault", F.octet_length("read").alias("n_bytes"))


# TOP-09.
@query(
    "top_prefetch",
    "SELECT event_id AS request_id FROM events ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, ts, event_id LIMIT 40",
)
def top_prefetch(spark, sf_dir):
    level = F.when(F.col("event_type") == "purchase", "critical").when(F.col("event_type") == "signup", "high").when(F.col("event_type") == "view", "normal").otherwise(F.col("event_type"))
    return ops.prefetched(table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), level.alias("level"), F.col("ts").alias("at")), 40).select("request_id")
