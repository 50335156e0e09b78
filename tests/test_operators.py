import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import stem
from marlstone.functions import text as T
from marlstone.operators import ann, catalog, events, fts, hybrid, knn, ops, pipelines, policy, sequential, tiering
from marlstone.plans import rules
from marlstone.streaming import flows

SF = "/root/testdata/sf0.001"


def test_ranking_delete_and_upsert(spark):
    docs = spark.createDataFrame([("relevant", "golang golang golang programming language"), ("less", "golang is a programming language"), ("other", "python")], "doc_id string, text string")
    assert [r.doc_id for r in fts.search(docs, "golang").collect()] == ["relevant", "less"]
    assert fts.search(docs, "the of").count() == 0 and fts.search(docs, "").count() == 0
    gone = fts.delete(docs, spark.createDataFrame([("relevant",)], "doc_id string"), ["doc_id"])
    assert [r.doc_id for r in fts.search(gone, "golang").collect()] == ["less"]
    new = fts.upsert(docs, spark.createDataFrame([("other", "golang")], "doc_id string, text string"), ["doc_id"])
    assert new.count() == 3 and fts.search(new, "golang").count() == 3
    p = {(r.term, r.doc_id): (r.tf, r.positions, r.dl) for r in fts.postings(docs, ["doc_id"]).collect()}
    assert p["golang", "relevant"] == (3, [0, 1, 2], 5)
    assert (fts.clamp_k(None), fts.clamp_k(0), fts.clamp_k(500)) == (20, 1, 100)


def test_stemmed_search_equals_a_loop(spark):
    import math

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    query = "licenses applying versions generally"
    stems = list(dict.fromkeys(stem.stem(t) for t in T.query_tokens(query)))
    import regex

    split = {d: [stem.stem(w) for w in regex.findall(r"[\p{L}\p{Nd}]+", t.lower()) if len(w.encode()) > 1 and w not in T.STOP_WORDS] for d, t in docs}
    n, avg = len(split), sum(map(len, split.values())) / len(split)
    score = {}
    for s in stems:
        df = sum(s in w for w in split.values())
        for d, w in split.items():
            if tf := w.count(s):
                score[d] = score.get(d, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    want = sorted(((-round(x, 6), d) for d, x in score.items()))[:20]
    got = fts.search(spark.read.parquet(f"{SF}/documents.parquet"), query).collect()
    assert [(r.doc_id, r.score) for r in got] == [(d, pytest.approx(-x, abs=2e-6)) for x, d in want]


def test_all_forms_of_a_word_match(spark):
    docs = spark.createDataFrame([(1, "Running runs"), (2, "he ran, then run."), (3, "runner"), (4, None), (5, "")], "doc_id long, text string")
    assert [r.doc_id for r in fts.search(docs, "running").collect()] == [1, 2]
    assert {r.term: r.df for r in fts.document_frequencies(docs).collect()}["run"] == 2
    asked = spark.createDataFrame([(7, "the runs"), (8, "nothing here"), (9, None), (10, "runner ran")], "query_id long, query string")
    many = {(r.query_id, r["rank"]): r.doc_id for r in fts.search_many(docs, asked).collect()}
    assert many == {(7, 1): 1, (7, 2): 2, (10, 1): 3, (10, 2): 2}
    long = spark.createDataFrame([(1, "x" * 80 + " Licensed under it " + "y" * 80)], "doc_id long, text string")
    assert "Licens" in fts.snippets(long, "licenses", size=40).first().snippet
    assert fts.search_many(docs, asked.where("query_id = 0")).count() == 0


def test_batch_search_equals_single_searches(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").limit(5)
    monkeypatch.setattr(fts, "QUERY_BLOCK", 2)
    many = {}
    for r in fts.search_many(docs, asked, 10, query_id="item_id", query_text="text").collect():
        many.setdefault(r.item_id, {})[r["rank"]] = (r.doc_id, r.score)
    for q in asked.collect():
        one = [(r.doc_id, r.score) for r in fts.search(docs, q.text, 10).collect()]
        assert [d for d, _ in one] == [many[q.item_id][i][0] for i in range(1, len(one) + 1)]
        assert all(abs(s - many[q.item_id][i][1]) < 2e-6 for i, (_, s) in enumerate(one, 1))


def test_nearest_with_nulls_ties_and_dimensions(spark):
    rows = [(1, [None, 1.0]), (2, [0.6, 0.8]), (3, None), (4, [0.6, 0.8, 0.0]), (0, [0.6, 0.8 + 1e-7]), (5, [0.0, 0.0]), (6, [0.6, 0.8]), (7, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for metric in ("cosine", "l2"):
        # An equal vector comes before one that is nearer than a rounding, whatever the ids.
        assert [r.vec_id for r in knn.nearest(v, [0.6, 0.8], 3, metric).collect()] == [2, 6, 0]
        assert {r.vec_id for r in knn.nearest(v, [0.6, 0.8], 10, metric).collect()} == {0, 2, 5, 6, 7}
        asked = spark.createDataFrame([(9, [0.6, 0.8]), (10, [0.6, 0.8, 0.0]), (11, None), (12, [None, 1.0]), (13, [1.0] * 4)], "query_id long, query array<double>")
        got = {(r.query_id, r["rank"]): r.vec_id for r in knn.nearest_many(v, asked, 3, metric).collect()}
        assert got == {(9, 1): 2, (9, 2): 6, (9, 3): 0, (10, 1): 4}
    with pytest.raises(ValueError):
        knn.nearest(v, [None, 1.0])


def test_equal_vectors_keep_the_order_of_their_ids(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24)).tolist()
    v = spark.createDataFrame([(i, base[i % 40]) for i in range(600)], "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, rng.normal(size=24).tolist()) for i in range(6)], "query_id long, query array<double>")
    for metric in ("cosine", "l2", "dot"):
        got = {}
        for r in knn.nearest_many(v, asked, 20, metric).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
        for q in asked.collect():
            one = [r.vec_id for r in knn.nearest(v, q["query"], 20, metric).collect()]
            assert [got[q.query_id][i] for i in range(1, 21)] == one
            assert all(b - a == 40 for a, b in zip(one[:14], one[1:15], strict=True))


def test_a_written_graph_is_searched(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    ann.graph_index(v, 64).write.parquet(f"file://{tmp_path}/graph")
    index = spark.read.parquet(f"file://{tmp_path}/graph")
    for q in v.orderBy("vec_id").limit(5).collect():
        true = {r.vec_id for r in knn.nearest(v, q.embedding, 10, "l2").collect()}
        assert len(true & {r.vec_id for r in ann.graph_search(index, q.embedding).collect()}) >= 8
    assert sum(r.n_rows for r in ann.graph_stats(index, q.embedding).collect()) == v.count()
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.graph_search(ann.graph_index(odd), [1.0, 2.0]).collect()] == [3]


def test_percentiles_of_skewed_values(spark):
    rng = random.Random(3)
    values = [(g, x) for g, xs in (("a", [rng.gauss(0, 1) for _ in range(500)] + [1e12]), ("b", [5.0] * 300 + [7.0]), ("c", [2.0]), ("d", [1.0, None])) for x in xs]
    df = spark.createDataFrame(values, "g string, x double")
    for r in ops.percentile_lower(df, ["g"], "x", [0, 50, 99, 100], cells=7).collect():
        xs = sorted(x for g, x in values if g == r.g and x is not None)
        assert (r.n, r.p0, r.p50, r.p99, r.p100) == (len(xs), *(xs[(len(xs) - 1) * p // 100] for p in (0, 50, 99, 100)))


def test_hybrid(spark):
    text = spark.createDataFrame([("doc1", 0)], "doc_id string, text_rank int")
    vec = spark.createDataFrame([("doc1", 0), ("doc2", 1)], "doc_id string, vector_rank int")
    got = [(r.doc_id, r.score) for r in hybrid.fuse(text, vec, ["doc_id"]).collect()]
    assert got == [("doc1", round(1 / 61, 6)), ("doc2", round(0.5 / 62, 6))]
    assert hybrid.fuse(text, vec.limit(0), ["doc_id"], weights=(0, 0), constant=0).first().score == round(0.5 / 61, 6)


def test_batch_knn_equals_single(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    for metric in ("cosine", "l2", "dot"):
        many = {}
        for r in knn.nearest_many(v, q, 5, metric).collect():
            many.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        for row in q.collect():
            one = [r.vec_id for r in knn.nearest(v, row["query"], 5, metric).collect()]
            assert [i for _, i in sorted(many[row.query_id])] == one
    truth = knn.nearest_many(v, q, 5)
    assert knn.recall(truth.where("rank <= 4"), truth, "query_id", "vec_id").first().recall == pytest.approx(0.8)


def test_product_quantizer_and_graph_recall(spark):
    rng = np.random.default_rng(42)
    centres = rng.normal(size=(20, 32))
    x = centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 32))
    pq = ann.ProductQuantizer(x, 8, 6)
    codes = pq.encode(x)
    assert np.abs(pq.decode(codes) - x).mean() < np.abs(x).mean()
    graph = ann.Graph(x, 24, 48)
    hit_pq = hit_graph = 0
    for q in x[:25] + 0.05:
        true = set(np.argsort(((x - q) ** 2).sum(axis=1))[:10].tolist())
        near = np.argsort(pq.distances(pq.table(q), codes))[:64]
        best = near[np.argsort(((x[near] - q) ** 2).sum(axis=1))[:10]]
        hit_pq += len(true & set(best.tolist()))
        hit_graph += len(true & set(graph.search(q, 10)[0].tolist()))
    assert hit_pq / 250 >= 0.85 and hit_graph / 250 >= 0.85
    assert max(map(len, graph.links)) <= 24


def test_registered_approximate_searches(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.orderBy("vec_id").first().embedding
    true = {r.vec_id for r in knn.nearest(v, q, 10, "l2").collect()}
    for name in (rules.vec_pq_search, rules.vec_graph_search):
        assert len(true & {r.vec_id for r in name(spark, SF).collect()}) >= 8


def test_hash_embedding(spark):
    def slow(t, dim):
        h, at = 0, 0
        for c in t:
            h = (31 * h + ord(c) + at) & 0xFFFFFFFF
            at += len(c.encode())
        out = []
        for _ in range(dim):
            out.append((h % 1000) / 1000)
            h = (h * 1103515245 + 12345) & 0xFFFFFFFF
        return out

    rows = [("",), ("abc",), ("é世🙂",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(ann.hash_embedding(F.col("t"), 8)).collect()]
    assert got == [slow(t, 8) for (t,) in rows]


def test_listing(spark):
    o = spark.createDataFrame([("b", "prefix/a.txt", 1), ("b", "prefix/b.txt", 2), ("b", "other/c.txt", 3), ("b", "top", 4), ("x", "prefix/z", 5)], "bucket string, key string, size long")
    assert [r.key for r in catalog.list_objects(o, "b", "prefix/").collect()] == ["prefix/a.txt", "prefix/b.txt"]
    assert [(r.entry, r.is_prefix, r.n) for r in catalog.list_delimited(o.where("bucket = 'b'")).orderBy("entry").collect()] == [("other/", True, 1), ("prefix/", True, 2), ("top", False, 1)]
    page = catalog.list_page(o, "b", max_keys=2).collect()
    assert [r.key for r in page] == ["other/c.txt", "prefix/a.txt"] and page[0].is_truncated and page[0].next_marker == "prefix/a.txt"
    last = catalog.list_page(o, "b", start_after="prefix/a.txt", max_keys=5).collect()
    assert [r.key for r in last] == ["prefix/b.txt", "top"] and not last[0].is_truncated and last[0].next_marker is None


def test_conditional_get_and_appends(spark):
    schema = "etag string, modified_at int, delete_marker boolean, if_match string, if_none_match string, if_modified_since int"
    rows = [("e", 5, True, None, None, None), ("e", 5, False, "x", None, None), ("e", 5, False, "e", "e", None), ("e", 5, False, None, None, 5), ("e", 5, False, None, "z", 9), ("e", 5, False, None, None, None)]
    assert [r.status for r in catalog.conditional_get(spark.createDataFrame(rows, schema)).collect()] == [404, 412, 304, 304, 200, 200]
    chunks = spark.createDataFrame([("u", 1, 0, 10), ("u", 2, 10, 5), ("u", 3, 14, 5)], "upload_id string, seq int, offset long, size long")
    assert [r.conflict for r in catalog.append_offsets(chunks).orderBy("seq").collect()] == [False, False, True]


def test_trailing_counts_cross_spans(spark):
    rng = random.Random(1)
    rows = [(i, "k" if rng.random() < 0.8 else "j", rng.randrange(100_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.in_window for r in tiering.trailing_counts(df, ["k"], "ts", 3000).collect()}
    assert got == {i: sum(k2 == k and 0 <= s - s2 < 3000 for _, k2, s2 in rows) for i, k, s in rows}


def test_percentiles_take_the_lower_rank(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randrange(30))) for _ in range(333)]
    got = {r.g: (r.n, r.p0, r.p50, r.p99, r.p100) for r in ops.percentile_lower(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0, 50, 99, 100]).collect()}
    for g in "ab":
        x = sorted(v for k, v in rows if k == g)
        assert got[g] == (len(x), *[x[(len(x) - 1) * p // 100] for p in (0, 50, 99, 100)])


CONTEXT = {"env": "production", "path": "images/photos/vacation.jpg", "ip": "192.168.1.7", "n": "3.14", "day": "2024-05-01T00:00:00Z", "arn": "arn:aws:s3:::B/k"}
CASES = [
    ("StringEquals", "env", ["production"], True), ("StringEquals", "env", ["staging"], False), ("StringEquals", "absent", ["production"], False),
    ("StringEquals", "env", ["staging", "production"], True), ("StringEquals", "env", ["staging", "development"], False),
    ("StringNotEquals", "env", ["staging"], True), ("StringNotEquals", "env", ["production"], False), ("StringNotEquals", "absent", ["production"], True),
    ("StringNotEquals", "env", ["production", "staging"], True),
    ("StringLike", "path", ["images/*"], True), ("StringLike", "path", ["documents/*"], False), ("StringLike", "path", ["*/vacation.jpg"], True), ("StringLike", "path", ["images/*/vacation.jpg"], True), ("StringNotLike", "path", ["images/*"], False),
    ("NumericEquals", "n", ["3.140"], True), ("NumericNotEquals", "n", ["3"], True), ("NumericLessThan", "n", ["4"], True), ("NumericGreaterThan", "n", ["10"], False), ("NumericLessThan", "env", ["zzz"], True),
    ("DateLessThan", "day", ["2024-06-01T00:00:00Z"], True), ("DateGreaterThan", "day", ["2024-06-01T00:00:00Z"], False),
    ("IpAddress", "ip", ["192.168.1.0/24"], True), ("NotIpAddress", "ip", ["192.168.1.0/24"], False), ("IpAddress", "ip", ["*"], True),
    ("Bool", "env", ["PRODUCTION"], True), ("ArnEquals", "arn", ["arn:aws:s3:::b/K"], True), ("ArnLike", "arn", ["arn:aws:s3:::*"], True),
    ("Null", "absent", ["true"], True), ("Null", "env", ["true"], False), ("Null", "env", ["false"], True), ("Unheard", "env", ["production"], True),
]


def test_policy_conditions(spark):
    df = spark.createDataFrame([(*c[:3], CONTEXT) for c in CASES], "operator string, key string, expected array<string>, context map<string,string>")
    got = [r[0] for r in df.select(policy.condition_matches(F.col("operator"), F.col("key"), F.col("expected"), F.col("context"))).collect()]
    assert got == [c[3] for c in CASES]
    sub = spark.createDataFrame([("a-${aws:PrincipalTag/Team}-${no}-z", {"aws:PrincipalTag/Team": "x"})], "v string, c map<string,string>")
    assert sub.select(policy.substituted(F.col("v"), F.col("c"), ["aws:PrincipalTag/Team"])).first()[0] == "a-x--z"


def test_reasons_round_as_printf(spark):
    scores = [27.685, 30.825, 30.125, 0.125, 0.375, 1.005, 2.675, 0.0, 0.004999, 0.995, 99.995, 100.0, 1234.565, 64.5, *[i / 1000 + 0.005 for i in range(0, 100_000, 10)]]
    rows = spark.createDataFrame([(x, "HOT", "COLD", False) for x in scores], "score double, tier string, target_tier string, pinned boolean")
    got = {r.score: r.reason for r in tiering.decisions(rows).collect()}
    assert got == {x: f"score {x:.2f}: HOT to COLD" for x in scores}


FRESH = """
from pyspark.sql import SparkSession
from marlstone.plans import rules
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{folder}").getOrCreate()
print("rows", {rows})
"""


def test_policies_in_a_new_session(spark, tmp_path):
    """Which filters Spark infers from conditions with lambdas depends on the numbers that its columns happen to have: the first query of a session is a case of its own."""
    for query in ("pol_boundary", "pol_decision"):
        rows = f"len(rules.{query}(spark, '{SF}').collect())"
        out = subprocess.run([sys.executable, "-c", FRESH.format(folder=tmp_path, rows=rows)], capture_output=True, text=True, cwd=tmp_path, timeout=300, check=False)
        assert f"rows {spark.read.parquet(f'{SF}/events.parquet').count()}" in out.stdout, out.stderr[-2000:]


def test_policy_flags(spark):
    """Repeated requests are one, ties of ordinals go to the greater sid, unknown principals and empty statements deny implicitly."""
    kinds = "ordinal int, sid string, policy_type string, effect string, owner string, principals array<string>, actions array<string>, not_actions array<string>, resources array<string>, not_resources array<string>"
    rows = [(2, "b", "identity", "Allow", "u", None, ["s3:*"], None, ["*"], None), (1, "a", "identity", "Allow", "u", None, ["s3:Get*"], None, ["*"], None), (1, "c", "identity", "Allow", "u", None, ["s3:Get*"], None, ["*"], None),
            (3, "d", "resource", "Deny", None, ["u"], ["s3:Put"], None, None, ["k/*"]), (4, "e", "boundary", "Allow", "u", None, None, ["s3:Del"], ["*"], None)]
    asked = [(1, "u", "s3:Get", "k/1"), (1, "u", "s3:Get", "k/1"), (2, "u", "s3:Put", "x"), (3, "u", "s3:Put", "k/2"), (4, "u", "s3:Del", "k/3"), (5, None, "s3:Get", "k"), (6, "v", "s3:Get", "k"), (7, "u", None, "k")]
    requests = spark.createDataFrame(asked, "request_id long, principal string, action string, resource string").repartition(3)
    got = {r.request_id: (r.decision, r.matched_by) for r in policy.evaluate(requests, spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: ("allow", "identity:c"), 2: ("deny", "explicit:d"), 3: ("allow", "identity:b"), 4: ("deny", "boundary"), 5: ("implicit_deny", "none"), 6: ("implicit_deny", "none"), 7: ("implicit_deny", "none")}
    assert {(r.decision, r.matched_by) for r in policy.evaluate(requests, spark.createDataFrame([], kinds)).collect()} == {("implicit_deny", "none")}


def test_pipelines_and_order(spark):
    P, S = pipelines.Pipeline, pipelines.Step
    r = pipelines.default_registry()
    with pytest.raises(ValueError):
        r.compile(P("x", "on_put", ()))
    with pytest.raises(ValueError):
        r.compile(P("x", "on_put", (S("a", "nothing"),)))
    o = spark.createDataFrame([("1380013800 13800138000", "image/png", 5, {"a": "1"}), ("t", "text/plain", 5, {})], "text string, content_type string, size long, metadata map<string,string>")
    p = P("x", "on_put", (S("one", "compress_image", "fail"), S("two", "encrypt_pii")))
    got = pipelines.execute(o, p, r).orderBy("content_type").collect()
    assert [s.status for s in got[0].steps] == ["ok", "ok"] and got[0].text.endswith("13*******00") and got[0].metadata == {"a": "1", "compressed": "true", "pii_redacted": "true"}
    assert [s.status for s in got[1].steps] == ["error", "not run"] and got[1].metadata == {}
    names = [P(n, t, (S("m", "extract_metadata"),), f, e) for n, t, f, e in (("image", "on_put", "content_type == 'image/*'", True), ("video", "on_put", "content_type == 'video/*'", True), ("all", "on_put", "", True), ("off", "on_put", "", False))]
    kinds = spark.createDataFrame([(k, 1, {}) for k in ("image/jpeg", "video/mp4", "text/plain", "application/pdf")], "content_type string, size long, metadata map<string,string>")
    assert [len(x.pipelines) for x in pipelines.matching(kinds, names, "on_put").collect()] == [2, 2, 1, 1]
    assert pipelines.matching(kinds, names, "on_get").first().pipelines == []
    assert pipelines.topological_order({"c": ["a"], "b": [], "a": ["b"], "d": []}) == ["b", "a", "c", "d"]
    with pytest.raises(ValueError):
        pipelines.topological_order({"a": ["b"], "b": ["a"]})


def test_machines():
    w = sequential.SlidingWindow(5, 1000, 100)
    assert [w.allow(10) for _ in range(6)] == [True] * 5 + [False]
    assert not w.allow(900) and w.allow(1100)
    b = sequential.TokenBucket(10, 2)
    assert [b.allow(0), b.allow(0), b.allow(0), b.allow(100), b.allow(100)] == [True, True, False, True, False]
    c = sequential.Breaker(0.5, 2, 1000)
    assert [c.record(0, True), c.record(1, False), c.record(2, True), c.record(1001, False), c.record(1002, True), c.record(2500, True), c.record(2501, True)] == ["closed", "closed", "open", "half_open", "open", "half_open", "closed"]
    k = sequential.Lockout(2, 1000, 500)
    assert [k.attempt(0, False), k.attempt(10, False), k.attempt(20, True), k.attempt(600, True)] == ["failed", "failed", "blocked", "ok"]
    m = sequential.MultiLevel([("global", lambda r: "", lambda: sequential.SlidingWindow(3, 1000, 100)), ("user", lambda r: r, lambda: sequential.SlidingWindow(1, 1000, 100))], ["root"])
    assert [m.admit("a", "a", 0), m.admit("a", "a", 0), m.admit("b", "b", 0), m.admit("c", "c", 0), m.admit("a", "root", 0)] == ["allowed", "user", "allowed", "global", "allowed"]
    s = sequential.VersionedState()
    assert [s.apply("get"), s.apply("cas", "x", 0), s.apply("cas", "y", 0), s.apply("put", "z"), s.apply("delete"), s.apply("delete"), s.apply("cas", "w", 0)] == [("not_found", 0), ("ok", 1), ("conflict", 1), ("ok", 2), ("ok", 3), ("not_found", 0), ("ok", 4)]


def test_fold_takes_nulls_as_one_key_and_whole_numbers_whole(spark):
    rows = [(None, i, 9007199254740993 + i, None if i % 2 else i) for i in range(6)] + [(float("nan"), i, i, i) for i in range(4)] + [(1.0, 0, 1, None)]
    df = spark.createDataFrame(rows, "k double, at_ms long, id long, x long").repartition(3)

    def machine():
        seen = []
        return lambda r: seen.append(r.x) or f"{len(seen)}:{r.x}"

    got = sequential.fold(df, ["k"], ["at_ms"], machine, "out", "string").collect()
    assert sorted((r.id, r.out) for r in got if r.k is None) == [(9007199254740993 + i, f"{i + 1}:{None if i % 2 else i}") for i in range(6)]
    assert sorted(r.out for r in got if r.k is not None and r.k != r.k) == ["1:0", "2:1", "3:2", "4:3"]


def test_multi_level_limits_equal_a_loop(spark):
    from marlstone.plans import wider

    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "user_id", "event_type", "user_id % 4 AS site", "unix_millis(CAST(ts AS TIMESTAMP)) AS at_ms").collect()
    want = {}
    for site in range(4):
        last: dict = {}

        def allow(key, limit, at):
            now = at // 60_000
            calls = [b for b in last.get(key, []) if b > now - 360]
            ok = len(calls) < limit
            last[key] = [*calls, now] if ok else calls
            return ok

        for r in sorted((r for r in rows if r.site == site), key=lambda r: (r.at_ms, r.event_id)):
            levels = [("site", "", 400), ("user", r.user_id, 3), ("api", r.event_type, 120)]
            want[r.event_id] = "allowed" if r.user_id == 0 else next((n for n, k, limit in levels if not allow((n, k), limit, r.at_ms)), "allowed")
    assert {r.event_id: r.level for r in wider.lim_multi_level(spark, SF).collect()} == want


def test_fold_keeps_order_and_state_over_batches(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(6), i, rng.randrange(10**6)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, id int, at_ms long").repartition(5)

    def machine():
        w = sequential.SlidingWindow(4, 60_000, 1000)
        return lambda r: w.allow(r.at_ms)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.id: r.allowed for r in sequential.fold(df, ["k"], ["at_ms", "id"], machine, "allowed", "boolean").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in range(6):
        step = machine()
        for r in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1])):
            want[r[1]] = step(type("R", (), {"at_ms": r[2]}))
    assert got == want


def test_streams_equal_tables(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.warehouse.dir", str(tmp_path)) if False else None
    stream = lambda: flows.read(spark, f"{tmp_path}/in", e, 1)
    got = spark.read.parquet(flows.run_available(flows.deduplicated(stream(), "ts", "40 days", ["event_id"]).select("event_id")))
    assert got.count() == e.count()
    limited = spark.read.parquet(flows.run_available(flows.limited(stream(), "user_id", "ts", 2, 6 * 3_600_000, 60_000)))
    assert limited.count() == e.count() and 0 < limited.where("allowed").count() <= e.count()
    windows = spark.read.parquet(flows.run_available(flows.windowed(stream(), "ts", "6 hours", "31 days", ["event_type"], "3 hours"), "complete"))
    assert windows.count() == events.sliding(e, "ts", "6 hours", "3 hours", ["event_type"]).count()
    from marlstone.plans import lake

    log = flows.read(spark, f"{tmp_path}/in", e, 1).withColumn("bucket", F.lit("bucket1")).withColumn("key", F.lit("logs/x")).withColumn("event_type", F.lit("s3:ObjectRemoved:Delete"))
    flows.route_to_tables(log, lake.rules(spark), f"{tmp_path}/ok", f"{tmp_path}/dead", 3, 1000, 16_000)
    dead = spark.read.parquet(f"{tmp_path}/dead")
    assert dead.count() == 3 * e.count() and spark.read.parquet(f"{tmp_path}/ok").count() == 0
