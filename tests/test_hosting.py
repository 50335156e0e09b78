"""Plugins, segments, embeddings, limits: what SQL does not cover."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import embedding, images
from marlstone.functions import scalars as S
from marlstone.operators import ann, hosting, ops, segments


def looped(text, dim, legacy):
    v = []
    for seed in range(dim):
        h, at = seed, 0
        for ch in text:
            h = (h * 31 + ord(ch) + at) % 2**32
            at += len(ch.encode())
        v.append(np.float32(h % 10000 - 5000) / np.float32(10000))
    v = np.array(v, np.float64)
    s = float(v @ v)
    return v if s == 0 else v / (s if legacy else s**0.5)


@pytest.mark.parametrize("legacy", [False, True])
def test_seeded_embedding_equals_a_loop(spark, legacy):
    texts = ["", "a", "Hello 世界 🙂", "word " * 500, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.v for r in rows.select("id", embedding.provider("seeded", dim=8, legacy=legacy)(F.col("text")).alias("v")).collect()}
    assert got[4] is None
    for i, t in enumerate(texts[:4]):
        assert np.allclose(got[i], looped(t, 8, legacy), rtol=1e-5)


def test_remote_provider_asks_in_blocks(spark):
    def client():
        def ask(texts):
            assert 0 < len(texts) <= 3
            return [[len(t), 1] for t in texts]

        return ask

    rows = spark.createDataFrame([(i, None if i == 4 else "x" * i) for i in range(10)], "id int, text string").coalesce(1)
    got = {r.id: r.v for r in rows.select("id", embedding.provider("remote", client=client, block=3)(F.col("text")).alias("v")).collect()}
    assert got == {i: None if i == 4 else [float(i), 1.0] for i in range(10)}
    with pytest.raises(ValueError):
        embedding.provider("none")


def test_user_limit_returns_to_the_usual_rate():
    limit = hosting.UserLimit(1, 1)
    assert limit.admit(0, 10, 1000) and not limit.admit(50, 10, 1000) and limit.admit(150, 10, 1000)
    fresh = hosting.UserLimit(1, 1)
    assert fresh.admit(0) and not fresh.admit(500, 10, 400) and fresh.admit(1500, None, None)


def test_admission_in_order():
    pool = hosting.Admission(workers=1, queue=1)
    assert pool.arrive(0, 100) == ("admitted", 0)
    assert pool.arrive(10, 100) == ("admitted", 100)
    assert pool.arrive(20, 100) == ("backlog", None)
    assert pool.arrive(100, 100) == ("admitted", 200)
    scarce = hosting.Admission(workers=9, rate=1, burst=1)
    assert [scarce.arrive(t, 1)[0] for t in (0, 10, 1010)] == ["admitted", "exhausted", "admitted"]


@pytest.fixture
def vectors(spark):
    rows = [(i, [float(i), 1.0], i < 5) for i in range(20)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, hot boolean")


def test_hot_first_plan(vectors):
    q = [0.0, 1.0]
    hits, cold = segments.planned_search(vectors, q, 3, metric="l2")
    assert [r.vec_id for r in hits.collect()] == [0, 1, 2] and not cold
    hits, cold = segments.planned_search(vectors, q, 7, metric="l2")
    assert [r.vec_id for r in hits.collect()] == list(range(7)) and cold
    hits, cold = segments.planned_search(vectors, q, 3, least_hot=9, metric="l2")
    assert [r.vec_id for r in hits.collect()] == [0, 1, 2] and cold
    assert not segments.planned_search(vectors, q, 3, least_hot=9, hot_ms=[1], cold_ms=[9] * 10, metric="l2")[1]
    with pytest.raises(ValueError):
        segments.search(vectors, q, kind="none")


def test_inserts_deletes_and_merges(spark, vectors):
    empty = vectors.where("false").withColumn("segment_id", F.lit(0))
    rows = segments.insert(empty, vectors.drop("vec_id").repartition(3))
    ids = [r.vec_id for r in rows.collect()]
    assert len(set(ids)) == 20 and min(ids) >= 0 and {r.segment_id for r in rows.collect()} == {0}
    gone = spark.createDataFrame([(3,), (3,), (99,)], "vec_id long")
    assert segments.deleted(vectors, gone, ["vec_id"]).count() == 19
    dealt = vectors.withColumn("segment_id", F.when(F.col("vec_id") < 10, 0).when(F.col("vec_id") < 18, 1).otherwise(2))
    sizes = lambda d: sorted(r["count"] for r in d.groupBy("segment_id").count().collect())
    assert sizes(segments.merged(dealt, 10, 2)) == [20]
    assert sizes(segments.merged(dealt.where("segment_id = 0"), 10, 2)) == [10]
    assert segments.merged(dealt.where("false"), 10, 2).count() == 0


def test_hooks_fail_as_declared(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, v int")
    verdict = lambda: F.col("v") < 10
    got = lambda *hooks: {r.id: (r.decision, r.decided_by) for r in hosting.admitted(rows, hooks).collect()}
    assert got(hosting.Hook("h", verdict)) == {1: ("allow", None), 2: ("deny", "h"), 3: ("deny", "h")}
    assert got(hosting.Hook("h", verdict, on_failure="allow"))[2] == ("allow", None)
    assert got(hosting.Hook("h", verdict, lambda: F.col("id") == 1))[3] == ("allow", None)
    assert got()[3] == ("allow", None)


def test_hook_and_route_errors(spark):
    hooks = spark.createDataFrame([("before", "s3:GetObject", "f", 5, None), ("after", "get", "f", 5, ""), ("x", None, None, None, None), ("around", "s3:PutObject", "f", 100, ""), ("around", "s3:PutObject", "f", 9, "maybe")], "k string, o string, h string, p int, f string")
    got = [r[0] for r in hooks.select(hosting.hook_error(*[F.col(c) for c in "kohpf"])).collect()]
    assert got == [None, "op", "type", "priority", "on_failure"]
    routes = spark.createDataFrame([("/admin/",), ("/mine/",), ("mine",), (None,)], "p string")
    assert [r[0] for r in routes.select(hosting.route_error(F.col("p"))).collect()] == ["reserved", None, "not a path", "not a path"]


def test_resource_names_and_lists(spark):
    rows = spark.createDataFrame([("b", "k/x"), ("b", None), ("b", "")], "b string, k string").select(S.resource_name(F.col("b"), F.col("k")).alias("a"))
    assert [tuple(r) for r in rows.select(*S.resource_parts(F.col("a"))).collect()] == [("b", "k/x"), ("b", ""), ("b", "")]
    other = spark.createDataFrame([("urn:x",)], "a string").select(*S.resource_parts(F.col("a"))).first()
    assert tuple(other) == ("", "")
    runs = spark.createDataFrame([("b", "k", 1), ("b", "j", 2), ("c", "k", 3)], "bucket string, object_key string, at int")
    assert ops.executions(runs).count() == 3 and ops.executions(runs, object_key="k").count() == 2
    assert [r.at for r in ops.newest(runs, ["at"], 2).collect()] == [3, 2]


def chunk(kind, body):
    return len(body).to_bytes(4, "big") + kind + body + b"\0\0\0\0"


def png(width, height, colour, extra=b""):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", b"tRNS")


IMAGES = [
    (png(640, 480, 6), ("png", 640, 480, True)),
    (png(3, 70_000, 2), ("png", 3, 70_000, False)),
    (png(5, 5, 3, chunk(b"tRNS", b"\0")), ("png", 5, 5, True)),
    (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x0b\x08\x01\x02\x03\x04\x01\x11\x00", ("jpeg", 772, 258, False)),
    (b"GIF89a\x0a\x00\x14\x00" + bytes(8), ("gif", 10, 20, False)),
    (b"BM" + bytes(16) + struct.pack("<iiHH", 7, -9, 1, 32) + bytes(20), ("bmp", 7, 9, True)),
    (b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(4) + b"\x10\0\0\0" + b"\x09\0\0" + b"\x13\0\0", ("webp", 10, 20, True)),
    (b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + (9 | 19 << 14).to_bytes(4, "little"), ("webp", 10, 20, False)),
    (b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 10, 20), ("webp", 10, 20, False)),
    (b"\xff\xd8\xff", None), (b"\x89PNG\r\n\x1a\n", None), (b"text", None), (b"", None), (None, None),
]


def test_image_facts(spark):
    rows = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _) in enumerate(IMAGES)], "id int, content binary")
    got = {r.id: r.f for r in rows.select("id", images.facts(F.col("content")).alias("f")).collect()}
    for i, (_, want) in enumerate(IMAGES):
        assert tuple(got[i]) == (want or (None,) * 4), i


def test_graph_stats_count_rows(vectors):
    got = ann.graph_stats(ann.graph_index(vectors, 8), [0.0, 1.0], 3).collect()
    assert sum(r.n_rows for r in got) == 20 and all(0 < r.n_expanded <= r.n_rows for r in got)
