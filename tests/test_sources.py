import random
import struct

import pytest
from pyspark.sql import functions as F

from marlstone.operators import writes
from marlstone.sources import codecs, lake


def test_vector_codec_refuses_bad_lengths():
    v = [0.5, -1.25, 3.0]
    assert codecs.decode_vector(codecs.encode_vector(v)) == v
    for bad in (None, b"", b"\x01", codecs.encode_vector(v)[:-1], codecs.encode_vector(v) + b"x"):
        assert codecs.decode_vector(bad) is None


@pytest.mark.parametrize("seed", range(5))
def test_posting_codec_round_trip(seed):
    rng = random.Random(seed)
    docs = sorted(rng.sample(range(10**9), 40))
    postings = [(d, sorted(rng.sample(range(10**5), rng.randrange(0, 30)))) for d in docs]
    assert codecs.decode_postings(codecs.encode_postings(postings)) == postings
    assert codecs.encode_postings([]) is None and codecs.decode_postings(None) == []


def test_fvecs(spark, tmp_path):
    rows = [[float(i), i / 2, -1.0] for i in range(10)]
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i3f", 3, *r) for r in rows))
    got = codecs.read_fvecs(spark, f"{tmp_path}/a.fvecs").orderBy("row").collect()
    assert [list(r.v) for r in got] == rows


def test_text_types_and_blobs(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    b = lake.blobs(spark, str(tmp_path)).withColumn("content_type", F.lit("text/plain"))
    assert [r.text for r in lake.indexed_text(b).collect()] == ["hello"]
    kinds = spark.createDataFrame([("text/x",), ("application/json",), ("application/ld+json",), ("image/png",)], "k string")
    assert [tuple(r) for r in kinds.select(lake.is_text(F.col("k")), lake.is_text(F.col("k"), True)).collect()] == [(True, True), (True, True), (False, True), (False, False)]


def test_configuration_and_event_log(spark, tmp_path):
    p = lake.load_pipelines('{"pipelines": [{"name": "a", "trigger": "on_get", "filter": "size > 1KB", "steps": [{"plugin": "encrypt_pii", "on_error": "skip"}]}]}')
    assert p[0].steps[0].name == "encrypt_pii" and p[0].steps[0].on_error == "skip" and p[0].trigger == "on_get"
    (tmp_path / "log.json").write_text('{"execution_id":"2","workflow":"w","type":"step.failed","time":"2024-01-02T00:00:00Z"}\n{"execution_id":"1","workflow":"v","type":"started","time":"2024-01-01T00:00:00Z"}\n')
    read = lambda **k: [r.execution_id for r in lake.event_log(spark, f"{tmp_path}/log.json", **k).collect()]
    assert (read(), read(since="2024-01-01 12:00:00"), read(workflow="v"), read(failed_only=True)) == (["1", "2"], ["2"], ["1"], ["2"])


def test_lines_and_headers(spark):
    df = spark.createDataFrame([('a"b\\c', 3, {"X-Amz-Meta-Team": "x", "Host": "h"})], "k string, n int, h map<string,string>")
    assert lake.exposition(df, "m", ["k"], "n").first()[0] == 'm{k="a\\"b\\\\c"} 3'
    assert df.select(lake.user_metadata(F.col("h"))).first()[0] == {"team": "x"}
    w = lake.wal_entries(df, "put", F.lit("2024-01-01").cast("timestamp"), ["k", "n"]).first()
    import zlib

    assert w.crc == zlib.crc32(w.data.encode()) and w.type == "put"


def test_claims_and_access(spark):
    tasks = spark.createDataFrame([(1, 5, 10, 0), (2, 9, 20, 0), (3, 9, 5, 0), (4, 99, 1, 100)], "task_id int, priority int, created_ms long, next_at_ms long")
    assert [r.task_id for r in writes.claims(tasks, 50, 2).collect()] == [3, 2]
    r = spark.createDataFrame([("admin", "u", "o", "b", "put", False, []), ("viewer", "u", "u", "b", "put", False, []), ("viewer", "u", "o", "b", "get", True, []), ("viewer", "u", "o", "b", "put", True, ["b:put"]), ("viewer", "u", None, "b", "put", True, None)], "role string, user string, owner string, bucket string, action string, public boolean, permissions array<string>")
    assert [x.allow for x in writes.role_access(r).collect()] == [True, True, True, True, False]


class Cluster:
    """A session that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():
            return {}


def test_no_local_folder_on_a_cluster():
    from marlstone.sources import tables

    with pytest.raises(ValueError):
        tables.shared_folder(Cluster)


def test_shards_and_logs_come_back(spark, tmp_path):
    from marlstone.sources import sinks

    rows = [(1, b""), (2, b"x"), (3, bytes(range(256)) * 3), (4, "é🙂".encode() * 7)]
    df = spark.createDataFrame(rows, "id long, content binary")
    got = sinks.joined_shards(sinks.shards(df, "id", 3), "id").collect()
    assert sorted((r.id, bytes(r.content)) for r in got) == rows
    assert len({len(r.part) for r in sinks.shards(df.where("id = 3"), "id", 3).collect()}) == 1
    lines = spark.range(1000).selectExpr("concat('line ', id) AS value").repartition(2)
    folder = sinks.write_lines(lines, f"file://{tmp_path}/log", most_bytes=2000)
    assert sorted(r.value for r in spark.read.text(folder).collect()) == sorted(f"line {i}" for i in range(1000))
    sizes = [p.stat().st_size for p in (tmp_path / "log").glob("*.txt")]
    assert len(sizes) >= 5 and max(sizes) <= 2200
