import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import predicates as P
from marlstone.functions import scalars as S
from marlstone.functions import stem, vectors
from marlstone.functions import text as T


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize("word,root", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("meetings", "meet"), ("is", "is"), ("", "")])
def test_stem(word, root):
    assert stem.stem(word) == root


def test_tokens(spark):
    rows = [("Hello World",), ("the cat is on the mat",), ("",), ("the a an is it",), ("Hello 世界 World",), (None,), ("x 1 é 22",)]
    got = values(spark, T.tokens(F.col("t")), rows, "t string")
    assert got == [["hello", "world"], ["cat", "mat"], [], [], ["hello", "世界", "world"], [], ["é", "22"]]
    assert T.query_tokens("The CAT, the cat sat 世") == ["cat", "sat", "世"]


def test_bm25_closed_form(spark):
    def score(tf, df, dl, n, avg):
        return spark.range(1).select(T.bm25(F.lit(tf), F.lit(df), F.lit(dl), F.lit(n), F.lit(float(avg)))).first()[0]

    want = math.log(8.5 / 2.5 + 1) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 6 / 5))
    assert abs(score(3, 2, 6, 10, 5) - want) < 1e-9
    assert score(3, 2, 6, 0, 5) == 0 and score(3, 0, 6, 10, 5) == 0
    assert score(5, 10, 25, 1000, 50) > score(5, 10, 100, 1000, 50)
    a, b, c = (score(tf, 10, 50, 1000, 50) for tf in (1, 10, 100))
    assert a < b < c and c - b < b - a


def test_snippet_and_highlight(spark):
    rows = [("hello",), ("the quick brown fox and the lazy fox",), ("a" * 200,), ("b" * 90 + "fox" + "c" * 90,)]
    got = values(spark, T.snippet(F.col("t"), ["fox"]), rows, "t string")
    assert got[0] == "hello" and got[2] == "a" * 100 + "..." and got[3].startswith("...") and "fox" in got[3] and len(got[3]) == 106
    high = values(spark, T.highlight(F.col("t"), ["Fox", "em"]), [rows[1]], "t string")[0]
    assert high.count("<em>") >= 2 and values(spark, F.size(T.fragments(T.highlight(F.col("t"), ["fox"]))), [rows[1]], "t string") == [2]
    assert values(spark, T.highlight(F.col("t"), ["a.b"]), [("a.b axb A.B",)], "t string") == ["<em>a.b</em> axb <em>A.B</em>"]
    assert values(spark, T.truncated(F.col("t"), 3), [("abcd",), ("abc",)], "t string") == ["abc...", "abc"]


def test_sizes(spark):
    rows = [("1GB",), ("10Gb",), (" 10 GB ",), ("512MB",), ("100B",), ("",), ("GB",), ("1XB",), ("abc",)]
    assert values(spark, S.parse_size(F.col("s")), rows, "s string") == [1 << 30, 10 << 30, 10 << 30, 512 << 20, 100, 0, None, None, None]
    got = values(spark, S.format_size(F.col("n")), [(0,), (512,), (1 << 10,), (1 << 20,), (1 << 30,), (1 << 40,)], "n long")
    assert got == ["0B", "512B", "1KB", "1MB", "1GB", "1TB"]
    back = values(spark, S.parse_size(S.format_size(F.col("n"))), [(k << 20,) for k in range(1, 50)], "n long")
    assert back == [k << 20 for k in range(1, 50)]


def test_mask_and_pii(spark):
    assert values(spark, S.mask_string(F.col("s")), [("abcd",), ("abcdef",), ("",)], "s string") == ["****", "ab**ef", "****"]
    rows = [("id 123456789012345 end",), ("13800138000",), ("1234-5678 90123456",), ("12800138000 12",)]
    assert values(spark, S.redact_pii(F.col("s")), rows, "s string") == ["id 12***********45 end", "13*******00", "12**************56", "12800138000 12"]


def test_checksums(spark):
    rows = [(b"",), (b"hello world",), (b"123456789",), (None,)]
    assert values(spark, S.crc32_hex(F.col("b")), rows[:3], "b binary") == ["00000000", "0d4a1185", "cbf43926"]
    assert values(spark, S.crc32c_hex(F.col("b")), rows, "b binary")[2:] == ["e3069283", None]
    assert values(spark, S.crc64_hex(F.col("b")), rows, "b binary")[2:] == ["995dc9bbdf1939fa", None]


def test_keys_and_ranges(spark):
    rows = [("docs/2026/readme.txt",), ("docs/readme.txt",), ("x",)]
    assert values(spark, S.common_prefix(F.col("k"), "docs/", "/"), rows, "k string") == ["docs/2026/", None, None]
    assert values(spark, S.parent_prefix(F.col("k")), rows, "k string") == ["docs/2026/", "docs/", ""]
    data = [(b"0123456789",)]
    for spec, want in (("bytes=2-4", b"234"), ("bytes=7-", b"789"), ("bytes=-3", b"789"), ("bytes=5-99", b"56789"), ("bytes=10-12", None), ("bytes=-99", b"0123456789")):
        got = values(spark, S.byte_range(F.col("b"), spec), data, "b binary")[0]
        assert (bytes(got) if got is not None else None) == want
    h = 2166136261
    for c in b"user/42":
        h = ((h ^ c) * 16777619) % 2**32
    assert values(spark, S.fnv1a_worker(F.col("k")), [("user/42",)], "k string") == [h % 16]


def test_delays_and_scores(spark):
    got = values(spark, S.retry_delay_ms(F.col("n"), 1000, 16_000), [(i,) for i in range(7)], "n int")
    assert got == [1000, 2000, 4000, 8000, 16000, 16000, 16000]
    assert values(spark, S.recency_score(F.col("a")), [(0.0,), (3600.0,), (86400.0,), (604800.0,), (2592000.0,), (None,)], "a double") == [100, 80, 50, 20, 0, 0]
    assert values(spark, S.status_class(F.col("c")), [(99,), (100,), (204,), (404,), (500,), (700,)], "c int") == ["5xx", "1xx", "2xx", "4xx", "5xx", "5xx"]


GLOBS = [("a*c", "abc", True), ("a?c", "ac", False), ("*", "", True), ("a.c", "abc", False), ("[a]*", "[a]x", True), ("a+b$", "a+b$", True), ("images/*", "images/photos/v.jpg", True), ("*/v.jpg", "images/v.jpg", True), ("ab", "abc", False), ("a*", "a\nb", True)]


def test_globs(spark):
    got = values(spark, P.glob_match(F.col("v"), F.col("g")), [(g, v) for g, v, _ in GLOBS], "g string, v string")
    assert got == [w for _, _, w in GLOBS]


def test_event_patterns(spark):
    rows = [("s3:ObjectCreated:Put", "s3:ObjectCreated:*"), ("s3:ObjectRemoved:Delete", "s3:ObjectCreated:*"), ("s3:ObjectRemoved:DeleteMarkerCreated", "s3:ObjectRemoved:Delete"), ("s3:ObjectCreated:Post", "s3:ObjectCreated:Post")]
    assert values(spark, P.event_type_match(F.col("t"), F.col("p")), rows, "t string, p string") == [True, False, False, True]


def test_addresses(spark):
    rows = [("192.168.1.1", "192.168.1.0/24"), ("10.0.0.1", "10.0.0.0/8"), ("11.0.0.1", "10.0.0.0/8"), ("1.2.3.4", "*"), ("1.2.3.4", "1.2.3.4"), ("300.1.1.1", "0.0.0.0/0"), ("x", "10.0.0.0/8"), ("10.0.0.1", "10.0.0.0/x")]
    want = [True, True, False, True, True, False, False, False]
    assert values(spark, P.ip_in_range_v4(F.col("a"), F.col("c")), rows, "a string, c string") == want
    six = [("::1", "::1/128"), ("2001:db8::1", "2001:db8::/32"), ("2001:db9::1", "2001:db8::/32"), *rows]
    assert values(spark, P.ip_in_range(F.col("a"), F.col("c")), six, "a string, c string") == [True, True, False, *want]


def test_url_rules(spark):
    rows = [("https://api.x.com:443/v1", 1, ["https://api.x.com/*"]), ("https://api.x.com:8443/v1", 1, ["https://api.x.com/*"]), ("http://a/", 0, ["*"]), ("http://a/", 2, None), ("http://a/", 1, [])]
    assert values(spark, P.url_allowed(F.col("u"), F.col("t"), F.col("p")), rows, "u string, t int, p array<string>") == [True, False, False, True, False]


def test_filters(spark):
    rows = [("image/png", 5000, {"k": "v"}), ("text/plain", 10, {}), ("video/mp4", 1 << 21, {"brand": "and"})]
    df = spark.createDataFrame(rows, "content_type string, size long, metadata map<string,string>")

    def hits(text):
        return [r[0] for r in df.select(P.compile_filter(text, F.col("content_type"), F.col("size"), F.col("metadata"))).collect()]

    assert hits("") == [True] * 3
    assert hits('content_type == "image/*"') == [True, False, False]
    assert hits("content_type == 'image/*' or size > 1MB") == [True, False, True]
    assert hits("metadata.brand == 'and' and size >= 2MB") == [False, False, True]
    assert hits("metadata.k != 'v'") == [False, True, True]
    assert hits("(size < 100 or content_type = 'video/mp4') and size < 1KB") == [False, True, False]
    for bad in ("colour == 'red'", "size >", "size > 3 size", "(size > 3"):
        with pytest.raises(P.SyntaxUnsupported):
            hits(bad)


def test_conditions(spark):
    df = spark.createDataFrame([("images/a.jpg", 2048.0, {"team": "x"}), ("logs/b", 10.0, {})], "key string, size double, metadata map<string,string>")
    cols, kinds = {c: F.col(c) for c in df.columns}, {"key": "string", "size": "number", "metadata": "map"}
    run = lambda t: [r[0] for r in df.select(P.compile_condition(t, cols, kinds)).collect()]
    assert run("") == [True, True]
    assert run("key.startsWith('images/') && size > 1024") == [True, False]
    assert run("metadata['team'] == 'x' || !(size >= 10)") == [True, False]
    assert run("key in ['logs/b', 'c'] || size(key) == 12") == [True, True]
    for bad in ("size", "key > 3", "unknown == 'a'", "key.foo('a')", "key ==", "key == 'a' key"):
        with pytest.raises(P.SyntaxUnsupported):
            run(bad)


def test_metrics(spark):
    df = spark.createDataFrame([([2.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(vectors.cosine_distance(a, b), vectors.dot_distance(a, b), vectors.squared_l2(a, b)).collect()] == [(0, -1, 1), (1, 1, 1)]
    assert df.select(vectors.cosine_distance(a, [1, 0, 0]), vectors.squared_l2(a, [1, 0, 0])).first()[:] == (0, 1)
    with pytest.raises(ValueError):
        vectors.metric("hamming")


def test_label_key(spark):
    assert values(spark, S.label_key(F.col("m")), [({"b": "2", "a": "1"},)], "m map<string,string>") == ["a=1,b=2"]


@pytest.mark.parametrize("poly,width", [(0x82F63B78, 32), (0xC96C5795D7870F42, 64)])
def test_long_checksums_equal_a_loop(poly, width):
    import random

    from marlstone.functions import scalars

    rng = random.Random(width)
    crc = scalars._Checksum(poly, width)
    for n in (0, 1, 255, 256, 257, 1000, 256 * 9, 5000):
        data = rng.randbytes(n)
        c = (1 << width) - 1
        for x in data:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (poly if c & 1 else 0)
        assert crc(data) == c ^ (1 << width) - 1
    assert scalars._Checksum(0x82F63B78, 32)(b"123456789") == 0xE3069283


def test_text_hash_equals_a_loop():
    from marlstone.functions import embedding

    for text in ("", "a", "the thing", "é日🙂x" * 50, "\ud800x"):
        h = at = 0
        for c in text:
            h = (31 * h + ord(c) + at) % 2**32
            at += len(c.encode("utf-8", "surrogatepass"))
        assert embedding.text_hash(text) == h
