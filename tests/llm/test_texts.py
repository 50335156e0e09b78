import base64
import bz2
import collections
import gzip
import hashlib
import lzma
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import common, licenses, mixing, packing, quality, secret_scan, simhash, substring_dedup, token_counts
from tests.llm import data


@pytest.fixture(scope="module")
def docs(spark):
    return data.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same_rows(a, b):
    return collections.Counter(a) == collections.Counter(b)


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# 6 ---------------------------------------------------------------------------------------------------------------


def substring_brute(rows, window=20):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [(d is None, d or 0, signed(xxhash.xxh64_intdigest((t or "").encode(), 42))) for d, t in rows]
    first = {}
    split = [WORDS.findall(t or "") for _, t in rows]
    for key, w in zip(keys, split, strict=True):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (key, s)), (key, s))
    out = []
    for (d, _), key, w in zip(rows, keys, split, strict=True):
        covered = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (key, s):
                covered.update(range(s, s + window))
        kept = [x for i, x in enumerate(w) if i not in covered]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def substring_rows(got):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]


def test_substrings_equal_brute_force(docs, plain):
    got = substring_dedup.dedup_substrings(docs).collect()
    assert same_rows([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], substring_brute(plain))
    assert sum(r.n_removed for r in got) > 100 and any(r.n_factors for r in got)


def test_substrings_in_small_chunks_and_batches(docs, plain, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = substring_rows(substring_dedup.dedup_substrings(docs, window=7, gram=3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert same_rows(got, substring_brute(plain, 7))


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_false_matches_are_told_apart(spark, bits):
    """Checks of a few bits make false matches everywhere; the words decide."""
    rng = random.Random(bits)
    phrase = [f"p{i}" for i in range(6)]
    word = lambda: f"w{rng.randrange(60)}"
    base = [[word() for _ in range(14)] + phrase + [word() for _ in range(14)] for _ in range(80)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(base[i][5:] + [word() for _ in range(30)] + base[-1 - i])) for i in range(40)]
    rows += [(200 + i, " ".join(base[rng.randrange(80)] + base[rng.randrange(80)][:22])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert same_rows(substring_rows(substring_dedup.dedup_substrings(df, check_bits=bits)), substring_brute(rows))


def test_unique_texts_around_a_phrase_stay_whole(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = [(i, " ".join([word() for _ in range(14)] + ["six", "words", "that", "all", "texts", "share"] + [word() for _ in range(14)])) for i in range(60_000)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got.where("n_removed > 0").count() == 0 and got.count() == 60_000


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(3000)}" for _ in range(340_000)]
    words[330_000:330_100] = words[10:110]
    words[299_950:300_050] = words[500:600]
    rows = [(1, " ".join(words)), (2, " ".join(words[299_990:300_025])), (3, " ".join(words[5:60]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert same_rows(substring_rows(substring_dedup.dedup_substrings(df)), substring_brute(rows))


def test_greedy_factors_cover_what_the_matches_cover():
    rng = random.Random(2)
    for _ in range(300):
        spans = sorted((a, a + rng.randrange(1, 20)) for a in (rng.randrange(80) for _ in range(rng.randrange(0, 12))))
        got = substring_dedup.factors(spans)
        assert set().union(*[range(a, e) for a, e in got]) == set().union(*[range(a, e) for a, e in spans])
        assert set(got) <= set(spans) and all(x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_substrings_of_nothing(spark):
    assert substring_dedup.dedup_substrings(data.empty_documents(spark)).collect() == []


# 4 ---------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text, shingle=3):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def component_brute(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = collections.defaultdict(lambda: None)
    for i, d in enumerate(ids):
        r = root(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return [(d, prints[i], least[root(i)]) for i, d in enumerate(ids)]


def test_simhash_equals_brute_force(docs, plain):
    prints = [slow_fingerprint(t) for _, t in plain]
    got = simhash.near_duplicates(docs).collect()
    assert same_rows([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], component_brute([d for d, _ in plain], prints))


@pytest.mark.parametrize("bucket,small", [(2048, 64), (40, 8), (7, 2)])
def test_near_links_on_chains_and_hot_buckets(spark, bucket, small, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(bucket)
    prints = {int(x) for x in rng.integers(0, 1 << 64, 150, dtype=np.uint64)}
    for start in list(prints)[:6]:
        x = start
        for _ in range(40):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints], "fp long").repartition(3)
    from marlstone.llm.components import connected_components

    roots = {r.node % (1 << 64): r.root for r in connected_components(simhash.near_links(table)).collect()}
    groups = collections.defaultdict(set)
    for p in prints:
        groups[roots.get(p, ("alone", p))].add(p)
    want = collections.defaultdict(set)
    for p, _, c in component_brute(prints, prints):
        want[c].add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_counters(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 7, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    near = simhash.within(iter(simhash.planes(a ^ b)), radius)
    assert simhash._lanes(near, len(a)).tolist() == [i for i in range(300) if i % 7 <= radius]
    far = simhash.within(iter(simhash.planes(np.full(64, ~np.uint64(0)))), radius)
    assert far is None


def test_one_document_of_each_component_stays(docs, plain, spark):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    prints = [slow_fingerprint(t) for _, t in plain]
    groups = collections.defaultdict(list)
    parent = component_brute([i for i in range(len(plain))], prints)
    for i, _, c in parent:
        groups[c].append(plain[i][0])
    want = [min((d is None, d or 0) for d in g) for g in groups.values()]
    assert same_rows([(r.doc_id is None, r.doc_id or 0) for r in kept.collect()], want)
    assert simhash.deduplicated(data.empty_documents(spark)).count() == 0
    assert simhash.near_duplicates(data.empty_documents(spark)).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


KEY = "AKIA" + "Q7" * 9
SECRETS = [
    "", "nothing here", 'Password: "hunter22" and TOKEN=abc', f"x {KEY}y AKIAAKIA{'B' * 14} AKIA1", "a" * 24 + "g" + "0f" * 30, "secret=token:abcdefgh api_key = 'k.e-y_=/+1'",
    "paßword=toolong1 paſsword=abcdefgh toKen=abcdefgh é token=é123456 apikey:abcdefg", "secret = secret = abcdefgh", f"{'z' * 5000} token=abcdef {'deadbeef' * 20}",
]


@pytest.mark.parametrize("text", SECRETS)
def test_base_spans_equal_the_plain_rules(text):
    assert secret_scan.scan(text)[0] == base_brute(text)


def wrap(kind, data):
    return {
        "url": lambda: "".join(f"%{b:02X}" for b in data.encode()),
        "unicode": lambda: "".join(f"\\u{ord(c):04x}" for c in data),
        "base64": lambda: base64.b64encode(data.encode()).decode(),
        "gzip": lambda: base64.b64encode(gzip.compress(data.encode())).decode(),
        "zlib": lambda: base64.b64encode(zlib.compress(data.encode())).decode(),
        "bz2": lambda: base64.b64encode(bz2.compress(data.encode())).decode(),
    }[kind]()


@pytest.mark.parametrize("layers", [["url"], ["unicode"], ["base64"], ["gzip"], ["zlib"], ["bz2"], ["base64", "url"], ["url", "base64"], ["gzip", "base64"], ["base64", "unicode", "gzip", "url"], ["base64"] * 4])
def test_nested_layers_map_back_to_their_place(layers):
    inner = f"key {KEY} password=correcthorse"
    for k in layers:
        inner = wrap(k, inner)
    text = f"Some words é before, {inner} and after"
    base, spans, _ = secret_scan.scan(text)
    at = text.index(inner)
    found = [s for s in spans if s not in base]
    assert {k for _, k, _ in found} >= {0, 1}
    assert all(at <= a < b <= at + len(inner) for a, _, b in found)
    assert "correcthorse" not in secret_scan.redact(text) and inner not in secret_scan.redact(text)


BLOB = f"the first words of a longer text, then password=correcthorse and the key {KEY} stand here, é and some more words after them"


@pytest.mark.parametrize("kind", ["base64", "gzip", "zlib", "bz2"])
@pytest.mark.parametrize("width,newline", [(64, "\n"), (76, "\r\n"), (20, "\n  ")])
def test_wrapped_base64_is_one_run(kind, width, newline):
    blob = wrap(kind, BLOB)
    lines = newline.join(blob[i : i + width] for i in range(0, len(blob), width))
    text = f"-----BEGIN-----\n{lines}\n-----END----- and after"
    spans = secret_scan.scan(text)[1]
    assert {k for _, k, _ in spans} >= {0, 1}
    assert all(text.index(lines) <= a < b <= text.index(lines) + len(lines) for a, _, b in spans)


@pytest.mark.parametrize("kind", ["base64", "gzip", "zlib", "bz2"])
@pytest.mark.parametrize("before", ["path/", "key_", "a-", "ab", "data/x/", "Zz9/"])
def test_base64_after_characters_of_its_alphabet(kind, before):
    text = f"see {before}{wrap(kind, BLOB)} and after"
    spans = secret_scan.scan(text)[1]
    assert {k for _, k, _ in spans} >= {0, 1}
    assert all(a >= 4 and b <= len(text) - 10 for a, _, b in spans)
    assert not secret_scan.scan(secret_scan.redact(text))[1]


def test_text_within_bytes_that_are_no_text():
    data = b"\xff\xfe\x00\x01" * 9 + b"password=correcthorse" + b"\x80\x81\x02" * 9
    blob = base64.b64encode(data).decode()
    spans = secret_scan.scan(f"x {blob} y")[1]
    assert len(spans) == 1 and base64.b64decode(blob)[28:63].find(b"correcthorse") > 0
    a, kind, b = spans[0]
    assert kind == 0 and 2 + 36 * 4 // 3 <= a < b <= 2 + 58 * 4 // 3


def packed(kind, data):
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    return {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress}[kind](data)


@pytest.mark.parametrize("kind", ["gzip", "zlib", "bz2", "xz", "zstd"])
def test_all_members_are_read_past_any_window(monkeypatch, kind):
    rng = random.Random(4)
    filler = lambda n: " ".join(f"wörd{rng.randrange(10**6)}," for _ in range(n)).encode()
    parts = [filler(50), filler(3000) + b" password=correct", b"horse, " + filler(3000) + f" {KEY}".encode()]
    blob = base64.b64encode(b"".join(packed(kind, x) for x in parts)).decode()
    for window in (64 << 20, 20_000, 1_000):
        monkeypatch.setattr(secret_scan, "MAX_LAYER", window)
        text = f"see {blob} and after"
        assert {k for _, k, _ in secret_scan.scan(text)[1]} >= {0, 1}
        assert blob[:40] not in secret_scan.redact(text)


def test_a_text_that_looks_compressed_is_still_a_text():
    assert secret_scan.scan(wrap("gzip", "x^2 password=correcthorse"))[1]


def test_percent_spans_are_exact():
    text = "see password%3Dhunter2%61bc now"
    spans = secret_scan.scan(text)[1]
    assert text[spans[0][0] : spans[0][2]] == "password%3Dhunter2%61bc"


def test_cycles_and_bombs_end():
    assert secret_scan.scan("%25" * 2000 + "41")[1] == []
    assert secret_scan.scan(wrap("gzip", "a" * 3_000_000))[1] != []  # a run of hexadecimal letters
    assert secret_scan.scan("%zz %E9%zz \\uD800 \\u{110000} &#99999999; " + "QUJD" * 30)[2] >= 1


@pytest.mark.parametrize("levels", [3, 7, 8, 9, 12, 400, 30_000])
def test_deeply_nested_escapes_end_in_their_text(levels):
    for nested in ("password%" + "25" * levels + "3Dcorrecthorse", "password\\" + "u005c" * levels + "u003dcorrecthorse", "password&" + "#38;" * levels + "#61;correcthorse"):
        text = f"see {nested} now"
        _, spans, layers = secret_scan.scan(text)
        assert (4, 0, 4 + len(nested)) in spans and layers <= 2 * secret_scan.MAX_STEPS + 4
    both = "secret=" + "%5cu0025" + "5cu0025" * levels + "41KIAB" + "Q7" * 9
    assert secret_scan.scan(both)[2] <= 4 * secret_scan.MAX_STEPS


def test_memory_of_escapes_in_a_long_text():
    import tracemalloc

    text = "plain words, %41 and more of them " * 30_000
    tracemalloc.start()
    assert secret_scan.scan(text)[2] == 1
    assert tracemalloc.get_traced_memory()[1] < 45 * len(text)
    tracemalloc.stop()


def test_secret_scan_on_a_table(docs, plain, spark):
    got = secret_scan.scan_secrets(docs).collect()
    want = []
    for d, t in plain:
        b = base_brute(t or "")
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in b)
        want.append((d, *[sum(x[1] == k for x in b) for k in range(3)], hashlib.sha256(said.encode()).hexdigest()))
    assert same_rows([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got], want)
    assert secret_scan.scan_secrets(data.empty_documents(spark)).count() == 0
    clean = secret_scan.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()


# 5 ---------------------------------------------------------------------------------------------------------------


def license_brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(w), sorted(places), sorted(labels)


TEXTS = [
    "Licensed under the MIT License, under the\nMIT license; CC-BY-NC cc by nc by nc", "Apache License, Version 2.0 and the Apache license version 2", "under the mit licenses cc by ncé mit", None, "", "é", "cc by cc by nc" * 50,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_labels_equal_a_plain_search(text):
    got = licenses.scan(text)
    assert (got["n_words"], sorted(got["places"]), sorted(got["base"])) == license_brute(text)
    assert got["base"] <= got["labels"] and 0 <= got["score"] <= 1


@pytest.mark.parametrize(
    "expression,labels,score,well",
    [
        ("MIT", ["mit"], 1.0, True), ("MIT OR GPL-3.0-only", ["mit", "gpl-3"], 1.0, True), ("MIT AND GPL-3.0-or-later", ["mit", "gpl-3"], 0.4, True),
        ("MIT OR GPL-2.0 AND CC-BY-NC-4.0", ["mit", "gpl-2", "cc-by-nc"], 1.0, True), ("(MIT OR GPL-2.0) AND CC-BY-NC-4.0", ["mit", "gpl-2", "cc-by-nc"], 0.1, True),
        ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2"], 0.4, True), ("(MIT AND", ["mit"], 1.0, False), ("Own-License-1.0", ["own-license-1"], 0.5, True), ("OR MIT", [], None, False), ("", [], None, False),
        ("MIT and this file is free", ["mit", "this"], 0.5, True),
    ],
)
def test_expressions(expression, labels, score, well):
    assert licenses.evaluate(expression) == (labels, score, well)


@pytest.mark.parametrize(
    "text,expressions,labels",
    [
        ("SPDX-License-Identifier: MIT text here // SPDX-License-Identifier: GPL-3.0-only", ["MIT", "GPL-3.0-only"], ["gpl-3", "mit"]),
        ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */ a(); /* spdx-license-identifier: ISC */ /* SPDX-License-Identifier: (MIT AND Zlib) */", ["MIT or Apache-2.0", "ISC", "( MIT and Zlib )"], ["apache-2", "isc", "mit", "zlib"]),
        ("SPDX License Identifier: MIT", ["MIT"], ["mit"]),
        ('{"SPDX-License-Identifier": "MIT"}', ["MIT"], ["mit"]),
        (" * SPDX-License-Identifier:\r\n *   (MIT OR GPL-2.0-only)\n * more", ["( MIT or GPL-2.0-only )"], ["gpl-2", "mit"]),
        ("# SPDX-License-Identifier:\n# Own-License-1.0\n", ["Own-License-1.0"], ["own-license-1"]),
        ("SPDX-License-Identifier:\n\nint main() {}", [], []),
        ("every SPDX-License-Identifier line is read", [], []),
        ("éspdx-license-identifier: MIT, SPDX-License-Identifiers: MIT", [], []),
    ],
)
def test_each_tag_has_its_own_expression(text, expressions, labels):
    got = licenses.scan(text)
    assert (got["expressions"], sorted(got["labels"])) == (expressions, labels)


def test_places_of_many_hits_are_counted_once():
    import time

    text = "cc by nc, under the MIT license. " * 40_000
    start = time.perf_counter()
    got = licenses.scan(text)
    assert time.perf_counter() - start < 5 and len(got["places"]) == 80_000
    assert (got["places"][:4], got["places"][-1]) == ([0, 3, 7, 10], 7 * 39_999 + 3)


def test_licenses_on_a_table(docs, plain, spark):
    tagged = spark.createDataFrame([(9, "x\n// SPDX-License-Identifier: (Apache-2.0 OR MIT)\ncode")], "doc_id long, text string")
    r = licenses.scan_licenses(tagged).first()
    assert r.labels == ["apache-2", "mit"] and r.score == 1.0 and r.expressions == ["( Apache-2.0 or MIT )"]
    got = licenses.scan_licenses(docs).collect()
    assert same_rows([(r.doc_id, r.n_words) for r in got], [(d, license_brute(t)[0]) for d, t in plain])
    assert licenses.scan_licenses(data.empty_documents(spark)).count() == 0


# 2 and 8 ---------------------------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer(plain):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.encoder(packing.default_tokenizer())
    odd = ["Ǆ İstanbul ß ẞ ΣΑΣ ſ ¼ x²", "á é b\u0085c <|endoftext|> d<|startoftext|>x", "I'LL don't '’s a\x1cb \x00 c\t\td", "日本語 テスト한국어 🙂x", "µ ª º ǅ ŉ ʼn", "x\xady​ z　w é", "", " "]
    for t in odd + [t or "" for _, t in plain]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_ids_of_all_plain_characters_and_long_words():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.encoder(packing.default_tokenizer())
    assert encode.merge is not None
    rng = random.Random(8)
    chars = [chr(c) for c in range(0x20, 0x260)]
    letters = [c for c in chars if c.isalpha()]
    texts = [c for c in chars] + [f"a{c}b {c}{c} x{c} {c}'s7" for c in chars]
    texts += ["".join(rng.choices(rng.choice([letters, "ab", "etaoinsr", chars]), k=rng.choice([1, 3, 9, 40, 99, 100, 101, 700]))) for _ in range(500)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == want
    # Together, plain words and others, empty texts and nulls first, last and between.
    mixed = [None, "", *texts, "", "日本 <|endoftext|>x <|ENDOFTEXT|>", None, "\n \n", ""]
    assert [x.tolist() for x in encode.many(pa.array(mixed))] == [tok.encode(t or "", add_special_tokens=False).ids for t in mixed]
    assert encode.many(pa.array([], pa.string())) == []


def test_merges_that_could_differ_are_left_to_the_tokenizer(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        file = json.load(f)
    first = {t: i for t, i in file["model"]["vocab"].items() if i < 512}

    def model(*merges):
        return file["model"] | {"merges": [list(m) for m in merges], "vocab": first | {a + b: 512 + i for i, (a, b) in enumerate(merges)}}

    # "abc" comes to a, bc: the model has no merge for that pair, though both together are a token.
    differs = model(("b", "c"), ("a", "b"), ("ab", "c"), ("abc", "d</w>"))
    assert packing.byte_ranks(differs) is None
    assert packing.byte_ranks(model(("b", "c"), ("a", "bc"), ("abc", "d</w>"))) is not None
    assert packing.byte_ranks(model(("b", "c"), ("a", "bc")) | {"dropout": 0.1}) is None
    path = str(tmp_path / "differs.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file | {"model": differs, "added_tokens": []}, f)
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    for t in ("abcd xabcdx abc", "Abcé ab,cd\nabcd"):
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_new_words_cost_less_than_half_of_the_tokenizer():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.encoder(packing.default_tokenizer())
    encode("warm")
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("etaoinshrdluäöüé", k=rng.randrange(4, 14))) + rng.choice(["", "", ",", ".", "***"]) for _ in range(30_000)) for _ in range(3)]

    def seconds(ids):
        took = []
        for t in texts:
            start = time.process_time()
            ids(t)
            took.append(time.process_time() - start)
        return min(took)

    assert seconds(encode) < seconds(lambda t: tok.encode(t, add_special_tokens=False).ids) / 2


def test_groups_of_texts():
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 10, packing.TEXTS_BYTES // 3, packing.TEXTS_BYTES, packing.TEXTS_BYTES + 1]) for _ in range(60)]
    texts = pa.array([None if s == 0 else "x" * s for s in sizes])
    for part, own in ((texts, sizes), (texts.slice(7, 20), sizes[7:27]), (texts.slice(0, 0), [])):
        got = list(packing._groups(part))
        assert [i for a, b in got for i in range(a, b)] == list(range(len(own)))
        assert all(b - a == 1 or sum(own[a:b]) <= packing.TEXTS_BYTES for a, b in got)


def best_fit(lengths, capacity):
    """Sequential best-fit decreasing: the number of sequences."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 60))
    lengths = rng.integers(1, capacity + 1, 300).tolist()
    plan = packing.schedule(dict(collections.Counter(lengths)), capacity)
    used = collections.defaultdict(list)
    for length, _, n, first, offset in plan:
        for k in range(n):
            used[first + k].append((offset, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == best_fit(lengths, capacity)
    assert collections.Counter(x for parts in used.values() for _, x in parts) == collections.Counter(lengths)


def packed_alone(lengths, capacity, ranges):
    """The rounds' plan without Spark, each swept over ``ranges`` ranges and then over what they left."""

    def one(gaps, pieces):
        runs = sorted([(packing.GAP, *g) for g in gaps] + [(packing.PIECES, *p) for p in pieces], key=lambda r: (-r[1], r[0], r[2]))
        cuts = sorted({i * len(runs) // ranges for i in range(ranges)} | {len(runs)})
        matches, left, shrunk = [], [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            m, rest = packing.sweep(runs[a:b])
            matches += m
            left += [r for r in rest if r[0] != packing.SHRUNK]
            shrunk += [r[1:] for r in rest if r[0] == packing.SHRUNK]
        m, left = packing.sweep(sorted(left, key=lambda r: (-r[1], r[0], r[2])))
        return matches + m, [r[1:] for r in left if r[0] != packing.PIECES] + shrunk, [r[1:] for r in left if r[0] == packing.PIECES]

    return packing.rounds(dict(collections.Counter(lengths)), capacity, one)


def check_plan(plan, lengths, capacity):
    """Sequences of a plan that places every piece once, without gaps or overlaps."""
    used, ranks = collections.defaultdict(list), collections.Counter()
    for length, rank, n, first, offset in plan:
        for k in range(n):
            used[first + k].append((offset, length))
            ranks[length, rank + k] += 1
    assert set(ranks.values()) <= {1}
    assert collections.Counter(length for length, _ in ranks) == collections.Counter(lengths)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@pytest.mark.parametrize("seed", range(8))
def test_rounds_place_every_piece_about_as_well_as_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = [30, 64, 100, 2048][seed % 4]
    n = 3000
    lengths = [
        rng.integers(1, capacity + 1, n), rng.integers(1, max(2, capacity // 8), n), rng.integers(capacity // 4, capacity // 2 + 1, n),
        np.clip(rng.lognormal(np.log(capacity / 5), 1.1, n).astype(int), 1, capacity),
    ][seed // 2]
    lengths = lengths.tolist()
    got = check_plan(packed_alone(lengths, capacity, 1 + seed), lengths, capacity)
    assert sorted(packed_alone(lengths, capacity, 1)) == sorted(packed_alone(lengths, capacity, 1))
    assert got <= best_fit(lengths, capacity) * 1.01 + 1


def test_sweeps_of_ranges_match_what_one_sweep_matches():
    rng = np.random.default_rng(3)
    for _ in range(200):
        runs = sorted([(int(rng.integers(0, 2)), int(rng.integers(1, 12)), 100 * i, int(rng.integers(1, 5))) for i in range(14)], key=lambda r: (-r[1], r[0], r[2]))
        whole, left = packing.sweep(runs)
        cut = int(rng.integers(0, 15))
        a, rest_a = packing.sweep(runs[:cut])
        b, rest_b = packing.sweep(runs[cut:])
        open_ = lambda rs: [r for r in rs if r[0] != packing.SHRUNK]
        c, rest = packing.sweep(sorted(open_(rest_a + rest_b), key=lambda r: (-r[1], r[0], r[2])))
        each = lambda ms: sorted((length, first + k, seq + k, gap) for length, first, n, seq, gap in ms for k in range(n))
        # Where a run of pieces is divided, the same gaps take as many of them, by other ranks.
        place = lambda ms: sorted((length, seq, gap) for length, _, seq, gap in each(ms))
        assert place(a + b + c) == place(whole) and sorted(open_(rest)) == sorted(open_(left))


def test_packing_round_trip(docs, plain, spark):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.packed(docs).collect()
    want = []
    for d, t in plain:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((d, i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert same_rows([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= best_fit([w[3] for w in want], 2048) * 1.01
    assert packing.packed(data.empty_documents(spark)).count() == 0


def test_token_counts_equal_a_plain_search(docs, plain, spark):
    c = token_counts.counter(token_counts.default_vocabulary())

    def slow(word):
        t = token_counts.MARK + word
        best = [(0.0, 0)] + [None] * len(t)
        for end in range(1, len(t) + 1):
            k = len(t[end - 1].encode())
            options = [(best[end - 1][0] + c.byte * k, best[end - 1][1] + k)]
            for start in range(max(0, end - c.longest), end):
                if t[start:end] in c.score:
                    options.append((best[start][0] + c.score[t[start:end]], best[start][1] + 1))
            best[end] = min(options, key=lambda o: (-o[0], o[1]))
        return best[-1][1]

    got = token_counts.token_counts(docs).collect()
    want = []
    for d, t in plain:
        w = WORDS.findall(t or "")
        want.append((d, len(w), sum(n * slow(x) for x, n in collections.Counter(w).items())))
    assert same_rows([(r.doc_id, r.n_words, r.n_tokens) for r in got], want)
    assert token_counts.token_counts(data.empty_documents(spark)).count() == 0


def test_token_counts_are_near_the_file_s_own(spark):
    """Its scores are ranks, so the counts cannot be equal."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_vocabulary())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 4 = 0")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    own = {r.doc_id: len(sp.encode(r.text)) for r in docs.select("doc_id", "text").collect()}
    assert abs(sum(got.values()) / sum(own.values()) - 1) < 0.005


def test_trie_counts_do_not_depend_on_the_batch():
    c = token_counts.counter(token_counts.default_vocabulary())
    words = [w.encode() for w in ("a", "an", "and", "andes", "under", "understanding", "understand", "日本", "日本語", "x" * 50)]
    together = c.counts(words)
    assert together == {w: c.counts([w])[w] for w in words}


# 9 ---------------------------------------------------------------------------------------------------------------


def fill_brute(sizes, weights=(3, 1, 2), total=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    want, target, free = total * sum(sizes.values()), {}, set(names)
    while free:
        left = want - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            free.discard(s)
    return target


def test_mix_meets_its_targets(docs, plain, spark):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    want = fill_brute(dict(sizes))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(5)).collect()
    assert same_rows([tuple(r) for r in got], [tuple(r) for r in again])
    assert mixing.mix(data.empty_documents(spark)).count() == 0


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, " ".join(["w"] * (i % 9 + 1)), "en", f"s{i % 3}", 0, i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    have = collections.Counter()
    for r in out.collect():
        have[r.doc_id] += len(r.text.split())
    assert {d: n for d, n in taken.items() if n} == dict(have)


def test_equal_rows_share_out_what_the_mix_takes(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n, m in ((30, 0), (3, 0), (7, 5), (1, 1)):
        rows = [(1, "a b c d e f g h i j", "en", "s1", 0)] * n + [(2 + i, "k l m n", "en", "s2", 0) for i in range(m)] + [(None, "x y z", None, None, 1)] * 4 + [(1, "j i h g f e d c b a", "en", "s1", 0)] * 2
        docs = spark.createDataFrame(rows, schema).repartition(3)
        want, have = collections.Counter(), collections.Counter()
        for r in mixing.mix(docs).collect():
            want[(r.doc_id, r.source)] += r.taken
        for r in mixing.mixed_documents(docs).collect():
            have[(r.doc_id, r.source)] += len(r.text.split())
        assert have == want
    assert mixing.mixed_documents(data.empty_documents(spark)).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------


def rated(n=1500):
    import random

    rng = random.Random(4)
    out = []
    for _ in range(n):
        bad, junk = rng.random() < 0.2, rng.random() < 0.2
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 200))]
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = f"vile{rng.randrange(6)}"
        if junk:
            w = [x + "###" for x in w]
        out.append((2 - bad - junk, quality.features(" ".join(w).encode())))
    return out


def test_held_out_accuracy():
    rows = rated()
    m = quality.fit(rows[:1000])
    assert m.thresholds[0] < m.thresholds[1]
    right = sum((m.tails(f)[-1] >= 0.5) == (g == 2) for g, f in rows[1000:])
    assert right >= 480
    grades = [m.tails(f).sum() for g, f in rows[1000:]]
    assert np.corrcoef(grades, [g for g, _ in rows[1000:]])[0, 1] > 0.8


def slow_tails(model, found):
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    x = sum(weights.get(f, 0.0) for f in found)
    return [1 / (1 + math.exp(t - x)) for t in model.thresholds]


def slow_loss(rows, weights, thresholds, ridge=0.004):
    """The penalized negative log likelihood, row by row."""
    total = 0.0
    for g, found in rows:
        x = sum(weights.get(f, 0.0) for f in found)
        tails = [1.0, *(1 / (1 + math.exp(t - x)) for t in thresholds), 0.0]
        total -= math.log(max(tails[g] - tails[g + 1], 1e-12))
    return total + ridge * len(rows) * 0.01 / 2 * sum(w * w for w in weights.values())


def test_the_fit_is_an_optimum_of_the_plain_likelihood():
    rng = random.Random(8)
    rows = [(g, sorted({rng.randrange(12) for _ in range(4)} | ({20 + rng.randrange(3)} if rng.random() < 0.6 else set()) | ({30} if g == 0 and rng.random() < 0.5 else set()))) for g in (rng.choice((0, 1, 1, 2, 2, 2)) for _ in range(260))]
    rows = [(min(2, g + (20 in f)), f) for g, f in rows]
    m = quality.fit(rows, rounds=4000, min_docs=1, min_chi2=0.0)
    assert sorted({x for _, f in rows for x in f}) == m.buckets.tolist()
    weights, thresholds = dict(zip(m.buckets.tolist(), m.weights.tolist(), strict=True)), m.thresholds.tolist()
    least = slow_loss(rows, weights, thresholds)
    for d in (0.02, -0.02):
        assert all(slow_loss(rows, weights | {b: w + d}, thresholds) > least - 2e-3 for b, w in weights.items())
        assert all(slow_loss(rows, weights, [t + d * (k == j) for j, t in enumerate(thresholds)]) > least - 2e-3 for k in range(2))
    start = slow_loss(rows, dict.fromkeys(weights, 0.0), thresholds)
    assert least < start - 5


def test_buckets_are_chosen_over_all_grades():
    # Bucket 5 tells grade 0 from the others and nothing about the top grade; no number of buckets is too many.
    rows = [(0, [5])] * 40 + [(1, [6])] * 80 + [(2, [6])] * 120 + [(1, [5])] * 4 + [(2, [5])] * 6
    assert 5 in quality.fit(rows).buckets
    many = [(g, [1000 * g + 100 + k for k in range(900)]) for g in (0, 1, 2) for _ in range(60)]
    assert len(quality.fit(many, rounds=3).buckets) == 2700


def test_scores_equal_a_plain_loop(docs, plain, spark):
    ratings = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    m = quality.train(docs, ratings, min_docs=1, min_chi2=0.0)
    again = quality.train(docs.repartition(7).union(docs), ratings.union(ratings), min_docs=1, min_chi2=0.0)
    assert (m.buckets == again.buckets).all() and (m.weights == again.weights).all() and (m.thresholds == again.thresholds).all()
    want = []
    for d, t in plain:
        tails = slow_tails(m, quality.features((t or "").encode()))
        want.append((d, *(round(x, 9) for x in (sum(tails), *tails))))
    got = quality.scored(docs, m).collect()
    assert same_rows([(r.doc_id, round(r.expected_grade, 9), round(r.p_ge_1, 9), round(r.p_ge_2, 9)) for r in got], want)
    assert len({round(r.p_ge_2, 3) for r in got}) > 10
    kept = quality.selected(docs, m).collect()
    assert same_rows([r.doc_id for r in kept], [r.doc_id for r in got if r.p_ge_2 >= quality.KEEP_AT])


def test_held_out_accuracy_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    m = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rated_rows = quality.scored(docs, m).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r for r in rated_rows if r.quality == 1 and r.toxic == 0]
    bad = [r for r in rated_rows if r.quality == 0 or r.toxic == 1]
    assert sum(r.p_ge_2 >= 0.5 for r in good) / len(good) > 0.985
    assert sum(r.p_ge_2 < 0.5 for r in bad) / len(bad) > 0.8


def test_quality_without_ratings(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = quality.train(docs, none)
    assert quality.selected(docs, m).count() == docs.count()
    odd = spark.createDataFrame([(1, None, 0), (2, 1, None), (None, 1, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.scored(docs, quality.train(docs, odd)).count() == docs.count()
    assert quality.scored(data.empty_documents(spark), m).count() == 0


# shared ----------------------------------------------------------------------------------------------------------


def test_memo_is_bounded_and_right():
    calls = []
    m = common.WordMemo(lambda ws: {w: calls.append(w) or len(w) for w in ws}, cap=10)
    for i in range(100):
        ws = [f"x{(i * 7 + k) % 60}" for k in range(8)]
        t = m.table(ws)
        assert all(t[w] == len(w) for w in ws)
        assert len(m.new) <= 18 and len(m.old) <= 18
    other = common.WordMemo(lambda ws: dict.fromkeys(ws, 0), owner="other")
    assert other.table(["a"]) == {"a": 0} and not m.new and not m.old
    assert m.table(["abc"]) == {"abc": 3} and not other.new


def test_no_local_folder_on_a_cluster():
    from tests.test_sources import Cluster

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)


def test_long_words_are_not_remembered():
    m = common.WordMemo(lambda ws: {w: len(w) for w in ws}, cap=10)
    assert [m.getter()(w) for w in ("ab", "x" * 10_000, "ab")] == [2, 10_000, 2] and list(m.new) == ["ab"]
    assert m.table(["y" * 500, "cd"])["y" * 500] == 500
    assert m.table(["ef"])["ef"] == 2 and sorted(m.new) == ["ab", "cd", "ef"]
