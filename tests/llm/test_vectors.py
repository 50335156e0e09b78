import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import exact_topk, vectors, vp_search
from tests.llm import data


def brute(rows, asked, score, k):
    out = []
    for i, (q, a) in enumerate(rows):
        if asked(q):
            found = sorted((score(a, b), c) for j, (c, b) in enumerate(rows) if j != i and len(a) == len(b))[:k]
            out += [(q, r, c, s) for r, (s, c) in enumerate(found, 1)]
    return collections.Counter(out)


def inner(a, b):
    return -sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("block,annulus", [(2048, 256), (32, 5)])
def test_exact_top_k_equals_brute_force(spark, monkeypatch, block, annulus):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "ANNULUS", annulus)
    df = data.vectors(spark).repartition(3)
    got = exact_topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()
    want = brute(data.vector_rows(df), lambda i: i % 50 == 0, inner, 5)
    assert collections.Counter((r.query_id, r["rank"], r.vec_id, -r.score) for r in got) == want


def test_exact_top_k_of_huge_components(spark):
    rows = [(0, [1e12, -3.0]), (1, [2e12, 1.0]), (2, [1e12 + 1, 5.0]), (3, [-1e12, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["rank"], r.vec_id) for r in exact_topk.exact_top_k(df, F.col("vec_id") == 0).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], data.VEC_SCHEMA)
    assert exact_topk.exact_top_k(none, F.lit(True)).count() == 0
    assert vp_search.nearest(none, F.lit(True)).count() == 0
    bad = spark.createDataFrame([(0, None, 0, 0.0, 0, 0), (50, [None], 0, 0.0, 0, 0)], data.VEC_SCHEMA)
    assert exact_topk.exact_top_k(bad, F.lit(True)).count() == 0
    assert vp_search.nearest(bad, F.lit(True)).count() == 0


def test_relax_one_is_exact(spark):
    df = data.vectors(spark).repartition(3)
    rows = [r for r in data.vector_rows(df) if any(r[1])]
    got = vp_search.nearest(df, F.col("vec_id") % 100 == 0, relax=1.0, shard_rows=150).collect()
    want = brute(rows, lambda i: i % 100 == 0, lambda a, b: round(math.dist(a, b), 9), 10)
    assert collections.Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == want


def test_recall_at_the_production_factor(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = vp_search.op10_neighbours(spark, "/root/testdata/sf0.1").collect()
    rows = data.vector_rows(df)
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    hit = total = 0
    found = collections.defaultdict(dict)
    for r in got:
        found[r.query_id][r.vec_id] = r.score
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:10]
        hit += sum(int(ids[b]) in found[int(ids[i])] for b in best)
        total += 10
        for c, s in found[int(ids[i])].items():
            assert s == d[ids == c][0]
    assert hit / total >= 0.95


def test_tree_covers_every_row():
    x = np.random.default_rng(1).normal(size=(700, 6))
    tree, order = vp_search.Tree.build(x, leaf=9)
    assert sorted(order.tolist()) == list(range(700))
    row, dist, _ = tree.search(x[:20], np.full(20, -1), 3, 1.0, np.arange(700))
    assert (dist[:, 0] == 0).all() and (order[row[:, 0]] == np.arange(20)).all()


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    df = data.vectors(spark, n=90)
    got = exact_topk.exact_top_k(df, F.col("vec_id") % 5 == 0).collect()
    assert collections.Counter((r.query_id, r["rank"], r.vec_id, -r.score) for r in got) == brute(data.vector_rows(df), lambda i: i % 5 == 0, inner, 5)


def test_rings_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 32)
    df = data.vectors(spark, n=150)
    got = exact_topk.exact_top_k(df, F.col("vec_id") % 50 == 0, rings_most=2).collect()
    assert collections.Counter((r.query_id, r["rank"], r.vec_id, -r.score) for r in got) == brute(data.vector_rows(df), lambda i: i % 50 == 0, inner, 5)


def test_a_block_is_sent_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    blocks = spark.createDataFrame([(i, bytes([i])) for i in range(9)], "at long, data binary")
    asked = spark.createDataFrame([(i % 9 if i % 3 else 4, i) for i in range(500)] + [(77, 1)], "at long, n long")

    def work(b, q):
        assert len(q) <= 4096
        return q.assign(data=b["data"][0])[["n", "data"]]

    got = vectors.met(blocks, asked, "at", work, "n long, data long").collect()
    assert sorted((r.n, r.data) for r in got) == [(i, i % 9 if i % 3 else 4) for i in range(500)]


def test_regions_hold_what_is_near():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(600, 5)), np.repeat(rng.normal(size=(1, 5)), 300, axis=0)])
    top = vp_search.Regions(x[::2], 90_000)
    home = top.home(x)
    assert home.max() < top.count and top.count >= 8
    q = x[:40] + 0.01
    t = np.sort(vp_search.distances(q, x), axis=1)[:, 9]
    query, region = top.reached(q, t)
    have = set(zip(query.tolist(), region.tolist(), strict=True))
    near = np.argwhere(vp_search.distances(q, x) <= t[:, None])
    assert all((i, home[j]) in have for i, j in near.tolist())
    assert len(have) < 40 * top.count


def test_work_grows_with_the_rows(spark):
    """Clustered vectors: a query goes to the regions near it, however many there are."""
    rng = np.random.default_rng(8)
    sent = []
    for n in (2000, 8000):
        centres = rng.normal(size=(n // 250, 8)) * 20
        x = centres[np.arange(n) % len(centres)] + rng.normal(size=(n, 8)) * 0.1
        top = vp_search.Regions(x[:: max(1, n // 2000)], n * vp_search.SHARD // 250)
        t = np.sort(vp_search.distances(x[:100], x), axis=1)[:, 10]
        sent.append(len(top.reached(x[:100], t)[0]) / 100)
    assert sent[1] < 2 * sent[0] and sent[1] < 8
