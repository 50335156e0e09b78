"""Operator 7: quality classifier by ordinal cumulative-link regression on graded ratings.

A rated document's grade is its quality (0 or 1) plus one if it is not toxic: 0, 1 or 2. The model has one weight per
hashed text feature, shared by all grades, and ordered thresholds: P(grade >= k) is the logistic function of (weights x
features - threshold k). It gives a document's expected grade and its tail probabilities; documents whose
probability of the top grade is at least ``keep_at`` are selected.

Features are sets: hashed lower-case words without the punctuation around them, and a few shapes of the whole text
(shares of words with symbols in them, of bare symbols, of the commonest word, of words said
twice in a row, of distinct words), each in steps. Fitting takes a bounded sample of the rated documents (``SAMPLE`` ratings, those least
by a hash of their id); its feature numbers, not its texts, come to the driver. Every bucket of at least ``MIN_DOCS`` sampled documents that tells the
grades on the two sides of any threshold apart, by a chi-square of ``MIN_CHI2`` or more, gets a weight, however many those are; with
``min_docs`` 1 and ``min_chi2`` 0 every bucket of the sample does. The model is one number a bucket, whatever the data. Scoring reads every document whole and has no
sample.

Defined results: null and empty texts have no features and get the thresholds' own probabilities; ratings with a null are not used;
a document rated twice counts once for each of its grades, and of documents that share a rated id the one with the least features counts; without any rating
every document has the top grade, and with a single grade the thresholds are smoothed shares of the grades; repeated rows give repeated rows; other
columns are ignored or, by ``selected``, kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from . import common

#: Rated documents that the fit reads at most.
SAMPLE = 12_000
BUCKETS = 1 << 18
GRADES = 3
MIN_DOCS, MIN_CHI2 = 6, 20.0
KEEP_AT = 0.5

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGE = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_STEPS = (0.002, 0.01, 0.03, 0.1, 0.2, 0.35, 0.6)


def _bucket(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature, 11) % BUCKETS


def _word_kind(word: bytes) -> tuple[int, int]:
    """(bucket, kind): 0 a plain word, 1 a word with two symbols or more in a row at its edge, 2 no word at all."""
    core = word.strip(_EDGE)
    if not core:
        return -1, 2
    return _bucket(core), int(len(word) - len(core) >= 3)


_words = common.WordMemo(lambda words: {w: _word_kind(w) for w in words}, 100_000, "quality")


def features(text: bytes | None) -> list[int]:
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return []
    counts = Counter(words)
    known = _words.table(list(counts))
    out = set()
    kinds = [0, 0, 0]
    for w, n in counts.items():
        b, kind = known[w]
        kinds[kind] += n
        if b >= 0:
            out.add(b)
    n = len(words)
    top = counts.most_common(1)[0][1] if n >= 20 else 0
    twice = sum(map(eq, words, islice(words, 1, None))) if n >= 4 else 0
    shares = (("symbols", kinds[1] / n), ("bare", kinds[2] / n), ("top", top / n), ("twice", twice / n), ("same", 1 - len(counts) / n if 20 <= n <= 400 else 0.0))
    for name, x in shares:
        for step in _STEPS:
            if x >= step:
                out.add(_bucket(f"\0{name}>{step}".encode()))
    return sorted(out)


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, GRADES - 1

    def tails(self, found: list[int]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        x = 0.0
        if found and len(self.buckets):
            f = np.array(found)
            at = np.minimum(np.searchsorted(self.buckets, f), len(self.buckets) - 1)
            x = float(self.weights[at[self.buckets[at] == f]].sum())
        return 1 / (1 + np.exp(np.clip(self.thresholds - x, -500, 500)))


def telling(y: np.ndarray, owner: np.ndarray, flat: np.ndarray, min_docs: int, min_chi2: float) -> np.ndarray:
    """The buckets that get weights; ``owner`` is the row of each feature in ``flat``."""
    n = len(y)
    docs = np.bincount(flat, minlength=BUCKETS).astype(float)
    best = np.zeros(BUCKETS)
    for k in range(1, GRADES):
        above = y >= k
        share = above.mean()
        expected = docs * share
        spread = expected * (1 - share) * np.maximum(1 - docs / n, 1e-9)
        off = np.bincount(flat[above[owner]], minlength=BUCKETS) - expected
        best = np.maximum(best, np.where(spread > 0, off**2 / np.maximum(spread, 1e-9), 0))
    return np.flatnonzero((docs >= max(1, min_docs)) & (best >= min_chi2))


def fit(rows: list[tuple[int, list[int]]], **options) -> Model:
    """The model of (grade, features) rows."""
    flat = np.concatenate([np.array(f, np.int64) for _, f in rows if f] or [np.zeros(0, np.int64)])
    return fit_arrays(np.array([g for g, _ in rows], np.int64), np.array([len(f) for _, f in rows], np.int64), flat, **options)


def fit_arrays(y: np.ndarray, lengths: np.ndarray, flat: np.ndarray, rounds: int = 400, ridge: float = 0.004, min_docs: int = MIN_DOCS, min_chi2: float = MIN_CHI2) -> Model:
    """Penalized maximum likelihood by full-batch Adam, the same for the same rows; ``flat`` holds the rows' features one after the other."""
    if not len(y):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, -50.0))
    shares = (np.bincount(y, minlength=GRADES) + 1.0) / (len(y) + GRADES)
    below = np.clip(np.cumsum(shares)[:-1], 1e-6, 1 - 1e-6)
    start = np.log(below / (1 - below))
    if len(np.unique(y)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), start)
    owner = np.repeat(np.arange(len(y)), lengths)
    n = len(y)
    chosen = telling(y, owner, flat, min_docs, min_chi2)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    ok = place[flat] >= 0
    row, col = owner[ok], place[flat[ok]]  # the places of the ones in the sparse matrix of rows by weights
    # Parameters: weights, the first threshold and the logarithms of the steps to the next ones.
    p = np.concatenate([np.zeros(len(chosen)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = len(chosen)
    for i in range(1, rounds + 1):
        steps = np.exp(p[k + 1 :])
        theta = np.concatenate([[-np.inf], np.cumsum(np.concatenate([p[k : k + 1], steps])), [np.inf]])
        score = np.bincount(row, weights=p[col], minlength=n)
        upper, lower = (1 / (1 + np.exp(np.clip(score - theta[y + d], -500, 500))) for d in (1, 0))
        prob = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / prob, lower * (1 - lower) / prob
        grad_score = du - dl  # of the negative log likelihood
        grad_theta = np.array([(-du[y == j].sum() + dl[y == j + 1].sum()) for j in range(GRADES - 1)])
        tail = np.cumsum(grad_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(col, weights=grad_score[row], minlength=k) + ridge * n * 0.01 * p[:k], tail[:1], tail[1:] * steps]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Model(chosen, p[:k], np.cumsum(np.concatenate([p[k : k + 1], np.exp(p[k + 1 :])])))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(x.as_py()) for x in b.column(2)], pa.list_(pa.int32()))], ["r_id", "grade", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, **options) -> Model:
    """The model of the sampled ratings; at most ``sample`` rows of features come to the driver."""
    common.bound_batches(docs.sparkSession)
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    rated = rated.select(F.col("doc_id").cast("long").alias("r_id"), (F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")).alias("grade")).where(F.col("grade").between(0, GRADES - 1))
    rated = rated.distinct().orderBy(F.xxhash64("r_id"), "r_id", "grade").limit(sample)  # the bound of what is broadcast and collected
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(rated), F.col("doc_id") == F.col("r_id"))
    rows = rows.select("r_id", "grade", "text").mapInArrow(_feature_batches, "r_id long, grade int, features array<int>")
    rows = rows.groupBy("r_id", "grade").agg(F.min("features").alias("features"))
    got = rows.toArrow().sort_by([("r_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    found = got.column("features").combine_chunks()
    lengths = pa.compute.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    return fit_arrays(got.column("grade").to_numpy().astype(np.int64), lengths, found.flatten().to_numpy().astype(np.int64), **options)


def _score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = np.array([model.value.tails(features(x.as_py())) for x in b.column(1)]).reshape(-1, GRADES - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0].copy()), pa.array(tails[:, 1].copy())], ["doc_id", "expected_grade", "p_ge_1", "p_ge_2"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_ge_1, p_ge_2) for every row. The model is broadcast: at most a number and a place for each of BUCKETS."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_score_batches(shared), "doc_id long, expected_grade double, p_ge_1 double, p_ge_2 double")


def _select_batches(model, at: int, keep_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(model.value.tails(features((x.as_py() or "").encode()))[-1] >= keep_at) for x in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def selected(docs: DataFrame, model: Model, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows, with all their columns, whose probability of the top grade is at least ``keep_at``."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_select_batches(shared, docs.columns.index(text_col), keep_at), docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("keep", F.col("p_ge_2") >= KEEP_AT)
