"""Full-text operators over a table of documents. Terms are stems (FTS-01, FTS-03): every token that has a query token's stem matches it.

``postings`` and ``statistics`` are the index as tables (write them partitioned by a hash of the term for point lookups);
``search`` needs neither: the corpus's tokens with the stems of a query's few terms are listed first, then it counts those within each row, so the
corpus is scanned without any shuffle but that of the listed tokens, one row of statistics per task and the top-k merge. ``search_many`` counts and scores
all queries' terms batch by batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stem as stemmer
from ..functions import text as T

#: Queries that are served together; more take further passes.
QUERY_BLOCK = 4096
#: Cells of the matrix of documents by queries that a task fills at a time.
CELLS = 4_000_000


def clamp_k(k: int | None, default: int = 20, most: int = 100) -> int:
    """TOP-02: the default without a value, 1 at least, ``most`` at most."""
    return default if k is None else max(1, min(most, k))


def terms(text: Column, stop_words: Sequence[str] = T.STOP_WORDS) -> Column:
    """The stems of a text's tokens, in order (FTS-01)."""
    return stemmer.stemmed_lists(T.tokens(text, stop_words))


def query_stems(query: str, stop_words: Sequence[str] = T.STOP_WORDS) -> list[str]:
    """The distinct stems of a query string, in order of appearance."""
    return list(dict.fromkeys(stemmer.stem(t) for t in T.query_tokens(query, stop_words)))


def term_counts(docs: DataFrame, id_cols: Sequence[str], text_col: str = "text", stop_words: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """(ids, term, tf, positions): one row for each document and term (AGG-01)."""
    at = docs.select(*id_cols, F.posexplode(terms(F.col(text_col), stop_words)).alias("position", "term"))
    return at.groupBy(*id_cols, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def postings(docs: DataFrame, id_cols: Sequence[str], text_col: str = "text", stop_words: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """The inverted index: (term, ids, tf, positions, dl) (FTS-07)."""
    listed = docs.select(*id_cols, terms(F.col(text_col), stop_words).alias("__t"))
    at = listed.select(*id_cols, F.size("__t").alias("dl"), F.posexplode("__t").alias("position", "term"))
    return at.groupBy("term", *id_cols, "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions")).select(*id_cols, "term", "tf", "positions", "dl")


def document_frequencies(docs: DataFrame, text_col: str = "text", stop_words: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """(term, df) (AGG-02): distinct terms of a row first, so a row counts once and the sums start before the shuffle."""
    return docs.select(F.explode(F.array_distinct(terms(F.col(text_col), stop_words))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def statistics(docs: DataFrame, text_col: str = "text", stop_words: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """(n_docs, avg_length, n_terms) (AGG-03, FTS-09)."""
    return docs.select(T.token_count(F.col(text_col), stop_words).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_length"), F.sum("dl").alias("n_terms"))


def forms(docs: DataFrame, stems: Sequence[str], text_col: str = "text", stop_words: Sequence[str] = T.STOP_WORDS) -> dict[str, list[str]]:
    """The corpus's tokens that have each of the stems. A stem and its tokens share all but the stem's last two letters, so only tokens with such a start are stemmed.
    What comes to the driver are the endings that the stemmer's tables take off these stems: their number does not depend on the corpus."""
    if not stems:
        return {}
    starts = sorted({t[: max(1, len(t) - 2)] for t in stems})
    starts = [t for t in starts if not any(t != o and t.startswith(o) for o in starts)]
    found = docs.select(F.explode(T.tokens_like(F.col(text_col), starts)).alias("token")).distinct()
    found = found.where((F.octet_length("token") > 1) & ~F.col("token").isin(*stop_words) if stop_words else F.octet_length("token") > 1)
    found = found.withColumn("stem", stemmer.stemmed("token")).where(F.col("stem").isin(*stems))
    out: dict[str, list[str]] = {t: [] for t in stems}
    for r in found.collect():
        out[r["stem"]].append(r["token"])
    return out


def scored(docs: DataFrame, stems: Sequence[str], id_cols: Sequence[str], text_col: str = "text", keep: Sequence[str] = (), where: Column | None = None, stop_words: Sequence[str] = T.STOP_WORDS, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(ids, keep, score) of the documents with a term (FTS-05): any term may match and scores add up, in the order of the terms. N, df and average length are the
    whole corpus's; ``where`` limits what is returned. Lengths of documents without a term are computed once, for the average, and no tokens are listed."""
    text = F.col(text_col)
    known = forms(docs, stems, text_col, stop_words)
    tf = [T.term_count(text, known[t]) for t in stems]
    length = T.token_count(text, stop_words)
    # One row: the statistics, broadcast to the scan.
    stats = docs.select(length.alias("__dl"), *[c.alias(f"__tf{i}") for i, c in enumerate(tf)])
    stats = stats.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count(F.when(F.col(f"__tf{i}") > 0, 1)).alias(f"__df{i}") for i in range(len(stems))])
    hits = docs.where(reduce(or_, [c > 0 for c in tf])) if tf else docs.where(F.lit(False))
    hits = hits.where(where) if where is not None else hits
    hits = hits.select(*id_cols, *keep, length.alias("__dl"), *[c.alias(f"__tf{i}") for i, c in enumerate(tf)])
    score = sum((T.bm25(F.col(f"__tf{i}"), F.col(f"__df{i}"), F.col("__dl"), F.col("__n"), F.col("__avg"), k1, b) for i in range(len(stems))), F.lit(0.0))
    return hits.join(F.broadcast(stats)).select(*id_cols, *keep, score.alias("score"))


def search(docs: DataFrame, query: str, k: int | None = None, id_cols: Sequence[str] = ("doc_id",), rounded: bool = True, **options) -> DataFrame:
    """The k best documents for a query string, ties to the smaller id (FTS-05, TOP-01). They are ranked by the score itself, which the result gives to
    six places unless ``rounded`` is false."""
    stems = query_stems(query, options.get("stop_words", T.STOP_WORDS))
    best = scored(docs, stems, id_cols, **options).orderBy(F.desc("score"), *id_cols).limit(clamp_k(k))
    return best.withColumn("score", F.round("score", 6)) if rounded else best


def _counted(tokens: pa.Array, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term number, count) of the wanted stems in lists of tokens, by document and term number."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    at = pa.compute.index_in(stemmer._looked_up(tokens.flatten().cast(pa.string())), wanted)
    at = pa.compute.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)[at >= 0]
    code, n = np.unique(doc * max(1, len(wanted)) + at[at >= 0], return_counts=True)
    return code // max(1, len(wanted)), code % max(1, len(wanted)), n


def _frequency_batches(wanted: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(len(wanted), np.int64), 0, 0
        listed = pa.array(wanted, pa.string())
        for b in batches:
            _, term, _ = _counted(b.column(0), listed)
            df += np.bincount(term, minlength=len(wanted))
            n += b.num_rows
            length += pa.compute.sum(pa.compute.list_value_length(b.column(0))).as_py() or 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(wanted))), pa.array(np.concatenate([[n, length], df]))], ["term", "n"])

    return run


def _score_batches(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, offsets, members, ids, avg, k1, b1 = shared.value
        listed = pa.array(wanted, pa.string())
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                b = batch.slice(lo, step)
                doc, term, tf = _counted(b.column(1), listed)
                if not len(doc):
                    continue
                length = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                x = weights[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b1 + b1 * length[doc] / avg))
                # Each (document, term) meets the term's queries; sums run in the order of the terms.
                many = offsets[term + 1] - offsets[term]
                own = np.repeat(np.arange(len(doc)), many)
                query = members[np.repeat(offsets[term] - (np.cumsum(many) - many), many) + np.arange(len(own))]
                score = np.bincount(doc[own] * len(ids) + query, weights=x[own], minlength=b.num_rows * len(ids)).reshape(b.num_rows, len(ids)).T
                keys = b.column(0).to_numpy(zero_copy_only=False)
                line = np.broadcast_to(keys, score.shape)
                pick = np.lexsort((line, -score), axis=1)[:, :k]
                q, d = np.repeat(np.arange(len(ids)), pick.shape[1]), pick.ravel()
                s = score[q, d]
                hit = s > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[hit]]), pa.array(keys[d[hit]]), pa.array(s[hit])], ["q", "d", "s"])

    return run


def search_many(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents for each of many queries, whose ids are whole numbers.

    Two passes over the corpus for each block of QUERY_BLOCK queries: one counts documents and lengths and the documents with each asked term, in one row a task
    and term; the other scores every document for all queries of the block at once and keeps k a query and batch, so neither tokens nor (document, query)
    pairs are shuffled, however common a term is."""
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), T.tokens(F.col(text_col)).alias("t"))
    every = docs.select(T.tokens(F.col(text_col)).alias("t"))
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.array_distinct(terms(F.col(query_text))).alias("t")).orderBy("q")
    out, offset = None, 0
    while True:
        block = asked.offset(offset).limit(QUERY_BLOCK).collect()  # a bounded block
        if not block and out is not None:
            break
        wanted = sorted({t for r in block for t in r["t"]})
        number = {t: i for i, t in enumerate(wanted)}
        got = every.mapInArrow(_frequency_batches(wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        sums = dict.fromkeys(range(-2, len(wanted)), 0) | {r["term"]: r["n"] for r in got}
        n, avg = sums[-2], (sums[-1] / sums[-2] if sums[-2] else 0.0) or 1.0
        df = np.array([sums[i] for i in range(len(wanted))], np.float64)
        weights = np.where(df > 0, np.log((n - df + 0.5) / (df + 0.5) + 1), 0.0)
        pairs = sorted((number[t], j) for j, r in enumerate(block) for t in r["t"])
        members = np.array([j for _, j in pairs], np.int64)
        offsets = np.searchsorted(np.array([i for i, _ in pairs], np.int64), np.arange(len(wanted) + 1))
        shared = spark.sparkContext.broadcast((wanted, weights, offsets, members, np.array([r["q"] for r in block], np.int64), avg, k1, b))
        part = rows.mapInArrow(_score_batches(shared, k), "q long, d long, s double")
        out = part if out is None else out.union(part)
        offset += QUERY_BLOCK
        if len(block) < QUERY_BLOCK:
            break
    w = Window.partitionBy("q").orderBy(F.desc("s"), "d")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("d").alias(id_col), F.round("s", 6).alias("score"), "rank")


def snippets(docs: DataFrame, query: str, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text", size: int = 100) -> DataFrame:
    """(ids, snippet): FTS-12. The earliest place of any of the query's stems in each text."""
    return docs.select(*id_cols, T.snippet(F.col(text_col), query_stems(query), size).alias("snippet"))


def upsert(index_docs: DataFrame, new: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """New documents replace those of the same id (D3)."""
    return index_docs.join(new.select(*id_cols), list(id_cols), "left_anti").unionByName(new)


def delete(index_docs: DataFrame, gone: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """FTS-08, SET-04, D1: statistics are those of what is left."""
    return index_docs.join(gone.select(*id_cols), list(id_cols), "left_anti")
