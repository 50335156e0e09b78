"""Registered queries: scans, full-text search, vector search and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stem as stemmer
from ..functions import text as T
from ..functions import vectors as V
from ..operators import fts, hybrid, knn
from ..sources.tables import table
from .registry import query

STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = rf"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+'), lambda x: strlen(x) > 1 AND NOT list_contains([{STOPS}], x))"
TEXT_QUERY = "apache license, Version of the stupid"
TERMS = fts.query_stems(TEXT_QUERY)


def _first_suffix(table, least: int) -> str:
    """What becomes of w by the first suffix of the table that it ends in."""
    whens = []
    for suffix, other in table:
        root = f"substring(w, 1, length(w) - {len(suffix)})"
        sure = f"{_MEASURE.format(root)} > {least}" + (f" AND regexp_matches({root}, '[st]$')" if suffix == "ion" else "")
        whens.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {sure} THEN {root} || '{other}' ELSE w END")
    return "CASE " + " ".join(whens) + " ELSE w END"


_MEASURE = "len(regexp_extract_all({0}, '[aeiou]+[^aeiou]+'))"
_SHORT = "regexp_matches({0}, '[^aeiou][aeiou][0-9b-df-hj-np-tvz]$')"


def stem_sql(source: str, v: str = "v", out: str = "st") -> str:
    """Common table expressions, named by ``v``, that end in ``out`` (term, stem), for a query of the distinct terms."""
    return f"""{v}0 AS ({source}), {v}1 AS (SELECT term, CASE WHEN strlen(term) <= 2 THEN term WHEN ends_with(term, 'sses') OR ends_with(term, 'ies') THEN substring(term, 1, length(term) - 2)
 WHEN ends_with(term, 's') AND NOT ends_with(term, 'ss') THEN substring(term, 1, length(term) - 1) ELSE term END AS w FROM {v}0),
{v}2 AS (SELECT term, w, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') THEN substring(w, 1, length(w) - 2) WHEN ends_with(w, 'ing') THEN substring(w, 1, length(w) - 3) END AS r FROM {v}1),
{v}3 AS (SELECT term, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_MEASURE.format("substring(w, 1, length(w) - 3)")} > 0 THEN substring(w, 1, length(w) - 1) ELSE w END
 WHEN r IS NULL OR NOT regexp_matches(r, '[aeiou]') THEN w WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e'
 WHEN regexp_matches(r, '(?:{"|".join(c + c for c in "0123456789bcdfghjkmnpqrtvwxy")})$') THEN substring(r, 1, length(r) - 1)
 WHEN {_MEASURE.format("r")} = 1 AND {_SHORT.format("r")} THEN r || 'e' ELSE r END AS w FROM {v}2),
{v}4 AS (SELECT term, CASE WHEN ends_with(w, 'y') AND regexp_matches(substring(w, 1, length(w) - 1), '[aeiou]') THEN substring(w, 1, length(w) - 1) || 'i' ELSE w END AS w FROM {v}3),
{v}5 AS (SELECT term, {_first_suffix(stemmer.STEP_2, 0)} AS w FROM {v}4), {v}6 AS (SELECT term, {_first_suffix(stemmer.STEP_3, 0)} AS w FROM {v}5),
{v}7 AS (SELECT term, {_first_suffix([(x, "") for x in stemmer.STEP_4], 1)} AS w FROM {v}6),
{v}8 AS (SELECT term, substring(w, 1, length(w) - 1) AS r, w FROM {v}7),
{v}9 AS (SELECT term, CASE WHEN ends_with(w, 'e') AND ({_MEASURE.format("r")} > 1 OR ({_MEASURE.format("r")} = 1 AND NOT {_SHORT.format("r")})) THEN r ELSE w END AS w FROM {v}8),
{out} AS (SELECT term, CASE WHEN strlen(term) <= 2 THEN term WHEN ends_with(w, 'll') AND {_MEASURE.format("w")} > 1 THEN substring(w, 1, length(w) - 1) ELSE w END AS stem FROM {v}9)"""


_STEMS = stem_sql(f"SELECT DISTINCT unnest({TOKENS}) AS term FROM documents")


def bm25_sql(terms: list[str], keep: str = "") -> str:
    """Common table expressions up to h(doc_id, raw, score) of all matching documents; scores add up in the order of the terms."""
    listed = ", ".join(f"('{t}', {i})" for i, t in enumerate(terms))
    return f"""
WITH {_STEMS}, asked(stem, place) AS (VALUES {listed}), d AS (SELECT doc_id, {keep} {TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
p AS (SELECT doc_id, {keep} stem, place, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, {keep} unnest(t) AS term, len(t) AS dl FROM d) JOIN st USING (term) JOIN asked USING (stem) GROUP BY ALL),
f AS (SELECT stem, count(*) AS df FROM p GROUP BY stem),
h0 AS (SELECT doc_id, {keep} sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / a)) ORDER BY place) AS raw FROM p JOIN f USING (stem), s GROUP BY ALL),
h AS (SELECT *, round(raw, 6) AS score FROM h0)"""


def docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vecs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


# SRC-06, FLT-01, PRJ-01: pushed-down filters and a pruned projection.
@query("scan_documents_filter", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 2000")
def scan_documents_filter(spark, sf_dir):
    return docs(spark, sf_dir).where((F.col("lang") == "en") & (F.col("n_chars") > 2000)).select("doc_id", "source", "n_chars")


# SRC-02, OPT-01, OPT-02: an ordered prefix range with a limit.
@query("scan_prefix_limit", "SELECT url, page_id FROM pages WHERE starts_with(url, 'https://m.') ORDER BY url, page_id LIMIT 50")
def scan_prefix_limit(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("https://m.")).select("url", "page_id").orderBy("url", "page_id").limit(50)


# FTS-01, FTS-02, AGG-01.
@query(
    "fts_tokenize_counts",
    f"""WITH {_STEMS}, t AS (SELECT doc_id, {TOKENS} AS t FROM documents), u AS (SELECT doc_id, count(DISTINCT stem)::INT AS n_terms FROM (SELECT doc_id, unnest(t) AS term FROM t) JOIN st USING (term) GROUP BY doc_id)
SELECT doc_id, len(t)::INT AS n_tokens, coalesce(n_terms, 0)::INT AS n_terms FROM t LEFT JOIN u USING (doc_id)""",
)
def fts_tokenize_counts(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", fts.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


# FTS-03: the stemmer over the corpus's distinct tokens.
@query("fts_stems", f"WITH {_STEMS} SELECT term, stem FROM st")
def fts_stems(spark, sf_dir):
    tokens = docs(spark, sf_dir).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).distinct()
    return tokens.withColumn("stem", stemmer.stemmed("term"))


# AGG-02.
@query("fts_df", f"WITH {_STEMS} SELECT stem AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_distinct({TOKENS})) AS term FROM documents) JOIN st USING (term) GROUP BY stem")
def fts_df(spark, sf_dir):
    return fts.document_frequencies(docs(spark, sf_dir))


# AGG-03, FTS-09.
@query("fts_corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avg_length, sum(len(t))::BIGINT AS n_terms FROM (SELECT {TOKENS} AS t FROM documents)")
def fts_corpus_stats(spark, sf_dir):
    return fts.statistics(docs(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


# AGG-01, FTS-07: the index itself, with positions.
@query(
    "fts_postings",
    f"""WITH {_STEMS}, d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
p AS (SELECT doc_id, stem AS term, len(t)::INT AS dl, i FROM (SELECT doc_id, t, unnest(t) AS term, unnest(range(len(t))) AS i FROM d) JOIN st USING (term))
SELECT term, doc_id, count(*) AS tf, array_to_string(list(i ORDER BY i), ',') AS positions, any_value(dl) AS dl FROM p GROUP BY term, doc_id""",
)
def fts_postings(spark, sf_dir):
    p = fts.postings(docs(spark, sf_dir), ["doc_id"])
    return p.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ",")).select("term", "doc_id", "tf", "positions", "dl")


# FTS-04, FTS-05, JON-01, JON-02, AGG-06, TOP-01.
@query("fts_bm25_topk", bm25_sql(TERMS) + "SELECT doc_id, score FROM h ORDER BY raw DESC, doc_id LIMIT 20")
def fts_bm25_topk(spark, sf_dir):
    return fts.search(docs(spark, sf_dir), TEXT_QUERY)


# FTS-03, TOP-02: other forms of the words than the texts', and a k beyond the most.
@query("fts_bm25_stemmed_topk", bm25_sql(fts.query_stems("licenses applying versions generally")) + "SELECT doc_id, score FROM h ORDER BY raw DESC, doc_id LIMIT 100")
def fts_bm25_stemmed_topk(spark, sf_dir):
    return fts.search(docs(spark, sf_dir), "licenses applying versions generally", 500)


# JON-01, WIN-07: one ranking for each benchmark text.
@query(
    "fts_bm25_batch_topk",
    f"""
WITH {_STEMS}, {stem_sql(f"SELECT DISTINCT unnest({TOKENS}) AS term FROM benchmark", "b", "sq")},
d AS (SELECT doc_id, {TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT DISTINCT item_id, stem FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) JOIN sq USING (term)),
tf AS (SELECT doc_id, dl, stem, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) JOIN st USING (term) WHERE stem IN (SELECT stem FROM q) GROUP BY ALL),
f AS (SELECT stem, count(*) AS df FROM tf GROUP BY stem),
c AS (SELECT doc_id, tf.stem, ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS x FROM tf JOIN f USING (stem), s),
h AS (SELECT item_id, doc_id, sum(x ORDER BY stem) AS raw FROM q JOIN c USING (stem) GROUP BY ALL)
SELECT item_id, doc_id, round(raw, 6) AS score, (row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, doc_id))::INT AS rank FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, doc_id) <= 10""",
)
def fts_bm25_batch_topk(spark, sf_dir):
    return fts.search_many(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), 10, query_id="item_id", query_text="text")


# FLT-05, D4: the bucket's filter before ranking, with the corpus's statistics, or after it.
@query("fts_bucket_prefilter", bm25_sql(TERMS, keep="source,") + "SELECT doc_id, source, score FROM h WHERE source = 'src0' ORDER BY raw DESC, doc_id LIMIT 20")
def fts_bucket_prefilter(spark, sf_dir):
    return fts.search(docs(spark, sf_dir), TEXT_QUERY, keep=["source"], where=F.col("source") == "src0")


@query("fts_bucket_postfilter", bm25_sql(TERMS, keep="source,") + "SELECT * FROM (SELECT doc_id, source, score FROM h ORDER BY raw DESC, doc_id LIMIT 100) WHERE source = 'src0'")
def fts_bucket_postfilter(spark, sf_dir):
    return fts.search(docs(spark, sf_dir), TEXT_QUERY, 100, keep=["source"]).where(F.col("source") == "src0")


HIGHLIGHT = ["license", "version"]
_FIRST = "coalesce(least(nullif(instr(lower(text), 'licens'), 0), nullif(instr(lower(text), 'version'), 0)), 0)"
_START = f"greatest(0, CASE WHEN {_FIRST} > 0 THEN {_FIRST} - 51 ELSE 0 END)"


# FTS-12, PRJ-04.
@query(
    "fts_snippet",
    f"""SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE (CASE WHEN st > 0 THEN '...' ELSE '' END) || substring(text, st + 1, least(length(text), st + 100) - st)
 || (CASE WHEN least(length(text), st + 100) < length(text) THEN '...' ELSE '' END) END AS snippet FROM (SELECT doc_id, text, {_START}::INT AS st FROM documents)""",
)
def fts_snippet(spark, sf_dir):
    return fts.snippets(docs(spark, sf_dir), "licensing versions")


# FTS-13, FTS-14.
@query(
    "fts_highlight",
    r"""SELECT doc_id, len(f)::INT AS n_fragments, array_to_string(f, '|') AS fragments FROM (SELECT doc_id, regexp_extract_all(
 regexp_replace(regexp_replace(text, '(?i)(license)', '<em>\1</em>', 'g'), '(?i)(version)', '<em>\1</em>', 'g'), '(?s)<em>.*?</em>') AS f FROM documents)""",
)
def fts_highlight(spark, sf_dir):
    f = docs(spark, sf_dir).select("doc_id", T.fragments(T.highlight(F.col("text"), HIGHLIGHT)).alias("f"))
    return f.select("doc_id", F.size("f").alias("n_fragments"), F.array_join("f", "|").alias("fragments"))


# SET-04, FTS-08, D1: statistics after a delete are exact.
@query(
    "fts_delete_stats",
    f"""SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avg_length, sum(len(t))::BIGINT AS n_terms FROM
(SELECT {TOKENS} AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
)
def fts_delete_stats(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return fts.statistics(fts.delete(docs(spark, sf_dir), gone, ["doc_id"])).withColumn("avg_length", F.round("avg_length", 6))


def query_vector(spark, sf_dir: str) -> list[float]:
    """The vector with the least id: one row."""
    return vecs(spark, sf_dir).where("embedding IS NOT NULL").orderBy("vec_id").select("embedding").first()[0]


_E = "list_transform(embedding, lambda x: x::DOUBLE)"
_Q = f"v AS (SELECT vec_id, label, {_E} AS e FROM embeddings), q AS (SELECT e AS qe FROM v ORDER BY vec_id LIMIT 1)"
_NORM = "sqrt(list_dot_product({0}, {0}))"
_RAW = f"1 - list_dot_product(e, qe) / ({_NORM.format('e')} * {_NORM.format('qe')})"
_L2 = "list_sum(list_transform(list_zip(e, qe), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def knn_sql(keep: str = "", where: str = "true", k: int = 10, raw: str = _RAW, name: str = "n") -> str:
    """A common table expression of the k nearest rows: (vec_id, keep, raw, distance)."""
    return f"{name} AS (SELECT vec_id, {keep} {raw} AS raw, round({raw}, 6) + 0.0 AS distance FROM v, q WHERE {where} ORDER BY raw, vec_id LIMIT {k})"




# VEC-01 to VEC-05, TOP-03 to TOP-05, TOP-13.
@query("vec_knn_cosine", f"WITH {_Q}, {knn_sql()} SELECT vec_id, distance FROM n")
def vec_knn_cosine(spark, sf_dir):
    return knn.nearest(vecs(spark, sf_dir), query_vector(spark, sf_dir))


@query("vec_knn_l2", f"WITH {_Q}, {knn_sql(raw=_L2)} SELECT vec_id, distance FROM n")
def vec_knn_l2(spark, sf_dir):
    return knn.nearest(vecs(spark, sf_dir), query_vector(spark, sf_dir), metric="l2")


@query("vec_knn_dot", f"WITH {_Q}, {knn_sql(raw='1 - list_dot_product(e, qe)')} SELECT vec_id, distance FROM n")
def vec_knn_dot(spark, sf_dir):
    return knn.nearest(vecs(spark, sf_dir), query_vector(spark, sf_dir), metric="dot")


# FLT-01 to FLT-03, D5, OPT-05.
@query("vec_knn_filtered_pre", f"WITH {_Q}, {knn_sql('label,', 'label = 3')} SELECT vec_id, label, distance FROM n")
def vec_knn_filtered_pre(spark, sf_dir):
    from ..functions.predicates import all_equal, parse_equalities

    where = all_equal({"label": F.col("label")}, parse_equalities("label=3&broken"))
    return knn.nearest(vecs(spark, sf_dir), query_vector(spark, sf_dir), keep=["label"], where=where)


@query("vec_knn_filtered_post", f"WITH {_Q}, {knn_sql('label,', k=50)} SELECT vec_id, label, distance FROM n WHERE label = 3")
def vec_knn_filtered_post(spark, sf_dir):
    return knn.nearest(vecs(spark, sf_dir), query_vector(spark, sf_dir), 50, keep=["label"]).where("label = 3")


# FLT-04, D9.
@query("vec_threshold", f"WITH {_Q}, {knn_sql(where=f'1 - ({_RAW}) >= 0.2', k=100)} SELECT vec_id, distance FROM n")
def vec_threshold(spark, sf_dir):
    return knn.nearest(vecs(spark, sf_dir), query_vector(spark, sf_dir), 100, threshold=0.2)


# JON-14, WIN-07, VEC-06: the first vector of each label against all vectors.
@query(
    "vec_knn_join_batch",
    f"""WITH v AS (SELECT vec_id, label, {_E} AS e FROM embeddings), q AS (SELECT label::BIGINT AS query_id, arg_min(e, vec_id) AS qe FROM v GROUP BY label),
d AS (SELECT query_id, vec_id, {_RAW} AS raw FROM v, q)
SELECT query_id, vec_id, round(raw, 6) + 0.0 AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY raw, vec_id))::INT AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw, vec_id) <= 10""",
)
def vec_knn_join_batch(spark, sf_dir):
    asked = vecs(spark, sf_dir).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query")).select(F.col("label").cast("long").alias("query_id"), "query")
    return knn.nearest_many(vecs(spark, sf_dir), asked)


# OPT-09.
@query("vec_norms", f"SELECT vec_id, round({_NORM.format('e')}, 6) AS norm FROM (SELECT vec_id, {_E} AS e FROM embeddings)")
def vec_norms(spark, sf_dir):
    return vecs(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


# OPT-03, JON-03, JON-16, FLT-06: rank ids first, then fetch the text of permitted hits only.
@query(
    "vec_late_materialized",
    f"""WITH {_Q}, {knn_sql(name="h")}
SELECT vec_id, distance, source, n_chars FROM h LEFT JOIN documents ON doc_id = vec_id WHERE lang IN ('en', 'fr')""",
)
def vec_late_materialized(spark, sf_dir):
    hits = knn.nearest(vecs(spark, sf_dir), query_vector(spark, sf_dir))
    permitted = docs(spark, sf_dir).where(F.col("lang").isin("en", "fr")).select("doc_id", "source", "n_chars")
    return F.broadcast(hits).join(permitted, F.col("doc_id") == F.col("vec_id")).select("vec_id", "distance", "source", "n_chars")


def _vector_hits(spark, sf_dir, k=40):
    hits = knn.nearest(vecs(spark, sf_dir), query_vector(spark, sf_dir), k, rounded=False).select(F.col("vec_id").alias("doc_id"), "distance")
    return hybrid.rank_from_zero(hits, "distance", ["doc_id"], False, "vector_rank")


def _text_hits(spark, sf_dir, k=40):
    return hybrid.rank_from_zero(fts.search(docs(spark, sf_dir), TEXT_QUERY, k, rounded=False), "score", ["doc_id"], True, "text_rank")


_HYBRID = (
    bm25_sql(TERMS)
    + f""", {_Q}, tr AS (SELECT doc_id, (row_number() OVER (ORDER BY raw DESC, doc_id) - 1)::INT AS text_rank FROM h QUALIFY text_rank < 40), {knn_sql(k=40)},
vr AS (SELECT vec_id AS doc_id, (row_number() OVER (ORDER BY raw, vec_id) - 1)::INT AS vector_rank FROM n)"""
)


def _fused(a: float, b: float, constant: int) -> str:
    raw = f"coalesce({a}::DOUBLE / (text_rank + {constant + 1}), 0) + coalesce({b}::DOUBLE / (vector_rank + {constant + 1}), 0)"
    return _HYBRID + f"SELECT doc_id, text_rank, vector_rank, round(raw, 6) AS score FROM (SELECT doc_id, text_rank, vector_rank, {raw} AS raw FROM tr FULL JOIN vr USING (doc_id)) ORDER BY raw DESC, doc_id LIMIT 20"


# HYB-01, WIN-02, JON-04, AGG-07, TOP-06, D8.
@query("hyb_rrf", _fused(0.5, 0.5, 60))
def hyb_rrf(spark, sf_dir):
    return hybrid.fuse(_text_hits(spark, sf_dir), _vector_hits(spark, sf_dir), ["doc_id"])


@query("hyb_weighted", _fused(0.8, 0.2, 10))
def hyb_weighted(spark, sf_dir):
    return hybrid.fuse(_text_hits(spark, sf_dir), _vector_hits(spark, sf_dir), ["doc_id"], constant=10, weights=(0.8, 0.2))


# JON-05.
@query("hyb_vector_only", _HYBRID + "SELECT doc_id, vector_rank FROM vr WHERE doc_id NOT IN (SELECT doc_id FROM tr)")
def hyb_vector_only(spark, sf_dir):
    return _vector_hits(spark, sf_dir).join(_text_hits(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "vector_rank")
