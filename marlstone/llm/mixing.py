"""Operator 9: mixing sources to target weights by capped water-filling.

``water_fill`` gives each source a number of words: its share of the wished total by weight,
clamped at ``max_epochs`` times what the source has; what a clamped source cannot take is dealt
to the others by weight until no source is above its clamp. The level is found in closed form:
with sources in the order of ``max_epochs * size / weight``, a source is clamped exactly if its
ratio is at most the level that the sources from it onwards would get.

``mix`` then samples: every document of a source is taken ``floor(target / size)`` whole times,
and a seeded order of the source's documents (by md5 of seed and id) decides which documents
get one repetition more; the last of them gets the fraction that is left, so each source's taken
words equal its target up to rounding. The order's running sums are made in two levels (sums of
hash ranges, then sums within a range), so no task ever holds a whole source.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a
document of size 0 takes 0 words; an empty table gives no rows; repeated rows are sampled as
documents of their own (among equal ids the longer first); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from . import common

#: Documents of a source that one hash range holds on average.
RANGE_ROWS = 2_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [0 if t is None else len(t.split()) for t in (x.as_py() for x in b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): size counts the runs without ASCII white space of the whole text."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count_words, "doc_id long, source string, size long")


def water_fill(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), total: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, n_docs, target) of (source, size) rows. One row per source: the windows here run over
    the aggregated sources, not over documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    per = per.withColumns(
        {
            "want": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total)),
            "weight_from": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
            "caps_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    per = per.withColumn("share", F.col("weight") * (F.col("want") - F.col("caps_before")) / F.col("weight_from"))
    per = per.withColumn("clamped", F.col("cap") <= F.col("share"))
    free = F.when(~F.col("clamped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "want", "caps_before", "weight_from"))
    per = per.withColumn("level", F.min(free).over(Window.partitionBy()))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("level.want") - F.col("level.caps_before")) / F.col("level.weight_from"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (3, 1, 2), total: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, part): ``taken = copies * size + part`` words."""
    spark = docs.sparkSession
    sized = word_sizes(docs, id_col, text_col, source_col)
    sized, _ = common.written(sized.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))))
    # The number of hash ranges follows the table, so a range stays small in the largest source too.
    bits = max(0, (sized.count() // RANGE_ROWS).bit_length())
    prefix = F.substring("key", 1, (bits + 3) // 4) if bits else F.lit("")
    sized = sized.withColumn("range", prefix)
    per = water_fill(sized, weights, total, max_epochs)
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    plan = (
        ranges.alias("r")
        .join(per.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
        .select(F.col("r.source").alias("p_source"), F.col("r.range").alias("p_range"), "before", "source_size", "target")
    )
    within = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.withColumn("upto", F.sum("size").over(within))
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("copies", copies)
    quota = F.round(F.col("target")).cast("long") - F.col("copies") * F.col("source_size")
    left = quota - (F.col("before") + F.col("upto") - F.col("size"))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    whole = (F.col("part") == F.col("size")) & (F.col("size") > 0)
    return rows.select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size") + F.col("part")).alias("taken"),
        (F.col("copies") + whole.cast("long")).alias("copies"),
        F.when(whole, 0).otherwise(F.col("part")).cast("long").alias("part"),
        "source",
    )


def _repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (text, ..., plan, nth): the whole text as often as the plan says for the nth of its equal rows, then its first words."""
    for b in batches:
        names = b.schema.names
        plans, nth = b.column(names.index("__plan")), b.column(names.index("__nth"))
        own = [i for i, n in enumerate(names) if n not in ("__plan", "__nth")]
        at = names.index("text")
        take, texts = [], []
        for i, (plan, k, t) in enumerate(zip(plans.to_pylist(), nth.to_pylist(), b.column(at).to_pylist(), strict=True)):
            copies = part = 0
            for step in plan:
                copies, part = step["copies"], step["part"]
                k -= step["n"]
                if k <= 0:
                    break
            for _ in range(copies):
                take.append(i)
                texts.append(t)
            if part:
                take.append(i)
                texts.append(b" ".join(t.encode().split(None, part)[:part]).decode())
        cols = [pa.array(texts, pa.string()) if i == at else b.column(i).take(pa.array(take, pa.int64())) for i in own]
        out = pa.RecordBatch.from_arrays(cols, [names[i] for i in own])
        for j in range(0, out.num_rows, 2_000):
            yield out.slice(j, 2_000)


def _key(i: str, source: str, size: str) -> dict:
    """What a row is found by, without nulls."""
    return {
        "__k1": F.coalesce(F.col(i).cast("long"), F.lit(0)), "__k2": F.col(i).isNull(), "__k3": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "__k4": F.col(source).isNull(), "__k5": F.col(size),
    }


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents as the mix takes them, with their own columns: one row per repetition. Rows of one id, source and size share out what the mix takes of
    them, in the order of a hash of their texts, so their words are those of ``mix`` however many rows are equal. A document of no words, and a null or
    empty text with it, is left out, since the mix takes none of it; an empty table gives no rows."""
    cols, keys = docs.columns, ["__k1", "__k2", "__k3", "__k4", "__k5"]
    # Whatever the number of equal rows, a source takes them whole, one of them in part and the others one time less: three entries at most.
    plan = mix(docs, **params).withColumns(_key("doc_id", "source", "size")).groupBy(*keys, "copies", "part").agg(F.count("*").alias("n"))
    plan = plan.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("copies", "part", "n")), asc=False).alias("__plan")).where("__plan[0].copies > 0 OR __plan[0].part > 0")
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")
    rows = docs.withColumn("__w", words).withColumns(_key("doc_id", "source", "__w")).drop("__w")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text")))
    joined = rows.withColumn("__nth", nth).join(plan, keys)
    return joined.select(*[F.col(f"`{c}`") for c in cols], "__plan", "__nth").mapInArrow(_repeat, docs.schema)


def op9_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS want FROM s),
f AS (SELECT *, sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weight_from,
  coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps_before FROM w),
c AS (SELECT *, cap <= weight * (want - caps_before) / weight_from AS clamped FROM f),
l AS (SELECT want - caps_before AS rest, weight_from AS per FROM c WHERE NOT clamped ORDER BY cap::DOUBLE / weight, rank LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE weight * (SELECT rest FROM l) / (SELECT per FROM l) END AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS copies,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - copies * source_size - before))::BIGINT AS part FROM r)
SELECT doc_id, size, source_size, target, (copies * size + part)::BIGINT AS taken, (copies + CASE WHEN part = size AND size > 0 THEN 1 ELSE 0 END)::BIGINT AS copies,
  CASE WHEN part = size AND size > 0 THEN 0 ELSE part END::BIGINT AS part FROM p
"""
