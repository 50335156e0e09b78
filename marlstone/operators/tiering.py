"""Storage-tier scoring and hot spots. ``as_of`` is always given; nothing reads a clock."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

HALF_LIFE_DAYS = 7.0


def age_seconds(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6


def access_scores(accesses: DataFrame, keys: Sequence[str], ts: str, as_of: Column) -> DataFrame:
    """(keys, accesses, last_age, frequency, recency): one partial aggregation (AGG-08, AGG-09, SCL-20)."""
    rows = accesses.select(*keys, age_seconds(F.col(ts), as_of).alias("age"))
    decayed = F.sum(F.exp(F.col("age") * (-math.log(2) / (HALF_LIFE_DAYS * 86_400))))
    out = rows.groupBy(*keys).agg(F.count("*").alias("accesses"), F.min("age").alias("last_age"), F.least(F.lit(100.0), decayed / 10).alias("frequency"))
    return out.withColumn("recency", scalars.recency_score(F.col("last_age")))


def hotness(frequency: Column, recency: Column, content: Column, size: Column, priority: Column) -> Column:
    """TIR-01."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.4 * frequency + 0.3 * recency + 0.1 * content - 0.1 * size + 0.1 * priority))


def scored(objects: DataFrame, accesses: DataFrame, keys: Sequence[str], ts: str, as_of: Column) -> DataFrame:
    """Objects (keys, size, content_type, priority, ...) with accesses, and their score and target tier (JON-10)."""
    both = objects.join(access_scores(accesses, keys, ts, as_of), list(keys))
    score = hotness(F.col("frequency"), F.col("recency"), scalars.content_score(F.col("content_type")), scalars.size_score(F.col("size")), F.col("priority").cast("double"))
    return both.withColumn("score", F.round(score, 6)).withColumn("target_tier", scalars.tier_of(F.col("score")))


def decisions(scored_objects: DataFrame) -> DataFrame:
    """Moves to be made: the target differs and the object is not pinned (TIR-03). The reason's score is the exact value to two places, a tie to the even digit, as
    printf has it (30.825 is 30.82, its nearest double being less; format_string rounds the decimal digits up)."""
    rows = scored_objects.where((F.col("target_tier") != F.col("tier")) & ~F.col("pinned"))
    return rows.withColumn("reason", F.concat(F.lit("score "), F.call_function("format_number", F.col("score"), F.lit("0.00")), F.lit(": "), "tier", F.lit(" to "), "target_tier"))


def trailing_counts(rows: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str = "in_window") -> DataFrame:
    """Each row with the number of rows of its key in the window of ``seconds`` that ends with it, its beginning excluded (WIN-05).

    A frame over a whole key would put a hot key into one task. Here time is cut into spans of the window's length, each
    row goes to its own span and, as history, to the next one, and frames run within a key's span."""
    micros = seconds * 1_000_000
    timed = rows.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    span = F.floor(F.col("__us") / micros).cast("long")
    dealt = timed.withColumn("__span", F.explode(F.array(span, span + 1)))
    frame = Window.partitionBy(*keys, "__span").orderBy("__us").rangeBetween(-(micros - 1), 0)
    counted = dealt.withColumn(name, F.count("*").over(frame))
    return counted.where(F.col("__span") == span).drop("__us", "__span")


def hotspots(accesses: DataFrame, keys: Sequence[str], ts: str, seconds: int = 600, baseline: float = 1.0, factor: float = 5.0, least: int = 10) -> DataFrame:
    """(keys, peak): keys whose trailing count exceeds both limits at some time (AGG-10, TIR-05)."""
    peaks = trailing_counts(accesses.select(*keys, ts), keys, ts, seconds).groupBy(*keys).agg(F.max("in_window").alias("peak"))
    return peaks.where((F.col("peak") > factor * baseline) & (F.col("peak") > least))
