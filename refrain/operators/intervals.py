"""Interval algebra on (episode_id, start_time, end_time) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_start(key: str) -> Window:
    return Window.partitionBy(key).orderBy("start_time", "end_time")


def merge_islands(intervals: DataFrame, gap: float = 2.0, key: str = "episode_id") -> DataFrame:
    """INT-1: per sequence, intervals at most ``gap`` apart become one; ``n`` counts its parts, ``confidence`` is their mean where there is one."""
    order = _by_start(key)
    before = F.max("end_time").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start_time") - before > gap), 1).otherwise(0)
    numbered = intervals.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    extra = [F.avg("confidence").alias("confidence")] if "confidence" in intervals.columns else []
    return numbered.groupBy(key, "island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("n"), *extra)


def keeps_from_removals(removals: DataFrame, durations: DataFrame, coalesce: bool = True, key: str = "episode_id") -> DataFrame:
    """INT-7: what is left of [0, duration] of each sequence in ``durations`` (key, duration).

    ``coalesce=False`` keeps the historical behaviour: the cursor follows the last removal's
    end, even backwards.
    """
    rows = merge_islands(removals, 0.0, key).select(key, "start_time", "end_time") if coalesce else removals.select(key, "start_time", "end_time")
    rows = rows.join(durations, key)
    ends = durations.select(key, F.col("duration").alias("start_time"), F.lit(None).cast("double").alias("end_time"), "duration")
    order = Window.partitionBy(key).orderBy(F.col("end_time").isNull(), "start_time", "end_time")
    keeps = rows.unionByName(ends).withColumn("keep_start", F.lag("end_time", 1, 0.0).over(order))
    keeps = keeps.select(key, F.col("keep_start").alias("start_time"), F.least("start_time", "duration").alias("end_time"))
    return keeps.filter(F.col("start_time") < F.col("end_time"))


def removals_from_keeps(keeps: DataFrame, durations: DataFrame, key: str = "episode_id") -> DataFrame:
    """INT-8: keeps clamped to [0, duration], coalesced and complemented; a sequence without keeps is removed whole."""
    clamped = keeps.join(durations.filter("duration > 0"), key).select(key, F.greatest("start_time", F.lit(0.0)).alias("start_time"), F.least("end_time", "duration").alias("end_time"))
    return keeps_from_removals(clamped.filter(F.col("start_time") < F.col("end_time")), durations.filter("duration > 0"), True, key)


def first_and_last(segments: DataFrame, key: str = "episode_id") -> DataFrame:
    """INT-9: the first and the last segment of each sequence."""
    up, down = _by_start(key), Window.partitionBy(key).orderBy(F.desc("start_time"), F.desc("end_time"))
    return segments.withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)}).filter("a = 1 or b = 1").drop("a", "b")


def trim_openings_and_endings(regions: DataFrame) -> DataFrame:
    """FLT-6, INT-11: regions of 20 seconds or more; long openings end after 90 s, endings are cut to 70 s or, under 40 s, dropped."""
    s, e = F.col("start_time"), F.col("end_time")
    d = e - s
    opening = (s < 30) & (e < 500) & (d > 90)
    cut = regions.filter(d >= 20).withColumns({"d": d, "end2": F.when(opening, s + 90).otherwise(e)})
    ending = (s > 1300) & (F.col("end2") > 1400)
    cut = cut.withColumn("start2", F.when(ending & (F.col("d") > 70), F.col("end2") - 70).otherwise(s)).filter(~(ending & (F.col("d") < 40)))
    kept = [c for c in regions.columns if c not in ("start_time", "end_time")]
    return cut.select(*kept, F.col("start2").alias("start_time"), F.col("end2").alias("end_time")).filter("end_time > start_time")


def drop_overlong(segments: DataFrame, most: float = 240.0) -> DataFrame:
    """FLT-5."""
    return segments.filter(F.col("end_time") - F.col("start_time") <= most)


def refine_boundaries(segments: DataFrame, min_duration: float) -> DataFrame:
    """S-32: segments of 1.5 times the least duration lose a little at both ends."""
    d = F.col("end_time") - F.col("start_time")
    trim = F.when(d >= 1.5 * min_duration, F.least(F.least(0.2 * d, F.lit(10.0)), F.lit(2.0))).otherwise(F.lit(0.0))
    return segments.withColumn("trim", trim).withColumns({"start_time": F.col("start_time") + F.col("trim"), "end_time": F.col("end_time") - F.col("trim")}).drop("trim")
