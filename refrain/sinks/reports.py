"""Sinks: JSON and text summaries, and cut plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_time
from ..operators.intervals import keeps_from_removals

DONE, FAILED = "Completed", "Failed"
# The states of a file, in their order.
STATES = ("Discovered", "Probing", "Probed", "ExtractingFrames", "FramesExtracted", "ExtractingAudio", "AudioExtracted", "Analyzing", "Analyzed", "Detecting", "Cutting", "Completed", "Failed")


def state_flags(status: DataFrame) -> DataFrame:
    """FLT-12: terminal, failed, and the two sync points reached."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    at = lambda s: STATES.index(s) + 1
    ok = F.col("state") != FAILED
    return status.withColumns({"is_terminal": F.col("state").isin(DONE, FAILED), "is_failed": ~ok, "probed": ok & (place >= at("Probed")), "analyzed": ok & (place >= at("Analyzed"))})


def sync_counts(status: DataFrame) -> DataFrame:
    """AGG-11: files ready at each sync point, failed, and in all."""
    flags = state_flags(status)
    return flags.agg(*[F.count_if(c).alias(c) for c in ("probed", "analyzed", "is_failed", "is_terminal")], F.count("*").alias("total"))


def processing_summary(status: DataFrame) -> DataFrame:
    """SNK-7, AGG-16: completed, failed, longest time."""
    return status.agg(F.count_if(F.col("state") == DONE).alias("completed"), F.count_if(F.col("state") == FAILED).alias("failed"), F.max("elapsed").alias("max_elapsed"))


def text_summary(segments: DataFrame) -> DataFrame:
    """SNK-6: a line per segment; per-sequence times follow where they are half a second or more off."""
    head = F.concat(format_time(F.col("start_time")), F.lit(" - "), format_time(F.col("end_time")))
    shifted = F.filter("episode_timings", lambda t: F.abs(t["start_time"] - F.col("start_time")) >= 0.5)
    tail = F.array_join(F.transform(shifted, lambda t: F.concat(t["episode_name"], F.lit(" "), format_time(t["start_time"]), F.lit(" - "), format_time(t["end_time"]))), "; ")
    line = F.concat(head, F.lit(" ["), F.col("match_type"), F.lit("] "), F.array_join("episode_list", ", "), F.when(F.coalesce(F.size(shifted), F.lit(0)) > 0, F.concat(F.lit(" (shifted: "), tail, F.lit(")"))).otherwise(F.lit("")))
    return segments.select("start_time", line.alias("line")).orderBy("start_time")


def removable_seconds(segments: DataFrame) -> DataFrame:
    """AGG-14."""
    return segments.agg(F.coalesce(F.sum(F.col("end_time") - F.col("start_time")), F.lit(0.0)).alias("seconds"))


def json_summary(segments: DataFrame, status: DataFrame) -> DataFrame:
    """SNK-5: one row, ``summary``: schema_version 1; empty lists are left out, confidences stay as explicit nulls."""
    item = F.struct("start_time", "end_time", F.col("episode_list").alias("episodes"), "match_type", "confidence", "video_confidence", "audio_confidence", "episode_timings")
    as_json = F.to_json(item, {"ignoreNullFields": "false"})
    parts = segments.agg(F.array_join(F.array_sort(F.collect_list(F.struct("start_time", "end_time", as_json.alias("j"))))["j"], ",").alias("segments"))
    counts = processing_summary(status)
    failures = status.filter(F.col("state") == FAILED).agg(F.array_sort(F.collect_list("name")).alias("failures"))
    done = status.filter(F.col("state") == DONE).agg(F.array_sort(F.collect_list("name")).alias("completed_files"))
    # Three one-row tables.
    one = parts.join(counts).join(failures).join(done)
    optional = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(f',"{c}":'), F.to_json(c))).otherwise(F.lit(""))
    text = F.concat(F.lit('{"schema_version":1,"processing":'), F.to_json(F.struct("completed", "failed", "max_elapsed")), F.lit(',"segments":['), F.col("segments"), F.lit("]"), optional("failures"), optional("completed_files"), F.lit("}"))
    return one.select(text.alias("summary"))


def cut_plan(removals: DataFrame, episodes: DataFrame, coalesce: bool = True) -> DataFrame:
    """SNK-1..4, DET-X5: what to keep of each file: (episode_id, seg_no, action, start_time, end_time, arguments).

    A file without removals is copied; a file of which nothing is left is an "empty" row.
    """
    durations = episodes.select("episode_id", "duration")
    touched = removals.select("episode_id").distinct()
    keeps = keeps_from_removals(removals, durations.join(touched, "episode_id", "left_semi"), coalesce)
    numbered = keeps.withColumn("seg_no", F.row_number().over(Window.partitionBy("episode_id").orderBy("start_time")))
    cut = numbered.select("episode_id", "seg_no", F.lit("cut").alias("action"), "start_time", "end_time", F.format_string("-ss %.3f -to %.3f -c copy", "start_time", "end_time").alias("arguments"))
    whole = durations.join(touched, "episode_id", "left_anti").select("episode_id", F.lit(1).alias("seg_no"), F.lit("copy").alias("action"), F.lit(0.0).alias("start_time"), F.col("duration").alias("end_time"), F.lit("-c copy").alias("arguments"))
    gone = durations.join(touched, "episode_id", "left_semi").join(keeps.select("episode_id").distinct(), "episode_id", "left_anti")
    empty = gone.select("episode_id", F.lit(0).alias("seg_no"), F.lit("empty").alias("action"), F.lit(0.0).alias("start_time"), F.lit(0.0).alias("end_time"), F.lit("").alias("arguments"))
    return cut.unionByName(whole).unionByName(empty)
