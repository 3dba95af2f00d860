"""Times as text, and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_time(seconds: Column) -> Column:
    """S-29: "12.3s" under a minute, else "2:05.0"."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%d:%04.1f", minutes.cast("long"), seconds - minutes * 60))


def parse_time_token(token: Column) -> Column:
    """S-30: seconds of "12.5", "12.5s", "m:ss.d" or "h:m:s"; null for anything else."""
    parts = F.split(F.regexp_replace(F.trim(token), "s$", ""), ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return (
        F.when(F.size(parts) == 1, number(0))
        .when(F.size(parts) == 2, number(0) * 60 + number(1))
        .when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))
    )


def format_elapsed(seconds: Column) -> Column:
    """S-31: "[mm:ss]"."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("[%02d:%02d]", F.floor(whole / 60).cast("long"), whole % 60)


def estimated_frames(duration: Column, rate: float) -> Column:
    """S-33."""
    return (duration * rate).cast("long")


def spectral_frames(samples: Column, window: int, hop: int) -> Column:
    """S-34: windows that fit into so many samples."""
    return F.when(samples < window, F.lit(0).cast("long")).otherwise(F.floor((samples - window) / hop) + 1)


def interval_key(start: Column, end: Column) -> Column:
    """The agreement key "s.d-e.d"."""
    return F.format_string("%.1f-%.1f", start, end)


def match_rank(match_type: Column) -> Column:
    """S-35: audio+video before video before audio."""
    return F.when(match_type == "audio+video", 2).when(match_type == "video", 1).otherwise(0)


def match_name(rank: Column) -> Column:
    return F.when(rank == 2, "audio+video").when(rank == 1, "video").otherwise("audio")
