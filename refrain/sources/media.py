"""Directory scans and fixture documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_time_token

# The file extensions of the scan.
EXTENSIONS = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm")


def discover_videos(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """SRC-1, SRC-2: (path, name, length) of video files in the order of their lower-cased names; folders called "truncated" are left out when recursive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = files.withColumn("name", name).filter(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*EXTENSIONS))
    if recursive:
        found = found.filter(~F.lower("path").contains("/truncated/"))
    return found.orderBy(F.lower("name"), "path")


def fixture_segments(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: expected segments of ``segments.json`` documents; times may be numbers or text tokens."""
    schema = "test_name string, files array<string>, expected_segments array<struct<segment_id:string,start_time:string,end_time:string,files:array<string>,match_type:string>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    rows = docs.select(F.col("d.test_name").alias("fixture"), F.explode("d.expected_segments").alias("s"))
    return rows.select(
        "fixture",
        F.col("s.segment_id").alias("segment_id"),
        parse_time_token(F.col("s.start_time")).alias("start_time"),
        parse_time_token(F.col("s.end_time")).alias("end_time"),
        F.size("s.files").alias("min_episodes"),
        F.coalesce("s.match_type", F.lit("video")).alias("match_type"),
    )


def validate_fixtures(segments: DataFrame) -> DataFrame:
    """Rows that break the fixture contract, with the reason."""
    reason = (
        F.when(F.coalesce(F.length("fixture"), F.lit(0)) == 0, "no test name")
        .when(F.col("start_time").isNull() | F.col("end_time").isNull(), "a time can't be read")
        .when(F.col("end_time") < F.col("start_time"), "it ends before it starts")
        .when(F.col("min_episodes") < 1, "no files")
    )
    return segments.withColumn("reason", reason).filter("reason is not null")
