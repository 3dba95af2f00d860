"""Sequence views: any table as (episode_id, frame_idx, ts, hash) rows, and its relatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import sign_bits, text_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a sequence of its non-blank lines, one a second."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("ls"))
    lines = docs.select("episode_id", F.posexplode("ls").alias("frame_idx", "line"))
    return lines.select("episode_id", "frame_idx", F.col("frame_idx").cast("double").alias("ts"), text_hash(F.col("line")).alias("hash"))


def emb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors in id order; the hash is the vector's sign bits."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("frame_idx", F.row_number().over(order) - 1)
    return rows.select(F.col("label").alias("episode_id"), "frame_idx", F.col("frame_idx").cast("double").alias("ts"), sign_bits(F.col("embedding")).alias("hash"), "embedding", "vec_id")


def evt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time order; the hash is the event type's."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("frame_idx", F.row_number().over(order) - 1)
    return rows.select(F.col("user_id").alias("episode_id"), "frame_idx", (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1e6).alias("ts"), text_hash(F.col("event_type")).alias("hash"), "value")


def conv_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns, one a second."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("frame_idx"), F.col("turn").cast("double").alias("ts"), text_hash(F.col("text")).alias("hash"))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as intervals [line number, + quantity]."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("episode_id"),
        F.col("l_linenumber").cast("double").alias("start_time"),
        (F.col("l_linenumber") + F.col("l_quantity")).alias("end_time"),
        F.col("l_discount").alias("confidence"),
    )
