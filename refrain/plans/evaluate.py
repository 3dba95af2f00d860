"""Evaluation against expected segments, and comparison of result sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import interval_key
from ..operators import folds, joins

METRICS = "precision double, recall double, f1_score double, timing_mean_abs_error_ms double, true_positives long, false_positives long, false_negatives long, segments_detected long"


def ratios(tp, fp, fn):
    """AGG-12: precision, recall and F1 columns; 0 where undefined."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score")


def score_lists(detected: list[folds.Segment], expected: list[tuple[float, float, int]]) -> tuple:
    """DET-X2 for one fixture: the METRICS row. Without expectations everything is right."""
    n = len(detected)
    if not expected:
        return (1.0, 1.0, 1.0, 0.0, 0, 0, 0, n)
    hits = sum(m is not None for m in folds.match_expected(detected, expected))
    fp, fn = n - hits, len(expected) - hits
    p, r = hits / n if n else 0.0, hits / len(expected)
    errors = [min((abs(d.start - s) + abs(d.end - e)) / 2 for s, e, _ in expected) for d in detected]
    return (p, r, 2 * p * r / (p + r) if p + r else 0.0, 1000 * sum(errors) / n if n else 0.0, hits, fp, fn, n)


def evaluate(segments: DataFrame, expected: DataFrame, key: str = "fixture") -> DataFrame:
    """DET-X2: a METRICS row per fixture of either table. ``expected``: key, start_time, end_time, min_episodes."""

    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = sorted((folds.to_segment(r) for r in left.to_dict("records")), key=lambda s: (-s.confidence, s.start, s.end))
        wanted = sorted(zip(right["start_time"], right["end_time"], right["min_episodes"], strict=True))
        return pd.DataFrame([(k[0], *score_lists(found, wanted))], columns=[key, *[c.split()[0] for c in METRICS.split(", ")]])

    # Columns of their own: both tables may come from one.
    wanted_rows = expected.select(*[F.col(c).alias(c) for c in (key, "start_time", "end_time", "min_episodes")])
    return segments.groupBy(key).cogroup(wanted_rows.groupBy(key)).applyInPandas(run, f"{key} {segments.schema[key].dataType.simpleString()}, {METRICS}")


def timing_error(detected: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """JN-17: per key the mean, over detections, of the least mean boundary error, in ms."""
    e = expected.select(key, F.col("start_time").alias("s2"), F.col("end_time").alias("e2"))
    pairs = detected.withColumn("row", F.monotonically_increasing_id()).join(e, key)
    error = (F.abs(F.col("start_time") - F.col("s2")) + F.abs(F.col("end_time") - F.col("e2"))) / 2
    return pairs.groupBy(key, "row").agg(F.min(error).alias("error")).groupBy(key).agg((F.avg("error") * 1000).alias("timing_ms"), F.count("*").alias("n"))


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """DET-X4, AGG-13: counts and mean confidences of the segments that both results have, and of each side's own."""
    keyed = [x.withColumn("key", interval_key(F.col("start_time"), F.col("end_time"))) for x in (a, b)]
    parts = joins.agreement(*keyed, ["key"])
    out = None
    for name, part in parts.items():
        row = part.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
        out = row if out is None else out.unionByName(row)
    return out


def compare_algorithms(results: dict[str, DataFrame], expected: DataFrame, failed: dict[str, str] | None = None) -> DataFrame:
    """DET-X3: a METRICS row per algorithm; a failed one has zeros and its error. ``results``: with a ``fixture`` column."""
    spark = expected.sparkSession
    out = None
    for name, segments in results.items():
        row = evaluate(segments, expected).select(F.lit(name).alias("algorithm"), "*", F.lit(None).cast("string").alias("error"))
        out = row if out is None else out.unionByName(row)
    for name, error in (failed or {}).items():
        zero = spark.createDataFrame([(name, None, 0.0, 0.0, 0.0, 0.0, 0, 0, 0, 0, error)], f"algorithm string, fixture string, {METRICS}, error string")
        out = zero if out is None else out.unionByName(zero)
    return out


def leaders(report: DataFrame, seconds: str | None = None) -> DataFrame:
    """AGG-15: the algorithms with the best F1 (the last of equals by name), the best timing and, if measured, the least time (the first of equals)."""
    picks = [F.max_by("algorithm", F.struct("f1_score", "algorithm")).alias("best_f1"), F.min_by("algorithm", F.struct("timing_mean_abs_error_ms", "algorithm")).alias("best_timing")]
    if seconds:
        picks.append(F.min_by("algorithm", F.struct(seconds, "algorithm")).alias("fastest"))
    return report.filter("error is null").agg(*picks)
