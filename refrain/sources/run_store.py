"""Run history: two append-only tables, accuracy_run and accuracy_fixture_result."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = "id long, created_at string, git_revision string, label string, similarity_algorithm string, audio_algorithm string, notes string"
RESULT = "id long, run_id long, fixture_path string, precision double, recall double, f1_score double, timing_mean_abs_error_ms double, true_positives long, false_positives long, false_negatives long, segments_detected long"


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "accuracy_run", RUN)


def results(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "accuracy_fixture_result", RESULT)


def record_run(spark: SparkSession, folder: str, metrics: DataFrame, **about: str | None) -> int:
    """SNK-8: append one run and its per-fixture metrics (fixture_path and METRICS columns); one result per fixture. Returns the run's id."""
    run_id = (runs(spark, folder).agg(F.max("id")).first()[0] or 0) + 1
    base = results(spark, folder).agg(F.max("id")).first()[0] or 0
    order = Window.partitionBy(F.lit(run_id)).orderBy("fixture_path")  # one row a fixture
    rows = metrics.dropDuplicates(["fixture_path"]).withColumns({"id": F.row_number().over(order).cast("long") + base, "run_id": F.lit(run_id).cast("long")})
    names = [c.split()[0] for c in RESULT.split(", ")]
    rows.select(*names).write.mode("append").parquet(f"{folder}/accuracy_fixture_result")
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = ("git_revision", "label", "similarity_algorithm", "audio_algorithm", "notes")
    head = spark.range(1).select(F.lit(run_id).cast("long").alias("id"), stamp.alias("created_at"), *[F.lit(about.get(c)).cast("string").alias(c) for c in fields])
    head.write.mode("append").parquet(f"{folder}/accuracy_run")
    return run_id


def list_runs(run: DataFrame, limit: int = 20) -> DataFrame:
    """SRT-7: the latest runs."""
    return run.orderBy(F.desc("id")).limit(limit)


def joined(result: DataFrame, run: DataFrame) -> DataFrame:
    """JN-19: results with their run's columns."""
    return result.join(run.withColumnRenamed("id", "run_id"), "run_id")


def last_two(result: DataFrame, value: str = "f1_score", key: str = "fixture_path", order: str = "run_id") -> DataFrame:
    """SRT-8: the older and the newer of each fixture's last two values; fixtures with one are left out."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = result.withColumn("place", place).filter("place <= 2")
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(F.when(F.col("place") == 2, F.col(value))).alias("older"), F.max(F.when(F.col("place") == 1, F.col(value))).alias("newer"))
    return out.filter("n = 2").drop("n")


def latest(result: DataFrame, value: str = "f1_score", key: str = "fixture_path", order: str = "run_id") -> DataFrame:
    """SRT-9: each fixture's value of its latest run."""
    return result.groupBy(key).agg(F.max_by(value, order).alias("latest"), F.max(order).alias("latest_run"))
