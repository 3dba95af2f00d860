"""Token counts by a digest cache.

The cache is a Parquet table (version, digest, n_tokens) that only grows. ``version``
names the tokenizer file and library, ``digest`` the normalised content. Documents are
joined to it by digest; each distinct text that it lacks is encoded once and appended.

The content is normalised only as far as no count can change: a null text becomes the
empty one. (A byte-level tokenizer counts every byte, so folding case or space would be
wrong.)

Hot texts: misses are reduced to one row per digest before they are shuffled (partial
aggregation), and the join back is a sort-merge join on digest, whose over-large
partitions adaptive execution splits.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows keep one
result row each; doc_id may be null or repeated; an empty table gives an empty result.
Texts are never cut. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize
from .tokenization import ENCODE_BYTES, encoder, slices, version_digest

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def _read_cache(spark, cache_dir: str, version: str) -> DataFrame:
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    # Two writers may have appended the same text; equal keys have equal counts.
    return cache.filter(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache_dir: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", over: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``; the cache at ``cache_dir`` grows by what it lacked."""
    spark = docs.sparkSession
    version = version_digest(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in slices(batches, 1, ENCODE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * batch.num_rows), batch.column(0), pa.array(coder.encode(batch.column(1))[1], pa.int64())],
                names=["version", "digest", "n_tokens"],
            )

    rows = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    known = _read_cache(spark, cache_dir, version).select("digest")
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "digest", "left_anti").select("digest", "text")
    misses.mapInArrow(count, CACHE_SCHEMA).write.mode("append").parquet(cache_dir)
    # A table of its own: both sides of the join are then dealt by it, and a hot digest can be split.
    counts = materialize(_read_cache(spark, cache_dir, version), "counts")
    keyed = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return keyed.join(counts.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
