"""Helpers that the operators of this subpackage share.

Null and hostile input is handled in one place where it can be: every operator
first projects its input with :func:`columns`, so extra columns (whatever their
names) never reach a join.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, fresh_dir, materialize, shared_dir

__all__ = ["columns", "discard", "fresh_dir", "materialize", "packed", "shared_dir", "table", "trim", "unpacked"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """Project ``new=(old, type)`` pairs; everything else is left behind."""
    return df.select(*[F.col(f"`{old}`").cast(kind).alias(new) for new, (old, kind) in wanted.items()])


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """All of a table's columns as one column ``row``, beside ``keys``: no name of the table's can clash with a later step's."""
    return df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def unpacked(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns ``names`` of a :func:`packed` table again, with other values for some."""
    return df.select(*[changed.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)])


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive tasks, and executors count what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
