"""Helpers that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweir.session import small_batches  # noqa: F401 - for the operators

#: A word is a longest run of anything but space, tab, line feed, vertical tab, form feed and
#: carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo `divisor`; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def finite_vector(vector: Column) -> Column:
    """Whether a vector is neither NULL nor empty and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def parts(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def dealt(frame: DataFrame, *columns: str) -> DataFrame:
    """Dealt by columns to as many tasks as the session shuffles to. For few bytes with much work
    per byte, which the planner would gather into a task or two."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
