"""Running numbers that stay parallel when one key holds most of the rows.

A plain window over a key sorts all of the key's rows in one task. Here rows are dealt into
ranges of (key, order) of even size, whatever the values of the order columns are: a range's
place and a row's place in it follow from one sort, and only a total per key and range is summed
up per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptweir.session import written


def running_number(
    rows: DataFrame, key: str, order: list[str], out: str, before: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each key by ``order`` from one, or on from what ``before`` (key, n) counts.

    NULL is a key like any other, and NULL order values come last. Rows that are equal in key and
    order are numbered in any order, each with a number of its own.
    """
    placed = [F.col(c).asc_nulls_last() for c in (key, *order)]
    # Plain text and never NULL, so that the join below needs no null-safe form.
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    ranged = written(
        rows.withColumn("_key", named).repartitionByRange(*placed).sortWithinPartitions(*placed)
        .withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    totals = ranged.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_key", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    if before is not None:
        counted = before.select(named.alias("_key"), F.col("n").alias("_counted"))
        starts = starts.join(counted, "_key", "left").select(
            "_key", "_part", (F.col("_shift") + F.coalesce("_counted", F.lit(0))).alias("_shift"))
    return ranged.join(starts, ["_key", "_part"]).withColumn(out, F.col("_place") + F.col("_shift")).drop(
        "_key", "_part", "_place", "_shift")
