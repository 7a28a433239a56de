"""Connected components of a link table by alternating large and small stars.

Every round is one pass over the links, written to the shared folder, so the plan stays short
and a lost executor costs one round at most. Neither links nor labels visit the driver; a round
is compared with the one before by a count and a sum of hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptweir.session import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link to another; component: its smallest node.

    NULL ends and links of a node with itself are left out; repeated links count once; without
    links the result is empty.
    """
    current = written(
        links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct(), "links")
    mark = lambda frame: frame.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(current)
    while seen[0]:
        current = written(_small_star(_large_star(current)), "links")
        now = mark(current)
        if now == seen:
            break
        seen = now
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
