"""Mixing sources to target token counts by entropy balancing.

A document of size s in source g gets the rate min(cap, exp(l_g * s)): among all rates whose
tokens meet the target of the source it is the one closest to 1 in relative entropy, bounded by
the cap. The multipliers l_g solve a convex dual; each Newton step is one distributed
aggregation over a (source, size, documents) histogram, which gives the same sums as the
documents because a rate depends on nothing else. Rates become whole copies by systematic
rounding along descending sizes; what is left of a source's target is settled on its smallest
documents. Only DataFrame functions are used.

Ranks and running sums over documents never sort a whole source in one task: a (source, size)
cell is dealt into hashed buckets of bounded size, and only bucket totals meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptweir.llm.common import WORD
from promptweir.session import written

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: A source is solved when its tokens are this close to its target, relatively.
TOLERANCE, MAX_STEPS = 1e-6, 60
BUCKET = 20_000


def with_size(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the words of the whole text (NULL: 0)."""
    return docs.select("doc_id", "source", F.coalesce(
        F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_ranks(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, NULL last: ranges first, then places in a range."""
    ranged = written(
        sources.repartitionByRange(
            8, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("place", place).join(before, "part").select(
        *sources.columns, (F.col("before") + F.col("place") - 1).alias("rank"))


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of sources (source, source_size): `share` of all tokens dealt by the repeating
    weights, none above `cap` times its source, the excess dealt again by weight.

    Dealing again until none is above equals one level t with target min(cap * size, t * weight);
    each turn of the loop is one aggregation over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(source_ranks(sources).withColumn("weight", weight.cast("double")), "weights")
    full = F.col("source_size") * F.lit(float(cap))
    level = 0.0
    while True:
        below = full > F.lit(level) * F.col("weight")
        total, fixed, open_weight = ranked.agg(
            F.sum("source_size"), F.sum(F.when(~below, full)), F.sum(F.when(below, F.col("weight")))).first()
        if not total or not open_weight:
            break
        now = (min(share, cap) * total - (fixed or 0.0)) / open_weight
        if now <= level * (1 + 1e-15):
            break
        level = now
    return ranked.withColumn("full", full <= F.lit(level) * F.col("weight")).withColumn(
        "target", F.least(full, F.lit(level) * F.col("weight")))


def rates(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """source -> multiplier, by safeguarded Newton steps on the dual of all sources at once.

    cells: source, size, n. A step that leaves the bracket known so far is replaced by its middle.
    """
    open_sources = targets.where("source_size > 0 AND target > 0").select("source", "target", "scale", "full")
    limit = math.log(cap)
    state = written(open_sources.select(
        "source", "target", "scale",
        F.when(F.col("full"), F.lit(limit) * F.col("scale")).otherwise(0.0).alias("step"), (F.lit(-60.0) * F.col("scale")).alias("low"),
        (F.lit(limit) * F.col("scale")).alias("high")), "dual")
    cells = cells.where("size > 0")
    for _ in range(MAX_STEPS):
        z = F.col("size") / F.col("scale")
        tilt = F.exp(F.least(F.col("step") * z, F.lit(limit)))
        tokens = F.col("n") * F.col("size")
        sums = cells.join(state, F.expr("cells_source <=> source")).groupBy("source", "target", "scale", "step", "low", "high").agg(
            F.sum(tokens * tilt).alias("have"),
            F.sum(F.when(F.col("step") * z < limit, tokens * tilt * z).otherwise(0.0)).alias("slope"))
        gap = F.col("have") - F.col("target")
        low = F.when(gap < 0, F.greatest("low", "step")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", "step")).otherwise(F.col("high"))
        # Newton on the logarithm of the tokens, which is nearly a straight line in the multiplier.
        newton = F.col("step") - F.log(F.col("have") / F.col("target")) * F.col("have") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        solved = F.abs(gap) <= F.lit(TOLERANCE) * F.col("target")
        state = written(sums.select(
            "source", "target", "scale",
            F.when(solved, F.col("step")).when(inside, newton).otherwise((low + high) / 2).alias("step"),
            low.alias("low"), high.alias("high"), solved.alias("solved")), "dual")
        if not state.where("NOT solved").limit(1).count():
            break
        state = state.drop("solved")
    return state.select("source", "step", "scale")


def _rounded(cells: DataFrame, multipliers: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Per cell (source, size): whole copies for all its documents and how many get one more.

    Windows here run over the distinct sizes of a source, at most sqrt(2 * tokens) of them.
    """
    known = (cells.join(multipliers, F.expr("cells_source <=> source"), "left").drop("source")
             .join(targets.select("source", "target"), F.expr("cells_source <=> source")).drop("source"))
    top = int(cap)
    rate = F.when(F.col("size") > 0, F.least(F.lit(cap), F.exp(
        F.least(F.col("step") * F.col("size") / F.col("scale"), F.lit(math.log(cap))))))
    rate = F.coalesce(F.when(F.col("target") > 0, rate), F.lit(0.0))
    known = known.withColumn("rate", rate).withColumn("base", F.least(F.floor(F.col("rate") + 1e-9), F.lit(top)))
    part = F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)) * F.col("n")
    down = Window.partitionBy("cells_source").orderBy(F.col("size").desc())
    until = F.sum(part).over(down.rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("until", until).withColumn(
        "more", F.floor(F.col("until") + 0.5) - F.floor(
            F.coalesce(F.lag("until").over(down), F.lit(0.0)) + 0.5))
    known = known.withColumn("more", F.least(F.greatest(F.col("more"), F.lit(0)), F.col("n")))
    whole = Window.partitionBy("cells_source")
    left = F.col("target") - F.sum(F.col("size") * (F.col("base") * F.col("n") + F.col("more"))).over(whole)
    known = known.withColumn("left", left)
    room = F.when(F.col("size") <= 0, 0).when(F.col("left") < 0, F.col("more")).otherwise(
        F.when(F.col("base") < top, F.col("n") - F.col("more")).otherwise(0))
    up = Window.partitionBy("cells_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("room", room)
    before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(up), F.lit(0))
    moved = F.floor((F.abs(F.col("left")) - before) / F.col("size"))
    moved = F.when(F.col("size") > 0, F.least(F.greatest(moved, F.lit(0)), F.col("room"))).otherwise(0)
    return known.select(
        "cells_source", "size", "base", "n",
        (F.col("more") + F.when(F.col("left") < 0, -moved).otherwise(moved)).cast("long").alias("more"))


def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
        key: str = "doc_id") -> DataFrame:
    """Every row of `sized` (key, source, size) with source_size, target, rate and whole copies.

    Same rows give the same copies on every run: ties within a (source, size) cell are broken by a
    hash of the key, then the key. Rows of size 0 and rows of a source without tokens get 0 copies;
    a NULL source is a source; repeated rows are separate rows; an empty table gives an empty table.
    """
    sized = written(sized.select(key, "source", "size"), "sized")
    cells = written(sized.groupBy(F.col("source").alias("cells_source"), "size").agg(
        F.count(F.lit(1)).alias("n")), "cells")
    sources = cells.groupBy(F.col("cells_source").alias("source")).agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"),
        (F.sum(F.col("size") * F.col("n")) / F.greatest(
            F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)), F.lit(1))).alias("scale"))
    targets = written(with_targets(sources, weights, share, cap), "targets")
    plan = written(_rounded(cells, rates(cells, targets, cap), targets, cap), "copies")

    hashed = F.xxhash64(F.col(key), F.lit("mix"))
    busy = plan.select(
        F.col("cells_source"), F.col("size").alias("cell_size"), "base", "more",
        F.ceil(F.col("n") / BUCKET).alias("buckets"))
    rows = sized.join(busy, F.expr("source <=> cells_source AND size = cell_size")).drop("cells_source", "cell_size")
    rows = rows.withColumn("bucket", F.pmod(hashed, F.col("buckets")))
    totals = rows.where("buckets > 1 AND more > 0").groupBy(
        F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket")).agg(
        F.count(F.lit(1)).alias("b_n"))
    before = totals.select("b_source", "b_size", "b_bucket", F.coalesce(F.sum("b_n").over(
        Window.partitionBy("b_source", "b_size").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(hashed, F.col(key)))
    ranked = rows.withColumn("place", place).join(
        before, F.expr("source <=> b_source AND size = b_size AND bucket = b_bucket"), "left")
    more = (F.coalesce(F.col("before"), F.lit(0)) + F.col("place") <= F.col("more")).cast("long")
    out = ranked.select(key, F.col("source").alias("row_source"), "size", (F.col("base") + more).alias("copies"))
    return out.join(targets, F.expr("row_source <=> source")).select(
        key, F.col("row_source").alias("source"), "size", "source_size", "target", "copies")


def taken(mixed: DataFrame) -> Column:
    return (F.col("copies") * F.col("size")).cast("long")
