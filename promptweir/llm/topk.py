"""Exact top-k by inner product with vector-approximation files.

Vectors are whole numbers. Each component is replaced by one of a fixed number of cells between its
least and greatest value; the cells of all vectors are the approximation file. A scan of cells
bounds every score from both sides. Candidates whose upper bound reaches the k-th best lower bound
of their query are then read exactly in the order of their bounds: first the most promising ones,
whose k-th exact score is certain to be reached, then whatever may still reach that score.

Queries meet candidates in blocks of bounded size; only cells travel to the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptweir.llm.common import dealt, finite_vector, parts
from promptweir.session import written

CELLS = 64
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8_192
#: Candidates of a query read before the k-th score is looked at, in multiples of k.
FIRST_READ = 4


def whole_numbers(vector: Column, factor: float = 256.0) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")))


def _scan(k: int):
    def scan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "upper": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "upper": "float64"})
        queries, cells = rows[rows["exact"].notna()], rows[rows["cells"].notna()]
        if queries.empty or cells.empty:
            return none
        low, width = np.asarray(rows["low"].iloc[0], float), np.asarray(rows["width"].iloc[0], float)
        q = np.stack(queries["exact"].to_numpy()).astype(float)
        at = np.stack(cells["cells"].to_numpy()).astype(float)
        least = low + at * width
        most = least + width - 1  # cells hold whole numbers
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        upper = up @ most.T + down @ least.T
        lower = up @ least.T + down @ most.T
        ids, own = cells["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        itself = own[:, None] == ids[None, :]
        lower[itself] = upper[itself] = -np.inf
        if lower.shape[1] > k:
            bar = np.partition(lower, -k, axis=1)[:, -k]
        else:
            bar = np.full(len(q), -np.inf)
        # sums of large products may be off in the last places: a bound gives way by so much
        slack = 1e-9 * (np.abs(upper) + np.abs(lower))
        keep = (upper + np.where(np.isfinite(slack), slack, 0) >= bar[:, None]) & ~itself
        i, j = np.nonzero(keep)
        return pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "upper": upper[i, j] + np.where(
            np.isfinite(slack[i, j]), slack[i, j], 0)})
    return scan


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query with all
    other vectors, ties to the smaller key; fewer when there are fewer others.

    `vector` holds whole numbers after `whole_numbers`. Rows with a NULL key or vector, or with a
    component that is NULL or no finite number, take no part. Rows with equal keys are one vector,
    the smallest. Vectors of different lengths are not compared, an empty one scores 0 with others.
    Components are meant to stay below 2**24, so that all sums are exact.
    """
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & (finite_vector(F.col(vector)) | (F.size(vector) == 0))
    exact = written(
        vectors.where(good).groupBy(F.col(key).cast("long").alias("vec_id")).agg(
            F.min(F.struct(whole_numbers(F.col(vector)).alias("exact"), F.coalesce(is_query, F.lit(False)).alias("asks"))).alias("r"))
        .select("vec_id", "r.exact", "r.asks").withColumn("dims", F.size("exact")), "vectors")
    n, asking = exact.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    sides = exact.select("dims", F.posexplode_outer("exact").alias("at", "x")).groupBy("dims", "at").agg(
        F.min("x").alias("low"), F.max("x").alias("high"))
    grid = sides.groupBy("dims").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("low", F.lit(0)).alias("low"),
        (F.floor((F.coalesce(F.col("high") - F.col("low"), F.lit(0))) / cells) + 1).alias("width")))).alias("g")).select(
        F.col("dims"), F.expr("transform(g, s -> s.low)").alias("low"), F.expr("transform(g, s -> s.width)").alias("width"))
    query_blocks, candidate_blocks = parts(asking, QUERY_BLOCK), parts(n, CANDIDATE_BLOCK)
    coded = exact.join(grid, "dims").withColumn("cells", F.expr(
        "transform(exact, (x, i) -> cast((x - low[i]) div width[i] as tinyint))"))
    hashed = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    asks = coded.where("asks").select(
        "dims", hashed(1, query_blocks).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))).alias("c"),
        "vec_id", "exact", F.lit(None).cast("array<tinyint>").alias("cells"), "low", "width")
    answers = coded.select(
        "dims", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), hashed(2, candidate_blocks).alias("c"),
        "vec_id", F.lit(None).cast("array<bigint>").alias("exact"), "cells",
        F.lit(None).cast("array<bigint>").alias("low"), F.lit(None).cast("array<bigint>").alias("width"))
    met = dealt(asks.union(answers), "dims", "q", "c").groupBy("dims", "q", "c").applyInPandas(
        _first_row_has_grid(_scan(k)), "query_id long, vec_id long, upper double")
    by_bound = Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "vec_id")
    candidates = written(met.withColumn("place", F.row_number().over(by_bound)), "candidates")

    def read(some: DataFrame) -> DataFrame:
        asked = exact.select(F.col("vec_id").alias("query_id"), F.col("exact").alias("q"))
        found = some.join(asked, "query_id").join(exact.select("vec_id", "exact"), "vec_id")
        return found.select("query_id", "vec_id", F.expr(
            "aggregate(zip_with(q, exact, (x, y) -> x * y), 0L, (s, x) -> s + x)").alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda frame: frame.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    first = written(ranked(read(candidates.where(f"place <= {FIRST_READ * k}"))), "first")
    bar = first.where(f"rank = {k}").select("query_id", F.col("score").alias("bar"))
    rest = candidates.where(f"place > {FIRST_READ * k}").join(bar, "query_id", "left").where("bar IS NULL OR upper >= bar")
    every = first.select("query_id", "vec_id", "score").union(read(rest))
    return ranked(every).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _first_row_has_grid(scan):
    def ordered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return scan(key, rows.sort_values("low", key=lambda c: c.isna(), kind="stable"))
    return ordered
