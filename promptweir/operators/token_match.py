"""Greedy token matching on recorded token vectors (precision, recall, F1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_BLOCK = 256

_BEST = T.ArrayType(T.DoubleType())
_MAXIMA = T.StructType([T.StructField("left", _BEST), T.StructField("right", _BEST)])


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


@F.pandas_udf(_MAXIMA)
def _block_maxima(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Best cosine of every token against the other block, both ways."""
    rows = []
    for a, b in zip(left, right):
        table = _unit_rows(a) @ _unit_rows(b).T
        rows.append((table.max(axis=1), table.max(axis=0)))
    return pd.DataFrame(rows, columns=["left", "right"])


def token_blocks(token_vectors: DataFrame, text: str, pos: str, vector: str, block: int = TOKEN_BLOCK) -> DataFrame:
    """Token vectors gathered in runs of at most ``block`` positions."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(vector).alias("v"))))
    return (
        token_vectors.groupBy(F.col(text).alias("text_id"), F.floor(F.col(pos) / block).alias("block"))
        .agg(ordered.alias("o"))
        .select("text_id", "block", F.transform("o", lambda s: s["v"]).alias("vectors"))
    )


def token_match_f1(pairs: DataFrame, keys: list[str], left: str, right: str, token_vectors: DataFrame,
                   text: str = "text_id", pos: str = "pos", vector: str = "embedding",
                   block: int = TOKEN_BLOCK) -> DataFrame:
    """``keys``, precision, recall and f1 of the text pair (``left``, ``right``).

    The similarity table of two texts is worked through block by block, each block
    pair being one row, so a long text spreads over tasks. Only each token's best
    value leaves a block.
    """
    blocks = token_blocks(token_vectors, text, pos, vector, block)
    own = blocks.select(F.col("text_id").alias(left), F.col("block").alias("_lb"), F.col("vectors").alias("_lv"))
    other = blocks.select(F.col("text_id").alias(right), F.col("block").alias("_rb"), F.col("vectors").alias("_rv"))
    maxima = (
        pairs.select(*dict.fromkeys([*keys, left, right])).join(own, left).join(other, right)
        .select(*keys, "_lb", "_rb", _block_maxima("_lv", "_rv").alias("_m"))
    )
    sides = F.array(
        F.struct(F.lit("l").alias("_side"), F.col("_lb").alias("_block"), F.col("_m.left").alias("_best")),
        F.struct(F.lit("r").alias("_side"), F.col("_rb").alias("_block"), F.col("_m.right").alias("_best")))
    best = (
        maxima.select(*keys, F.inline_outer(sides))
        .select(*keys, "_side", "_block", F.posexplode_outer("_best").alias("_i", "_x"))
        .groupBy(*keys, "_side", "_block", "_i").agg(F.max("_x").alias("_x"))
    )
    mean = lambda side: F.avg(F.when(F.col("_side") == side, F.col("_x")))
    scores = best.groupBy(*keys).agg(mean("l").alias("precision"), mean("r").alias("recall"))
    p, q = F.col("precision"), F.col("recall")
    return scores.withColumn("f1", F.when(p + q != 0, 2 * p * q / (p + q)).otherwise(0.0))
