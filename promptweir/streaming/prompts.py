"""Stateless classification of a prompt stream, and windowed category counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptweir.plans import router


def routed_stream(prompts: DataFrame, **classifiers) -> DataFrame:
    """The batch plan applied to a stream; no state, no shuffle."""
    return router.route(router.classify(prompts, **classifiers))


def category_windows(routed: DataFrame, ts: str, window: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Prompts and mean confidence per category and event-time window."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        routed.withWatermark(ts, lateness)
        .groupBy(span.alias("w"), "category")
        .agg(F.count(F.lit(1)).alias("prompts"), F.avg("confidence").alias("mean_confidence"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "category", "prompts", "mean_confidence")
    )
