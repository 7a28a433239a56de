"""Combining classifier results, and what follows from the chosen category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptweir.sources.lexicons import (
    DEFAULT_FORMAT, DEFAULT_MODEL, RESPONSE_FORMATS, SPECIALISED_MODELS,
)

HIGH = 0.8
MEDIUM = 0.6


def lookup(key: Column, table: dict[str, str], default: str | None) -> Column:
    """Constant table lookup folded into the plan."""
    chain = None
    for k, v in table.items():
        chain = F.when(key == k, v) if chain is None else chain.when(key == k, v)
    return chain.otherwise(F.lit(default))


def combine(df: DataFrame) -> DataFrame:
    """Adds category, confidence and method from the three classifiers' columns.

    Missing verdicts fall back as the classifiers do: no vector - the rule result takes
    the embedding slot; an unreadable verdict (``verdict_asked``, but no category) -
    the embedding result takes the verdict slot.
    """
    asked = F.col("verdict_asked") if "verdict_asked" in df.columns else F.lit(True)
    df = (
        df.withColumn("embedding_confidence", F.when(
            F.col("embedding_category").isNull(), F.col("rule_confidence")).otherwise(F.col("embedding_confidence")))
        .withColumn("embedding_category", F.coalesce("embedding_category", "rule_category"))
    )
    df = (
        df.withColumn("verdict_confidence", F.when(
            asked & F.col("verdict_category").isNull(), F.col("embedding_confidence"))
            .otherwise(F.coalesce("verdict_confidence", F.lit(0.0))))
        .withColumn("verdict_category", F.when(
            asked & F.col("verdict_category").isNull(), F.col("embedding_category"))
            .otherwise(F.col("verdict_category")))
    )
    lc, lf = F.col("verdict_category"), F.col("verdict_confidence")
    ec, ef = F.col("embedding_category"), F.col("embedding_confidence")
    rc, rf = F.col("rule_category"), F.col("rule_confidence")
    has = lc.isNotNull()

    def pick(category: Column, confidence: Column, method: str) -> Column:
        return F.struct(category.alias("category"), confidence.alias("confidence"), F.lit(method).alias("method"))

    choice = (
        F.when(has & (lf >= HIGH), pick(lc, lf, "LLM (high confidence)"))
        .when(has & (lf >= MEDIUM) & ((ec == lc) | (rc == lc)),
              pick(lc, F.least(lf + 0.1, F.lit(1.0)), "LLM (confirmed by other methods)"))
        .when(has & (lf >= MEDIUM), pick(lc, lf, "LLM (medium confidence)"))
        .when(ef >= HIGH, pick(ec, ef, "Embedding (high confidence)"))
        .when(rf >= HIGH, pick(rc, rf, "Rule-based (high confidence)"))
        .when(has & (lf > F.greatest(ef, rf)), pick(lc, lf, "LLM (best available)"))
        .when(ef > rf, pick(ec, ef, "Embedding (best non-LLM)"))
        .otherwise(pick(rc, rf, "Rule-based (fallback)")))
    return df.withColumn("_choice", choice).select("*", "_choice.*").drop("_choice")


def combine_legacy(df: DataFrame) -> DataFrame:
    """Older rule: the embedding result, unless it is weak and the rules are surer."""
    no_vector = F.col("embedding_category").isNull()
    confidence = F.when(no_vector, F.col("legacy_confidence")).otherwise(F.col("embedding_confidence"))
    category = F.coalesce("embedding_category", "legacy_category")
    weaker = (confidence < MEDIUM) & (F.col("legacy_confidence") > confidence)
    return (
        df.withColumn("category", F.when(weaker, F.col("legacy_category")).otherwise(category))
        .withColumn("confidence", F.when(weaker, F.col("legacy_confidence")).otherwise(confidence))
    )


def complexity_level(word_count: Column, has_code_markers: Column) -> Column:
    return (
        F.when(word_count >= 20, "ADVANCED")
        .when((word_count >= 5) & has_code_markers, "INTERMEDIATE")
        .otherwise("BASIC"))


def response_format(category: Column, has_code_markers: Column) -> Column:
    return F.when(has_code_markers, "CODE").otherwise(lookup(category, RESPONSE_FORMATS, DEFAULT_FORMAT))


def secondary_categories() -> Column:
    """Embedding then rule category, when sure enough and not the primary one."""
    return F.transform(
        F.filter(
            F.array(
                F.struct(F.col("embedding_category").alias("c"), F.col("embedding_confidence").alias("f")),
                F.struct(F.col("rule_category").alias("c"), F.col("rule_confidence").alias("f"))),
            lambda s: (s["c"] != F.col("category")) & (s["f"] >= MEDIUM)),
        lambda s: s["c"])


def select_model(category: Column, confidence: Column, models: dict[str, str] | None = None) -> Column:
    return F.when(confidence >= MEDIUM, lookup(category, models or SPECIALISED_MODELS, DEFAULT_MODEL)).otherwise(
        DEFAULT_MODEL)


def with_model_table(df: DataFrame, models: DataFrame, default: str = DEFAULT_MODEL) -> DataFrame:
    """Routing by a table ``(category, model)`` instead of constants; Spark sizes the join."""
    joined = df.join(models.select("category", F.col("model").alias("_model")), "category", "left")
    return joined.withColumn("model", F.when(
        F.col("confidence") >= MEDIUM, F.coalesce("_model", F.lit(default))).otherwise(default)).drop("_model")


def category_report(routed: DataFrame, group: list[str]) -> DataFrame:
    """Prompts, mean confidence and share of all prompts per group."""
    groups = routed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("prompts"), F.avg("confidence").alias("mean_confidence"))
    total = F.sum("prompts").over(Window.partitionBy())  # one row per group, not per prompt
    return groups.withColumn("share", F.col("prompts") / total)
