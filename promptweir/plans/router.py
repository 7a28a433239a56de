"""From a prompt table to routed, answered and judged prompts in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptweir.operators import centroids as cen
from promptweir.operators import ensemble, features, requests, rules, verdicts
from promptweir.sources.lexicons import Lexicon


def classify(
    prompts: DataFrame, lexicon: Lexicon | None = None, text: str = "text",
    centroids: DataFrame | None = None, categories: list | None = None, variants: list[str] | None = None,
    verdict_raw: str | None = None,
) -> DataFrame:
    """Runs the classifiers whose inputs are given and combines their results.

    ``variants`` are vector columns of ``prompts`` (normalised and original text);
    ``verdict_raw`` is a column with the recorded classifier response. Every step works on
    the row at hand, so the same call serves batch and streaming frames.
    """
    df = rules.classify(features.preprocess(prompts, lexicon, text))
    if centroids is not None and variants:
        df = cen.classify(df, centroids, categories, variants, label="category")
    else:
        df = df.withColumn("embedding_category", F.lit(None).cast("string")).withColumn(
            "embedding_confidence", F.lit(None).cast("double"))
    if verdict_raw is not None:
        df = verdicts.classifier_verdicts(df, verdict_raw, text).withColumn("verdict_asked", F.lit(True))
    else:
        df = (
            df.withColumn("verdict_category", F.lit(None).cast("string"))
            .withColumn("verdict_confidence", F.lit(None).cast("double"))
            .withColumn("verdict_asked", F.lit(False)))
    return ensemble.combine(df)


def route(classified: DataFrame) -> DataFrame:
    """Adds complexity level, response format, secondary categories, model and system text."""
    code = F.col("features.complexity.has_code_markers")
    routed = (
        classified
        .withColumn("complexity_level", ensemble.complexity_level(F.col("features.word_count"), code))
        .withColumn("response_format", ensemble.response_format(F.col("category"), code))
        .withColumn("secondary_categories", ensemble.secondary_categories())
        .withColumn("model", ensemble.select_model(F.col("category"), F.col("confidence")))
    )
    return routed.withColumn("system_text", requests.system_text(F.col("category"), F.col("complexity_level")))


def answer(routed: DataFrame, responses: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Joins the recorded responses (key, response, judge_raw).

    A prompt that failed or has no response keeps its row, with success false.
    """
    joined = routed.join(responses.select(key, "response", "judge_raw"), key, "left")
    judged = verdicts.light_verdicts(joined.withColumnRenamed("parse_status", "verdict_status"), "judge_raw")
    error = F.coalesce("error", F.when(F.col("response").isNull(), "no recorded response"))
    unjudged = F.col("judge_raw").isNull()
    for column in ("score", "is_correct", "justification", "parse_status"):
        judged = judged.withColumn(column, F.when(~unjudged, F.col(column)))
    return (
        judged.withColumn("error", error)
        .withColumn("success", F.col("error").isNull())
        .withColumnRenamed("parse_status", "judge_status")
    )
