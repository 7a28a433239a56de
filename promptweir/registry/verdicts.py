"""Parsing recorded model outputs made from whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptweir.operators import verdicts
from promptweir.registry.inputs import (
    ANSWER_FORMS, JUDGE_FORMS, VERDICT_FORMS, escaped, fill, pick, sql_escaped, sql_fill, sql_pick, table, texts,
)
from promptweir.registry.verdict_sql import (
    classifier_sql, clean_answer_sql, legacy_judge_sql, light_sql, strict_judge_sql,
)
from promptweir.sources.lexicons import CATEGORIES, REFERENCE_MODELS

_QUERIES = ("May I file a lawsuit?", "How do I sort a list?", "Is it LEGAL to park here?", "What is a monad?")
_CONFIDENCES = ("0.95", "0.85", "0.7", "0.6", "0.4", "0.1")


def _recorded(spark, sf_dir, forms):
    """One recorded response per document; labelled ones take score and truth from the labels."""
    docs = texts(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    key, text = F.col("doc_id"), F.col("text")
    score = F.coalesce((F.col("quality") * 3 + F.col("toxic") + 1).cast("string"), F.lit("4"))
    truth = F.when(F.coalesce("toxic", F.lit(0)) == 1, "false").otherwise("true")
    raw = fill(forms, key, {
        "C": pick(CATEGORIES, F.floor(key / 5)), "F": pick(_CONFIDENCES, F.floor(key / 3)),
        "S": score, "B": truth, "T": escaped(text), "R": text})
    return docs.select(
        key.alias("request_id"), pick(REFERENCE_MODELS, F.floor(key / 2)).alias("model_id"),
        pick(_QUERIES, key).alias("query"), raw.alias("raw"))


def _recorded_sql(forms):
    parts = {
        "C": sql_pick(CATEGORIES, "doc_id // 5"), "F": sql_pick(_CONFIDENCES, "doc_id // 3"),
        "S": "coalesce(CAST(quality * 3 + toxic + 1 AS VARCHAR), '4')",
        "B": "CASE WHEN coalesce(toxic, 0) = 1 THEN 'false' ELSE 'true' END",
        "T": sql_escaped("text"), "R": "text"}
    return f"""recorded AS (
  SELECT doc_id AS request_id, {sql_pick(REFERENCE_MODELS, 'doc_id // 2')} AS model_id,
    {sql_pick(_QUERIES, 'doc_id')} AS query, {sql_fill(forms, 'doc_id', parts)} AS raw
  FROM documents LEFT JOIN labels USING (doc_id))"""


def answer_clean(spark, sf_dir):
    rows = _recorded(spark, sf_dir, ANSWER_FORMS)
    return rows.select("request_id", verdicts.clean_answer(F.col("raw")).alias("answer"))


def _classifier(spark, sf_dir):
    done = verdicts.classifier_verdicts(_recorded(spark, sf_dir, VERDICT_FORMS))
    return done.select("request_id", "parse_status", "verdict_category", "verdict_confidence")


def verdict_parse(spark, sf_dir):
    return _classifier(spark, sf_dir)


def verdict_rescue(spark, sf_dir):
    """How verdicts were read, per category."""
    return _classifier(spark, sf_dir).groupBy("parse_status", "verdict_category").agg(
        F.count(F.lit(1)).alias("verdicts"), F.round(F.avg("verdict_confidence"), 6).alias("mean_confidence"))


_FIELDS = ("parse_status", "score", "is_correct", "justification")


def judge_strict(spark, sf_dir):
    done = verdicts.judge_verdicts(_recorded(spark, sf_dir, JUDGE_FORMS))
    return done.select("request_id", "model_id", "accuracy", "completeness", "clarity", *_FIELDS)


def judge_lenient(spark, sf_dir):
    return verdicts.light_verdicts(_recorded(spark, sf_dir, JUDGE_FORMS)).select("request_id", *_FIELDS)


def judge_legacy(spark, sf_dir):
    return verdicts.legacy_verdicts(_recorded(spark, sf_dir, JUDGE_FORMS)).select("request_id", *_FIELDS)


def judge_report(spark, sf_dir):
    report = verdicts.judge_report(judge_strict(spark, sf_dir), ["model_id", "parse_status"])
    return report.withColumn("mean_score", F.round("mean_score", 6)).withColumn(
        "correct_share", F.round("correct_share", 6))


QUERIES = {
    "answer_clean": answer_clean,
    "verdict_parse": verdict_parse,
    "verdict_rescue": verdict_rescue,
    "judge_strict": judge_strict,
    "judge_lenient": judge_lenient,
    "judge_legacy": judge_legacy,
    "judge_report": judge_report,
}

_CLASSIFIER = f"WITH {_recorded_sql(VERDICT_FORMS)}, {classifier_sql('recorded')}"
_JUDGE = f"WITH {_recorded_sql(JUDGE_FORMS)}"
ORACLES = {
    "answer_clean": f"""WITH {_recorded_sql(ANSWER_FORMS)}
SELECT request_id, {clean_answer_sql('raw')} AS answer FROM recorded""",
    "verdict_parse": f"""{_CLASSIFIER}
SELECT request_id, parse_status, verdict_category, verdict_confidence::DOUBLE AS verdict_confidence FROM verdict_result""",
    "verdict_rescue": f"""{_CLASSIFIER}
SELECT parse_status, verdict_category, count(*) AS verdicts, round(avg(verdict_confidence), 6) AS mean_confidence
FROM verdict_result GROUP BY ALL""",
    "judge_strict": f"{_JUDGE}, {strict_judge_sql('recorded')} SELECT * FROM judge_result",
    "judge_lenient": f"{_JUDGE}, {light_sql('recorded')} SELECT * FROM light_result",
    "judge_legacy": f"{_JUDGE}, {legacy_judge_sql('recorded')} SELECT * FROM legacy_result",
    "judge_report": f"""{_JUDGE}, {strict_judge_sql('recorded')}
SELECT model_id, parse_status, count(*) AS verdicts,
  round(avg(score) FILTER (parse_status = 'ok'), 6) AS mean_score,
  round(avg(is_correct::INT) FILTER (parse_status = 'ok'), 6) AS correct_share,
  count(*) FILTER (parse_status <> 'ok') AS parse_failures FROM judge_result GROUP BY ALL""",
}
