"""Parsing recorded model outputs: reference answers, classifier and judge verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweir.functions import strict_json as sj
from promptweir.functions import text as tx
from promptweir.sources.lexicons import (
    CATEGORIES, LEGAL_WORDS, RESCUE_FRAGMENTS, UNKNOWN_VERDICT_CATEGORY,
)

# --- fixed values: required keys, defaults, fallback texts, patterns of damaged JSON ----
CLASSIFIER_KEYS = ("category", "confidence")
LIGHT_KEYS = ("score", "is_correct", "justification")
JUDGE_KEYS = ("score", "accuracy", "completeness", "clarity", "is_correct", "justification")
DEFAULT_SCORE = 3.0
QUOTED_RAW = 200  # characters of the raw text quoted in a fallback justification
RESCUED_SCORE = "Manually extracted from response: "
JUDGE_ERROR = ("Error in judging: '", "' object has no attribute 'get'")
UNREADABLE = "Could not parse judge response. Raw response: "
LEGACY_UNREADABLE = "Could not parse judge response"
THINK_BLOCK = r"(?s)<think>.*?</think>"
CATEGORY_IN_TEXT = rf'(?iU)"category":{tx.SPACE}*"([^"]+)"'
CONFIDENCE_IN_TEXT = rf'(?U)"confidence":{tx.SPACE}*([0-9.]+)'
SCORE_IN_TEXT = rf'(?U)"score":{tx.SPACE}*(\p{{Nd}}+)'


def clean_answer(raw: Column) -> Column:
    """The answer part of a raw reference answer.

    Removes the first thinking block and its exact copies; without a full block, drops
    stray opening tags; without tags, keeps what follows the first answer mark.
    """
    block = F.regexp_extract(raw, THINK_BLOCK, 0)
    mark = F.locate("Answer:", raw)
    return tx.strip(
        F.when(block != "", F.replace(raw, block, F.lit("")))
        .when(F.contains(raw, F.lit("<think>")), F.replace(raw, F.lit("<think>"), F.lit("")))
        .when(mark > 0, F.substring(raw, mark + len("Answer:"), F.char_length(raw)))
        .otherwise(raw))


def _known_category(name: Column) -> Column:
    """Exact name, else the first declared name that contains or is contained in it."""
    exact = F.when(name.isin(list(CATEGORIES)), name)
    near = F.get(F.filter(
        F.array(*[F.lit(c) for c in CATEGORIES]),
        lambda c: F.contains(c, name) | F.contains(name, c)), F.lit(0))
    return F.coalesce(exact, near, F.lit(UNKNOWN_VERDICT_CATEGORY))


def _rescued_category(name: Column) -> Column:
    chain = None
    for fragments, category in RESCUE_FRAGMENTS:
        found = reduce(lambda a, b: a | b, [F.contains(name, F.lit(f)) for f in fragments])
        chain = F.when(found, category) if chain is None else chain.when(found, category)
    return chain.otherwise(UNKNOWN_VERDICT_CATEGORY)


def _number(text: Column) -> Column:
    """The number a text spells; a cast alone would also take a type suffix such as ``0.9d``."""
    return F.when(~text.rlike("[dDfF]$") | text.rlike("(?i)^[+-]?inf$"), text.try_cast("double"))


def classifier_verdicts(responses: DataFrame, raw: str = "raw", query: str = "query") -> DataFrame:
    """Adds verdict_category, verdict_confidence and parse_status.

    parse_status: ``ok`` - parsed; ``rescued`` - read from damaged JSON; ``legal_default`` -
    unreadable, but the prompt is about law; ``no_verdict`` - leave it to the
    other classifiers (category and confidence are NULL).
    """
    text = tx.strip(F.col(raw))
    close = F.locate("</think>", text)
    after = F.when(
        F.contains(text, F.lit("<think>")) & (close > 0),
        tx.strip(F.substring(text, close + len("</think>"), F.char_length(text)))).otherwise(text)
    flat = F.regexp_extract(after, r"\{[^}]*\}", 0)
    df = (
        responses.withColumn("_text", text)
        .withColumn("_json", F.when(flat != "", flat).otherwise(after))
        .withColumn("_v", sj.parse(F.col("_json"), CLASSIFIER_KEYS))
    )
    v = F.col("_v")
    df = (
        df.withColumn("_kind", sj.kind(v))
        .withColumn("_ckind", sj.kind(v, ".category")).withColumn("_fkind", sj.kind(v, ".confidence"))
        .withColumn("_cat", F.upper(F.coalesce(sj.get(v, "category", "string"), F.lit(""))))
        .withColumn("_conf", F.when(F.col("_fkind").isNull(), F.lit(0.7))
                    .when(F.col("_fkind") == "BOOLEAN", sj.get(v, "confidence", "boolean").cast("double"))
                    .otherwise(_number(tx.strip(sj.get(v, "confidence", "string")))))
        .withColumn("_rname", F.upper(F.regexp_extract("_text", CATEGORY_IN_TEXT, 1)))
        .withColumn("_rtext", F.regexp_extract("_text", CONFIDENCE_IN_TEXT, 1))
    )
    # A wrong type is not a parse failure: it skips the rescue and ends without a verdict.
    bad_type = (
        (F.col("_kind") != "OBJECT")
        | (F.col("_ckind").isNotNull() & (F.col("_ckind") != "STRING"))
        | F.col("_fkind").isin("VOID", "ARRAY", "OBJECT")
    )
    rescue_conf = F.when(F.col("_rtext") == "", F.lit(0.7)).otherwise(F.col("_rtext").try_cast("double"))
    lowered = F.lower(F.col(query))
    legal = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in LEGAL_WORDS])
    status = (
        F.when(F.col(raw).isNull(), "no_verdict")
        .when(F.coalesce(bad_type, F.lit(False)), "no_verdict")
        .when(v.isNotNull() & F.col("_conf").isNotNull(), "ok")
        .when((F.col("_rname") != "") & rescue_conf.isNull(), "no_verdict")
        .when(F.col("_rname") != "", "rescued")
        .when(legal, "legal_default")
        .otherwise("no_verdict"))
    df = df.withColumn("parse_status", status)
    is_status = lambda s: F.col("parse_status") == s
    return (
        df.withColumn("verdict_category",
                      F.when(is_status("ok"), _known_category(F.col("_cat")))
                      .when(is_status("rescued"), _rescued_category(F.col("_rname")))
                      .when(is_status("legal_default"), "BUSINESS_PROFESSIONAL"))
        .withColumn("verdict_confidence",
                    F.when(is_status("ok"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_conf"))))
                    .when(is_status("rescued"), rescue_conf)
                    .when(is_status("legal_default"), F.lit(0.8)))
        .drop("_text", "_json", "_v", "_kind", "_ckind", "_fkind", "_cat", "_conf", "_rname", "_rtext")
    )


def judge_verdicts(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Strict judge verdicts: six required fields, each failure with its own status."""
    cleaned = tx.strip(F.regexp_replace(tx.strip(F.col(raw)), THINK_BLOCK, ""))
    df = responses.withColumn("_json", tx.between(cleaned, "{", "}")).withColumn(
        "_v", sj.parse(F.col("_json"), JUDGE_KEYS))
    v = F.col("_v")
    df = df.withColumn("parse_status",
                       F.when(F.col("_json").isNull(), "no_json").when(v.isNull(), "bad_json")
                       .when(~sj.has_keys(v, JUDGE_KEYS), "missing_keys").otherwise("ok"))
    ok = F.col("parse_status") == "ok"
    for name in JUDGE_KEYS[:4]:
        df = df.withColumn(name, F.when(ok, sj.get(v, name, "double")))
    return (
        df.withColumn("is_correct", F.when(ok, sj.get(v, "is_correct", "boolean")))
        .withColumn("justification", F.when(ok, sj.get(v, "justification", "string")))
        .drop("_json", "_v")
    )


def light_verdicts(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Lenient judge verdicts; every row gets a score, parse_status tells where from.

    ``ok`` - parsed; ``score_rescued`` - score read from damaged JSON; ``default`` - nothing
    readable; ``error`` - valid JSON that is not an object.
    """
    stripped = tx.strip(F.col(raw))
    df = (
        responses.withColumn("_json", F.coalesce(tx.between(stripped, "{", "}"), stripped))
        .withColumn("_v", sj.parse(F.col("_json"), LIGHT_KEYS))
        .withColumn("_kind", sj.kind(F.col("_v")))
        .withColumn("_digits", F.regexp_extract(raw, SCORE_IN_TEXT, 1))
    )
    v = F.col("_v")
    usable = (F.col("_kind") == "OBJECT") & sj.has_keys(v, ("score", "justification"))
    df = df.withColumn("parse_status",
                       F.when(usable, "ok").when(F.col("_kind") != "OBJECT", "error")
                       .when(F.col("_digits") != "", "score_rescued").otherwise("default"))
    is_status = lambda s: F.col("parse_status") == s
    quoted = F.left(F.col(raw), F.lit(QUOTED_RAW))
    type_name = (
        F.when(F.col("_kind") == "ARRAY", "list").when(F.col("_kind") == "STRING", "str")
        .when(F.col("_kind") == "BIGINT", "int").when(F.col("_kind") == "BOOLEAN", "bool")
        .when(F.col("_kind") == "VOID", "NoneType").otherwise("float"))
    return (
        df.withColumn("score",
                      F.when(is_status("ok"), sj.get(v, "score", "double"))
                      .when(is_status("score_rescued"), F.col("_digits").try_cast("double"))
                      .otherwise(F.lit(DEFAULT_SCORE)))
        .withColumn("is_correct",
                    F.when(is_status("ok"), sj.get(v, "is_correct", "boolean")).otherwise(F.lit(True)))
        .withColumn("justification",
                    F.when(is_status("ok"), sj.get(v, "justification", "string"))
                    .when(is_status("score_rescued"), F.concat(F.lit(RESCUED_SCORE), quoted))
                    .when(is_status("error"), F.concat(
                        F.lit(JUDGE_ERROR[0]), type_name, F.lit(JUDGE_ERROR[1])))
                    .otherwise(F.concat(F.lit(UNREADABLE), quoted)))
        .drop("_json", "_v", "_kind", "_digits")
    )


def legacy_verdicts(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Oldest judge form: the whole text is one JSON value, or the default applies."""
    df = responses.withColumn("_v", sj.parse(F.col(raw), LIGHT_KEYS))
    v = F.col("_v")
    ok = v.isNotNull()
    return (
        df.withColumn("parse_status", F.when(ok, "ok").otherwise("default"))
        .withColumn("score", F.when(ok, sj.get(v, "score", "double")).otherwise(F.lit(DEFAULT_SCORE)))
        .withColumn("is_correct", F.when(ok, sj.get(v, "is_correct", "boolean")).otherwise(F.lit(True)))
        .withColumn("justification",
                    F.when(ok, sj.get(v, "justification", "string")).otherwise(LEGACY_UNREADABLE))
        .drop("_v")
    )


def judge_report(verdicts: DataFrame, group: list[str]) -> DataFrame:
    """Scores and failures per group; defaults do not enter the means."""
    ok = F.col("parse_status") == "ok"
    return verdicts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("verdicts"),
        F.avg(F.when(ok, F.col("score"))).alias("mean_score"),
        F.avg(F.when(ok, F.col("is_correct").cast("double"))).alias("correct_share"),
        F.sum((~ok).cast("int")).alias("parse_failures"),
    )
