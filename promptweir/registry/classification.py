"""Rule, centroid and ensemble classification, routing and request tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptweir.operators import centroids as cen
from promptweir.operators import ensemble, features, requests, rules
from promptweir.plans import router
from promptweir.registry.inputs import (
    CHAT_PROMPTS, DOCUMENT_PROMPTS, LABELLED_VECTORS, PROMPT_VECTORS, VERDICT_FORMS, chat_prompts,
    document_prompts, escaped, fill, JUDGE_FORMS, labelled_vectors, pick, prompt_vectors, q, sql_escaped,
    sql_fill, sql_list, sql_pick, table,
)
from promptweir.functions import text as tx
from promptweir.registry.prompts import FEATURES, NORMALIZED
from promptweir.registry.verdict_sql import classifier_sql, light_sql
from promptweir.sources import lexicons
from promptweir.sources.lexicons import (
    BASE_INSTRUCTION, CATEGORIES, CATEGORY_INSTRUCTIONS, COMPLEXITY_INSTRUCTIONS, DEFAULT_FORMAT,
    DEFAULT_MODEL, LEGACY_KEYWORDS, RESPONSE_FORMATS, RULES, SPECIALISED_MODELS,
    TIER_WEIGHTS, Lexicon,
)

# --- rules ---------------------------------------------------------------------------


def _rule_test(tier: str, pattern: str) -> str:
    if tier == "phrases":
        return f"regexp_matches(normalized_query, {q(pattern.replace(chr(92) + 'w', tx.WORD))})"
    return f"regexp_matches(normalized_query, {q(f'(^|{tx.NOT_WORD}){pattern}($|{tx.NOT_WORD})')})"


def _rule_scores(weight) -> str:
    raw = lambda tiers: " + ".join(
        f"CASE WHEN {_rule_test(t, p)} THEN {weight(t, p)} ELSE 0 END" for t, ps in tiers.items() for p in ps)
    return "rule_scores AS (" + " UNION ALL ".join(
        f"SELECT prompt_id, {i} AS cat_ord, {q(c)} AS category, {raw(tiers)} AS raw_score, "
        f"{sum(weight(t, p) for t, ps in tiers.items() for p in ps)}::DOUBLE AS top FROM normalized"
        for i, (c, tiers) in enumerate(RULES.items())) + ")"


_RULE_BEST = """
rule_rank AS (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY raw_score / top DESC, cat_ord) AS r FROM rule_scores),
rule_result AS (
  SELECT prompt_id, raw_score AS rule_raw_score,
    CASE WHEN raw_score > 0 THEN category ELSE 'CONVERSATIONAL_ADVICE' END AS rule_category,
    CASE WHEN raw_score = 0 THEN 0.05::DOUBLE
      WHEN raw_score >= 8 THEN least(least(raw_score / top * 1.5, 1) + 0.2, 1)
      ELSE least(raw_score / top * 1.5, 1) END AS rule_confidence
  FROM rule_rank WHERE r = 1)"""
RULE_SQL = f"{_rule_scores(lambda tier, pattern: TIER_WEIGHTS[tier])},{_RULE_BEST}"
_OWN_RULE_SQL = f"{_rule_scores(lambda tier, pattern: TIER_WEIGHTS[tier] + len(pattern) % 3)},{_RULE_BEST}"

LEGACY_SQL = "legacy_scores AS (" + " UNION ALL ".join(
    f"SELECT prompt_id, {i} AS cat_ord, {q(c)} AS category, "
    f"(SELECT count(*) FROM (SELECT unnest({sql_list(ws)}) AS w) k WHERE contains(normalized_query, k.w)) "
    f"/ {len(ws)}::DOUBLE AS score FROM normalized"
    for i, (c, ws) in enumerate(LEGACY_KEYWORDS.items())) + """),
legacy_rank AS (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, cat_ord) AS r FROM legacy_scores),
legacy_result AS (
  SELECT prompt_id, CASE WHEN score > 0 THEN category ELSE 'CONVERSATIONAL_ADVICE' END AS legacy_category,
    CASE WHEN score > 0 THEN least(score * 2, 1) ELSE 0.3::DOUBLE END AS legacy_confidence
  FROM legacy_rank WHERE r = 1)"""


def _normalized(spark, sf_dir, source=document_prompts):
    return features.with_normalized(source(spark, sf_dir), Lexicon())


def rule_scores(spark, sf_dir):
    return rules.rule_scores(_normalized(spark, sf_dir)).select(
        "prompt_id", "category", F.col("raw_score").cast("bigint").alias("raw_score"),
        F.round("normalized_score", 6).alias("normalized_score"))


def rule_classify(spark, sf_dir):
    return rules.classify(_normalized(spark, sf_dir)).select(
        "prompt_id", "rule_category", F.round("rule_confidence", 6).alias("rule_confidence"))


def legacy_rule_classify(spark, sf_dir):
    return rules.classify_legacy(_normalized(spark, sf_dir)).select(
        "prompt_id", "legacy_category", F.round("legacy_confidence", 6).alias("legacy_confidence"))


def rules_by_table(spark, sf_dir):
    """Rules and keywords as tables, as a caller's own would be, with weights of their own."""
    own = lexicons.rule_frame(spark).withColumn("weight", F.col("weight") + F.length("pattern") % 3)
    done = rules.classify_by_table(_normalized(spark, sf_dir), own)
    done = rules.classify_legacy_by_table(done, lexicons.keyword_frame(spark))
    return done.select(
        "prompt_id", "rule_raw_score", "rule_category", F.round("rule_confidence", 6).alias("rule_confidence"),
        "legacy_category", F.round("legacy_confidence", 6).alias("legacy_confidence"))


# --- vectors -------------------------------------------------------------------------

CENTROID_SQL = f"""{LABELLED_VECTORS},
cells AS (
  SELECT category, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vectors),
means AS (SELECT category, i, avg(x) AS m FROM cells GROUP BY ALL),
centroids AS (SELECT category, list(m ORDER BY i) AS centroid FROM means GROUP BY category),
category_order(category, cat_ord) AS (VALUES {', '.join(f'({q(c)}, {i})' for i, c in enumerate(CATEGORIES))})"""

_COSINES = """
similarity AS (
  SELECT v.{key} AS {key}, c.category, o.cat_ord,
    greatest(list_cosine_similarity(v.embedding, c.centroid), list_cosine_similarity(v.variant, c.centroid)) AS s,
    list_cosine_similarity(v.embedding, c.centroid) AS s_first
  FROM {source} v, centroids c JOIN category_order o USING (category)),
nearest AS (
  SELECT {key}, arg_max(category, s) AS embedding_category, max(s) AS top,
    arg_max(category, s_first) AS legacy_embedding_category, max(s_first) AS top_first
  FROM similarity GROUP BY {key}),
embedding_result AS (
  SELECT {key}, embedding_category, CASE WHEN top > 0.8 THEN least(top + 0.1, 1) ELSE top END AS embedding_confidence,
    legacy_embedding_category, top_first AS legacy_embedding_confidence
  FROM nearest)"""


def _centroids(spark, sf_dir):
    return cen.label_centroids(labelled_vectors(spark, sf_dir), "category")


def centroids(spark, sf_dir):
    return _centroids(spark, sf_dir).select(
        "category", F.posexplode("centroid").alias("i", "m")).select(
        "category", F.col("i").cast("bigint").alias("i"), F.round("m", 6).alias("m"))


def centroid_similarity(spark, sf_dir):
    rows = cen.similarity_rows(
        labelled_vectors(spark, sf_dir), _centroids(spark, sf_dir), list(CATEGORIES),
        ["embedding", "variant"], "vec_id", "category")
    return rows.select("vec_id", "category", F.round("similarity", 6).alias("similarity"))


def _nearest(spark, sf_dir, variants, boost):
    known = labelled_vectors(spark, sf_dir).drop("category")
    done = cen.classify(known, _centroids(spark, sf_dir), list(CATEGORIES), variants, "category", boost)
    return done.select(
        "vec_id", "embedding_category", F.round("embedding_confidence", 6).alias("embedding_confidence"))


def centroid_classify(spark, sf_dir):
    return _nearest(spark, sf_dir, ["embedding", "variant"], True)


def legacy_centroid_classify(spark, sf_dir):
    return _nearest(spark, sf_dir, ["embedding"], False)


def cosine_pairs(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    left = vectors.select("vec_id", F.col("embedding").alias("a"))
    right = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return cen.cosine_pairs(left.join(right, "vec_id"), "a", "b").select(
        "vec_id", F.round("cosine", 6).alias("cosine"))


# --- ensemble and routing --------------------------------------------------------------

def _with_verdict(prompts):
    key = F.col("prompt_id")
    raw = fill(VERDICT_FORMS, F.floor(key / 7), {
        "C": pick(CATEGORIES, key), "F": pick(("0.95", "0.85", "0.7", "0.6", "0.4", "0.1"), F.floor(key / 3)),
        "T": escaped(F.col("text")), "R": F.col("text")})
    return prompts.withColumn("raw", raw)


_VERDICT_ROWS = f"""recorded AS (
  SELECT prompt_id AS request_id, text AS query, {sql_fill(VERDICT_FORMS, 'prompt_id // 7', {
      'C': sql_pick(CATEGORIES, 'prompt_id'),
      'F': sql_pick(("0.95", "0.85", "0.7", "0.6", "0.4", "0.1"), 'prompt_id // 3'),
      'T': sql_escaped('text'), 'R': 'text'})} AS raw FROM prompts)"""


def _classified(spark, sf_dir):
    prompts = _with_verdict(prompt_vectors(spark, sf_dir, chat_prompts(spark, sf_dir)))
    return router.classify(
        prompts, centroids=_centroids(spark, sf_dir), categories=list(CATEGORIES),
        variants=["embedding", "variant"], verdict_raw="raw")


def _sql_case(key: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


ENSEMBLE_SQL = f"""{CHAT_PROMPTS}, {FEATURES}, {RULE_SQL}, {LEGACY_SQL}, {CENTROID_SQL}, {PROMPT_VECTORS},
{_COSINES.format(key='prompt_id', source='prompt_vectors')}, {_VERDICT_ROWS}, {classifier_sql('recorded')},
three AS (
  SELECT p.prompt_id, rule_category AS rc, rule_confidence AS rf, embedding_category AS ec, embedding_confidence AS ef,
    coalesce(verdict_category, embedding_category) AS lc,
    CASE WHEN verdict_category IS NULL THEN embedding_confidence ELSE verdict_confidence END AS lf,
    legacy_category AS kc, legacy_confidence AS kf, legacy_embedding_category AS gc, legacy_embedding_confidence AS gf
  FROM prompts p JOIN rule_result USING (prompt_id) JOIN legacy_result USING (prompt_id)
    JOIN embedding_result USING (prompt_id) JOIN verdict_result v ON v.request_id = p.prompt_id),
chosen AS (
  SELECT *, CASE WHEN lf >= 0.8 THEN 1 WHEN lf >= 0.6 AND (ec = lc OR rc = lc) THEN 2 WHEN lf >= 0.6 THEN 3
    WHEN ef >= 0.8 THEN 4 WHEN rf >= 0.8 THEN 5 WHEN lf > greatest(ef, rf) THEN 6 WHEN ef > rf THEN 7 ELSE 8 END AS b
  FROM three),
combined AS (
  SELECT *, CASE WHEN b IN (1, 2, 3, 6) THEN lc WHEN b IN (4, 7) THEN ec ELSE rc END AS category,
    CASE WHEN b = 2 THEN least(lf + 0.1, 1) WHEN b IN (1, 3, 6) THEN lf WHEN b IN (4, 7) THEN ef ELSE rf END AS confidence,
    (['LLM (high confidence)', 'LLM (confirmed by other methods)', 'LLM (medium confidence)',
      'Embedding (high confidence)', 'Rule-based (high confidence)', 'LLM (best available)',
      'Embedding (best non-LLM)', 'Rule-based (fallback)'])[b] AS method
  FROM chosen),
routed AS (
  SELECT c.*, f.word_count, f.has_code_markers,
    CASE WHEN word_count < 5 THEN 'BASIC' WHEN word_count < 20 AND has_code_markers THEN 'INTERMEDIATE'
      WHEN word_count < 20 THEN 'BASIC' ELSE 'ADVANCED' END AS complexity_level,
    CASE WHEN has_code_markers THEN 'CODE'
      ELSE {_sql_case('category', RESPONSE_FORMATS, q(DEFAULT_FORMAT))} END AS response_format,
    concat_ws('|', CASE WHEN ec <> category AND ef >= 0.6 THEN ec END,
      CASE WHEN rc <> category AND rf >= 0.6 THEN rc END) AS secondary_categories,
    CASE WHEN confidence >= 0.6 THEN {_sql_case('category', SPECIALISED_MODELS, q(DEFAULT_MODEL))}
      ELSE {q(DEFAULT_MODEL)} END AS model
  FROM combined c JOIN flags f USING (prompt_id)),
systems AS (
  SELECT prompt_id, {q(BASE_INSTRUCTION)} || ' ' || {_sql_case('category', CATEGORY_INSTRUCTIONS, "''")}
    || {_sql_case('complexity_level', {k: ' ' + v for k, v in COMPLEXITY_INSTRUCTIONS.items()}, "''")} AS system_text
  FROM routed)"""


def _rounded(df, *columns):
    return df.select("prompt_id", *columns, "category", F.round("confidence", 6).alias("confidence"))


def ensemble_choice(spark, sf_dir):
    return _rounded(_classified(spark, sf_dir), "method")


def legacy_ensemble(spark, sf_dir):
    df = rules.classify_legacy(_normalized(spark, sf_dir, chat_prompts))
    df = prompt_vectors(spark, sf_dir, df)
    df = cen.classify(df, _centroids(spark, sf_dir), list(CATEGORIES), ["embedding"], "category", boost=False)
    return _rounded(ensemble.combine_legacy(df))


def _routed(spark, sf_dir):
    return router.route(_classified(spark, sf_dir))


def complexity_level(spark, sf_dir):
    return _routed(spark, sf_dir).select("prompt_id", "complexity_level")


def response_format(spark, sf_dir):
    return _routed(spark, sf_dir).select("prompt_id", "response_format")


def secondary_categories(spark, sf_dir):
    return _routed(spark, sf_dir).select(
        "prompt_id", F.array_join("secondary_categories", "|").alias("secondary_categories"))


def route_model(spark, sf_dir):
    return _routed(spark, sf_dir).select("prompt_id", "category", "model")


def route_by_table(spark, sf_dir):
    """Routing through a model table; the table maps every category seen in the vectors."""
    models = labelled_vectors(spark, sf_dir).groupBy("category").agg(
        F.concat(F.lit("model-"), F.max("vec_id").cast("string")).alias("model"))
    done = ensemble.with_model_table(_classified(spark, sf_dir), models)
    return done.select("prompt_id", "category", "model")


def system_prompts(spark, sf_dir):
    return _routed(spark, sf_dir).select("prompt_id", "system_text")


def category_report(spark, sf_dir):
    report = ensemble.category_report(_routed(spark, sf_dir), ["category", "method", "model"])
    return report.withColumn("mean_confidence", F.round("mean_confidence", 6)).withColumn("share", F.round("share", 9))


# --- end to end ------------------------------------------------------------------------


def _responses(spark, sf_dir):
    """The answer turn after each prompt as its response, with a recorded judge verdict."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    key = F.col("conv_id") * 1000 + F.col("turn") - 1
    judge = fill(JUDGE_FORMS, F.col("conv_id") + F.col("turn"), {
        "S": pick(("1", "2", "3", "4", "5"), F.col("conv_id")), "B": pick(("true", "false"), F.col("turn")),
        "T": escaped(F.col("text")), "R": F.col("text")})
    return turns.select(key.alias("prompt_id"), F.col("text").alias("response"), judge.alias("judge_raw"))


_RESPONSES = f"""responses AS (
  SELECT conv_id * 1000 + turn - 1 AS request_id, text AS response, {sql_fill(JUDGE_FORMS, 'conv_id + turn', {
      'S': sql_pick(("1", "2", "3", "4", "5"), 'conv_id'), 'B': sql_pick(("true", "false"), 'turn'),
      'T': sql_escaped('text'), 'R': 'text'})} AS raw
  FROM conversations WHERE role = 'assistant')"""


def route_end_to_end(spark, sf_dir):
    done = router.answer(_routed(spark, sf_dir), _responses(spark, sf_dir))
    return _rounded(done, "complexity_level", "response_format", "model", "response", "judge_status", "score",
                    "is_correct", "justification", "success", "error")


def request_table(spark, sf_dir):
    """Classification and answer requests of every routed prompt."""
    routed = _routed(spark, sf_dir)
    return requests.classification_requests(chat_prompts(spark, sf_dir)).unionByName(requests.answer_requests(routed))


QUERIES = {
    "rule_scores": rule_scores,
    "rule_classify": rule_classify,
    "legacy_rule_classify": legacy_rule_classify,
    "rules_by_table": rules_by_table,
    "centroids": centroids,
    "centroid_similarity": centroid_similarity,
    "centroid_classify": centroid_classify,
    "legacy_centroid_classify": legacy_centroid_classify,
    "cosine_pairs": cosine_pairs,
    "ensemble": ensemble_choice,
    "legacy_ensemble": legacy_ensemble,
    "complexity_level": complexity_level,
    "response_format": response_format,
    "secondary_categories": secondary_categories,
    "route_model": route_model,
    "route_by_table": route_by_table,
    "system_prompts": system_prompts,
    "category_report": category_report,
    "route_end_to_end": route_end_to_end,
    "request_table": request_table,
}

_DOC_RULES = f"WITH {DOCUMENT_PROMPTS}, {NORMALIZED}, {RULE_SQL}"
_DOC_VECTORS = f"WITH {CENTROID_SQL}, {_COSINES.format(key='vec_id', source='vectors')}"
_ENSEMBLE = f"WITH {ENSEMBLE_SQL}"

ORACLES = {
    "rule_scores": f"""{_DOC_RULES}
SELECT prompt_id, category, CAST(raw_score AS BIGINT) AS raw_score, round(raw_score / top, 6) AS normalized_score
FROM rule_scores""",
    "rule_classify": f"""{_DOC_RULES}
SELECT prompt_id, rule_category, round(rule_confidence, 6) AS rule_confidence FROM rule_result""",
    "rules_by_table": f"""WITH {DOCUMENT_PROMPTS}, {NORMALIZED}, {_OWN_RULE_SQL}, {LEGACY_SQL}
SELECT prompt_id, rule_raw_score::DOUBLE AS rule_raw_score, rule_category, round(rule_confidence, 6) AS rule_confidence,
  legacy_category, round(legacy_confidence, 6) AS legacy_confidence FROM rule_result JOIN legacy_result USING (prompt_id)""",
    "legacy_rule_classify": f"""WITH {DOCUMENT_PROMPTS}, {NORMALIZED}, {LEGACY_SQL}
SELECT prompt_id, legacy_category, round(legacy_confidence, 6) AS legacy_confidence FROM legacy_result""",
    "centroids": f"WITH {CENTROID_SQL} SELECT category, CAST(i - 1 AS BIGINT) AS i, round(m, 6) AS m FROM means",
    "centroid_similarity": f"{_DOC_VECTORS} SELECT vec_id, category, round(s, 6) AS similarity FROM similarity",
    "centroid_classify": f"""{_DOC_VECTORS}
SELECT vec_id, embedding_category, round(embedding_confidence, 6) AS embedding_confidence FROM embedding_result""",
    "legacy_centroid_classify": f"""{_DOC_VECTORS}
SELECT vec_id, legacy_embedding_category AS embedding_category,
  round(legacy_embedding_confidence, 6) AS embedding_confidence FROM embedding_result""",
    "cosine_pairs": """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
  CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "ensemble": f"{_ENSEMBLE} SELECT prompt_id, method, category, round(confidence, 6) AS confidence FROM combined",
    "legacy_ensemble": f"""{_ENSEMBLE}
SELECT prompt_id, CASE WHEN gf < 0.6 AND kf > gf THEN kc ELSE gc END AS category,
  round(CASE WHEN gf < 0.6 AND kf > gf THEN kf ELSE gf END, 6) AS confidence FROM three""",
    "complexity_level": f"{_ENSEMBLE} SELECT prompt_id, complexity_level FROM routed",
    "response_format": f"{_ENSEMBLE} SELECT prompt_id, response_format FROM routed",
    "secondary_categories": f"{_ENSEMBLE} SELECT prompt_id, secondary_categories FROM routed",
    "route_model": f"{_ENSEMBLE} SELECT prompt_id, category, model FROM routed",
    "route_by_table": f"""{_ENSEMBLE},
models AS (SELECT category, 'model-' || max(vec_id) AS model FROM vectors GROUP BY category)
SELECT prompt_id, category, CASE WHEN confidence >= 0.6 THEN coalesce(m.model, {q(DEFAULT_MODEL)})
  ELSE {q(DEFAULT_MODEL)} END AS model FROM routed r LEFT JOIN models m USING (category)""",
    "system_prompts": f"{_ENSEMBLE} SELECT prompt_id, system_text FROM systems",
    "category_report": f"""{_ENSEMBLE}
SELECT category, method, model, count(*) AS prompts, round(avg(confidence), 6) AS mean_confidence,
  round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share
FROM routed GROUP BY ALL""",
    "route_end_to_end": f"""{_ENSEMBLE}, {_RESPONSES}, {light_sql('responses')}
SELECT r.prompt_id, complexity_level, response_format, model, s.response, parse_status AS judge_status, score, is_correct,
  justification, s.response IS NOT NULL AS success,
  CASE WHEN s.response IS NULL THEN 'no recorded response' END AS error,
  category, round(confidence, 6) AS confidence
FROM routed r LEFT JOIN responses s ON s.request_id = r.prompt_id LEFT JOIN light_result l ON l.request_id = r.prompt_id""",
    "request_table": f"""{_ENSEMBLE}
SELECT 'classify:' || prompt_id || ':' || {q(DEFAULT_MODEL)} AS request_id, 'classify' AS kind, {q(DEFAULT_MODEL)} AS model,
  {q(requests.CLASSIFY_SYSTEM)} AS system_text,
  {q(requests.CLASSIFY_HEAD)} || text || {q(requests.CLASSIFY_TAIL)} AS user_text,
  0.0::DOUBLE AS temperature, 100 AS max_tokens FROM prompts
UNION ALL
SELECT 'answer:' || prompt_id || ':' || model, 'answer', model, system_text, text, 0.7::DOUBLE, 1000
FROM routed JOIN systems USING (prompt_id) JOIN prompts USING (prompt_id)""",
}
