"""Normalisation and features of whole-text prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptweir.functions import text as tx
from promptweir.operators import features
from promptweir.registry.inputs import (
    CHAT_PROMPTS, DOCUMENT_PROMPTS, chat_prompts, document_prompts, q, sql_list,
)
from promptweir.sources.lexicons import (
    ABBREVIATIONS, ACTION_VERBS, PRESERVED_TERMS, QUESTION_WORDS, TECH_GROUPS, Lexicon, full_terms,
)

SQL_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACE_LITERAL = " || ".join(f"chr({ord(c)})" for c in tx.SPACE_CHARS)
_WORD_LIST = f"list_filter(string_split_regex(lower(trim(text, {_SPACE_LITERAL})), '{SQL_SPACE}+'), lambda x: x <> '')"
_CLEAN = f"regexp_replace(%s, '{tx.NOT_WORD}', '', 'g')"

NORMALIZED = f"""
abbreviations(term, expansion) AS (VALUES {', '.join(f'({q(k)}, {q(v)})' for k, v in ABBREVIATIONS.items())}),
cut AS (SELECT prompt_id, {_WORD_LIST} AS toks FROM prompts),
tok AS (SELECT prompt_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM cut),
cleaned AS (SELECT *, {_CLEAN % 't'} AS c FROM tok),
joined AS (
  SELECT prompt_id, string_agg(CASE WHEN a.expansion IS NULL THEN t
    ELSE a.expansion || substring(t, length(c) + 1) END, ' ' ORDER BY i) AS n
  FROM cleaned LEFT JOIN abbreviations a ON a.term = c GROUP BY prompt_id),
normalized AS (
  SELECT p.prompt_id, p.text, coalesce(j.n, '') AS normalized_query FROM prompts p LEFT JOIN joined j USING (prompt_id))
"""

TERMS_SQL = f"""
words AS (
  SELECT prompt_id, w, i, {_CLEAN % 'w'} AS c FROM (
    SELECT prompt_id, unnest(string_split(normalized_query, ' ')) AS w,
      generate_subscripts(string_split(normalized_query, ' '), 1) AS i FROM normalized)
  WHERE w <> ''),
term_list AS (SELECT unnest({sql_list(full_terms(ABBREVIATIONS, PRESERVED_TERMS))}) AS term),
hits AS (
  SELECT w.prompt_id, 0 AS part, min(w.i) AS i, term FROM words w JOIN term_list ON term = w.c
  WHERE NOT contains(term, ' ') GROUP BY w.prompt_id, term
  UNION ALL
  SELECT n.prompt_id, 1, 0, term FROM normalized n JOIN term_list ON contains(n.normalized_query, term)
  WHERE contains(term, ' ')),
grouped AS (
  SELECT prompt_id, string_agg(term, '|' ORDER BY part, i, term) AS key_terms, count(*) AS n_terms
  FROM hits GROUP BY prompt_id),
terms AS (
  SELECT n.prompt_id, coalesce(key_terms, '') AS key_terms, coalesce(n_terms, 0) AS n_terms
  FROM normalized n LEFT JOIN grouped USING (prompt_id)),
verbs AS (
  SELECT n.prompt_id, coalesce(string_agg(w, '|' ORDER BY i), '') AS action_verbs
  FROM normalized n LEFT JOIN words w ON w.prompt_id = n.prompt_id AND w.w IN ({', '.join(map(q, ACTION_VERBS))})
  GROUP BY n.prompt_id)
"""

_GROUPS = ", ".join(
    f"({i}, {q(g)}, {q(t)})" for i, (g, ts) in enumerate(TECH_GROUPS.items()) for t in ts)
CATEGORY_SQL = f"""
tech_groups(ord, tech_group, entry) AS (VALUES {_GROUPS}),
tech_scores AS (
  SELECT prompt_id, ord, tech_group, count(DISTINCT term) AS score
  FROM hits JOIN tech_groups ON contains(entry, term) GROUP BY ALL),
tech_best AS (
  SELECT prompt_id, arg_min(tech_group, ord - 1000 * score) AS tech_group FROM tech_scores GROUP BY prompt_id),
tech AS (
  SELECT n.prompt_id, coalesce(tech_group, 'general') AS primary_tech_category
  FROM normalized n LEFT JOIN tech_best USING (prompt_id))
"""

FLAGS_SQL = f"""
word_counts AS (
  SELECT n.prompt_id, count(w.w) AS word_count,
    count(w.w) FILTER (w.w IN ({', '.join(map(q, QUESTION_WORDS))})) AS question_words
  FROM normalized n LEFT JOIN words w USING (prompt_id) GROUP BY n.prompt_id),
flags AS (
  SELECT n.prompt_id, regexp_matches(normalized_query, '[{{}}()\\[\\];]') AS has_code_markers,
    regexp_matches(normalized_query, '[<>@#$%^&*]') AS has_special_chars, word_count,
    length(normalized_query) AS char_count, regexp_matches(normalized_query, '\\p{{Nd}}') AS has_numbers,
    contains(normalized_query, 'http://') OR contains(normalized_query, 'https://')
      OR contains(normalized_query, 'www.') AS has_urls,
    question_words, CASE WHEN word_count > 0 THEN round(n_terms / word_count, 6) ELSE 0.0::DOUBLE END AS tech_density
  FROM normalized n JOIN word_counts USING (prompt_id) JOIN terms USING (prompt_id))
"""

FEATURES = f"{NORMALIZED}, {TERMS_SQL}, {CATEGORY_SQL}, {FLAGS_SQL}"
_FLAG_COLUMNS = (
    "has_code_markers", "has_special_chars", "word_count", "char_count", "has_numbers", "has_urls", "question_words")


def _preprocessed(spark, sf_dir, source=document_prompts):
    return features.preprocess(source(spark, sf_dir))


def _flags(prefix):
    counts = ("word_count", "char_count", "question_words")
    return [
        (F.col(f"{prefix}.{c}").cast("bigint") if c in counts else F.col(f"{prefix}.{c}")).alias(c)
        for c in _FLAG_COLUMNS
    ] + [F.round(f"{prefix}.tech_density", 6).alias("tech_density")]


def normalize(spark, sf_dir):
    lexicon = Lexicon()
    return features.with_normalized(document_prompts(spark, sf_dir), lexicon).select("prompt_id", "normalized_query")


def tech_keywords(spark, sf_dir):
    return _preprocessed(spark, sf_dir).select("prompt_id", F.array_join("key_terms", "|").alias("key_terms"))


def action_verbs(spark, sf_dir):
    return _preprocessed(spark, sf_dir).select("prompt_id", F.array_join("action_verbs", "|").alias("action_verbs"))


def complexity_flags(spark, sf_dir):
    return _preprocessed(spark, sf_dir).select("prompt_id", *_flags("features.complexity"))


def tech_category(spark, sf_dir):
    return _preprocessed(spark, sf_dir).select("prompt_id", "features.primary_tech_category")


def features_full(spark, sf_dir):
    done = _preprocessed(spark, sf_dir, chat_prompts)
    return done.select(
        "prompt_id", "normalized_query", F.array_join("key_terms", "|").alias("key_terms"),
        F.array_join("action_verbs", "|").alias("action_verbs"), *_flags("features.complexity"),
        "features.has_tech_terms", F.col("features.tech_term_count").cast("bigint").alias("tech_term_count"),
        "features.primary_tech_category")


QUERIES = {
    "normalize": normalize,
    "tech_keywords": tech_keywords,
    "action_verbs": action_verbs,
    "complexity_flags": complexity_flags,
    "tech_category": tech_category,
    "features_full": features_full,
}

_FLAG_LIST = ", ".join((*_FLAG_COLUMNS, "tech_density"))
ORACLES = {
    "normalize": f"WITH {DOCUMENT_PROMPTS}, {NORMALIZED} SELECT prompt_id, normalized_query FROM normalized",
    "tech_keywords": f"WITH {DOCUMENT_PROMPTS}, {NORMALIZED}, {TERMS_SQL} SELECT prompt_id, key_terms FROM terms",
    "action_verbs": f"WITH {DOCUMENT_PROMPTS}, {NORMALIZED}, {TERMS_SQL} SELECT prompt_id, action_verbs FROM verbs",
    "complexity_flags": f"WITH {DOCUMENT_PROMPTS}, {FEATURES} SELECT prompt_id, {_FLAG_LIST} FROM flags",
    "tech_category": f"WITH {DOCUMENT_PROMPTS}, {FEATURES} SELECT prompt_id, primary_tech_category FROM tech",
    "features_full": f"""WITH {CHAT_PROMPTS}, {FEATURES}
SELECT prompt_id, normalized_query, key_terms, action_verbs, {_FLAG_LIST}, n_terms > 0 AS has_tech_terms,
  n_terms AS tech_term_count, primary_tech_category
FROM normalized JOIN terms USING (prompt_id) JOIN verbs USING (prompt_id) JOIN flags USING (prompt_id)
  JOIN tech USING (prompt_id)""",
}
