"""Lexicon building on term tables drawn from the data, and lexicon joins on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptweir.operators import lexicon as lex
from promptweir.registry.inputs import DOCUMENT_PROMPTS, document_prompts, table
from promptweir.registry.prompts import NORMALIZED, TERMS_SQL
from promptweir.sources import lexicons


def _frames(spark, sf_dir):
    """Part names as expansions of their brands' short forms; places and segments as
    terms that stay as they are."""
    part = table(spark, sf_dir, "part")
    short = F.lower(F.concat(F.regexp_replace("p_brand", "[^0-9A-Za-z]", ""), F.lit("-"), F.left("p_type", F.lit(2))))
    abbreviations = part.select(short.alias("term"), F.lower("p_name").alias("expansion"))
    preserved = (
        table(spark, sf_dir, "nation").select(F.lower("n_name").alias("term"))
        .union(table(spark, sf_dir, "region").select(F.lower("r_name")))
        .union(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment")))
        .union(table(spark, sf_dir, "supplier").select(F.lower("s_name")))
        .union(part.select(F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand"))))
    )
    return abbreviations, preserved


_BASE = """
raw AS (
  SELECT lower(p_name) AS term, 0 AS r FROM part
  UNION ALL SELECT lower(n_name), 1 FROM nation
  UNION ALL SELECT lower(r_name), 1 FROM region
  UNION ALL SELECT lower(c_mktsegment), 1 FROM customer
  UNION ALL SELECT lower(s_name), 1 FROM supplier
  UNION ALL SELECT lower(p_type || ' ' || p_name || ' ' || p_brand), 1 FROM part
  UNION ALL SELECT lower(regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g') || '-' || p_type[1:2]), 2 FROM part),
base AS (SELECT term, min(r) AS r FROM raw GROUP BY term),
acronyms AS (
  SELECT array_to_string(list_transform(string_split(term, ' '), lambda w: w[1:1]), '') AS term
  FROM base WHERE contains(term, ' ') AND len(string_split(term, ' ')) <= 4),
lexicon AS (
  SELECT term, len(string_split(term, ' ')) AS n_words,
    (['expansion', 'preserved', 'short', 'plural', 'acronym'])[1 + min(r)] AS origin
  FROM (SELECT term, r FROM base UNION ALL SELECT term || 's', 3 FROM base WHERE NOT ends_with(term, 's')
        UNION ALL SELECT term, 4 FROM acronyms)
  GROUP BY term)
"""


def lexicon_build(spark, sf_dir):
    return lex.build_lexicon(*_frames(spark, sf_dir)).withColumn("n_words", F.col("n_words").cast("bigint"))


def lexicon_plurals(spark, sf_dir):
    return lex.plurals(lex.base_terms(*_frames(spark, sf_dir)))


def lexicon_acronyms(spark, sf_dir):
    return lex.acronyms(lex.base_terms(*_frames(spark, sf_dir)))


def lexicon_sizes(spark, sf_dir):
    return lex.lexicon_sizes(lex.build_lexicon(*_frames(spark, sf_dir)))


def lexicon_top(spark, sf_dir):
    return lex.top_terms(lexicon_build(spark, sf_dir), 20)


def expand_by_join(spark, sf_dir):
    return lex.expand_by_join(document_prompts(spark, sf_dir), lexicons.abbreviation_frame(spark))


def terms_by_join(spark, sf_dir):
    prompts = expand_by_join(spark, sf_dir)
    terms = lex.build_lexicon(lexicons.abbreviation_frame(spark), lexicons.term_frame(spark))
    return lex.terms_by_join(prompts, terms).select("prompt_id", F.array_join("key_terms", "|").alias("key_terms"))


QUERIES = {
    "lexicon_build": lexicon_build,
    "lexicon_plurals": lexicon_plurals,
    "lexicon_acronyms": lexicon_acronyms,
    "lexicon_sizes": lexicon_sizes,
    "lexicon_top": lexicon_top,
    "expand_by_join": expand_by_join,
    "terms_by_join": terms_by_join,
}

ORACLES = {
    "lexicon_build": f"WITH {_BASE} SELECT * FROM lexicon",
    "lexicon_plurals": f"WITH {_BASE} SELECT term || 's' AS term FROM base WHERE NOT ends_with(term, 's')",
    "lexicon_acronyms": f"WITH {_BASE} SELECT DISTINCT term FROM acronyms",
    "lexicon_sizes": f"""WITH {_BASE}
SELECT origin, count(*) AS terms, count(*) FILTER (n_words > 1) AS multi_word FROM lexicon GROUP BY origin""",
    "lexicon_top": f"WITH {_BASE} SELECT * FROM lexicon ORDER BY term LIMIT 20",
    "expand_by_join": f"WITH {DOCUMENT_PROMPTS}, {NORMALIZED} SELECT prompt_id, normalized_query FROM normalized",
    "terms_by_join": f"""WITH {DOCUMENT_PROMPTS}, {NORMALIZED}, {TERMS_SQL}
SELECT prompt_id, key_terms FROM terms""",
}
