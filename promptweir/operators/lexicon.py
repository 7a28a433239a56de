"""Lexicon building as set operations, and lexicon joins for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweir.functions import text as tx
from promptweir.operators import automata

ORIGINS = ("expansion", "preserved", "short", "plural", "acronym")


def base_terms(abbreviations: DataFrame, preserved: DataFrame) -> DataFrame:
    """Expansions, preserved terms and short forms; a term keeps its first origin."""
    parts = (
        abbreviations.select(F.col("expansion").alias("term"), F.lit(0).alias("rank"))
        .unionByName(preserved.select("term", F.lit(1).alias("rank")))
        .unionByName(abbreviations.select("term", F.lit(2).alias("rank")))
    )
    return parts.groupBy("term").agg(F.min("rank").alias("rank"))


def plurals(base: DataFrame) -> DataFrame:
    return base.where(~F.endswith("term", F.lit("s"))).select(F.concat("term", F.lit("s")).alias("term"))


def acronyms(base: DataFrame) -> DataFrame:
    """First letters of terms of two to four words."""
    words = tx.tokens(F.col("term"))
    return (
        base.where(F.contains("term", F.lit(" "))).select(words.alias("w")).where(F.size("w") <= 4)
        .select(F.lower(F.array_join(F.transform("w", lambda x: F.left(x, F.lit(1))), "")).alias("term"))
        .distinct()
    )


def build_lexicon(abbreviations: DataFrame, preserved: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """``(term, n_words, origin)``: base terms, their plurals and their acronyms.

    Plurals and acronyms come from the base terms only, never from each other.
    """
    base = base_terms(abbreviations, preserved)
    every = (
        base.unionByName(plurals(base).withColumn("rank", F.lit(3)))
        .unionByName(acronyms(base).withColumn("rank", F.lit(4)))
        .groupBy("term").agg(F.min("rank").alias("rank"))
    )
    if exclude is not None:
        every = every.join(exclude.select("term").distinct(), "term", "left_anti")
    origin = F.element_at(F.array(*[F.lit(o) for o in ORIGINS]), F.col("rank") + 1)
    return every.select("term", F.size(tx.tokens(F.col("term"))).alias("n_words"), origin.alias("origin"))


def lexicon_sizes(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("origin").agg(
        F.count(F.lit(1)).alias("terms"), F.sum((F.col("n_words") > 1).cast("int")).alias("multi_word"))


def top_terms(lexicon: DataFrame, k: int) -> DataFrame:
    """The first ``k`` terms in alphabetical order."""
    return lexicon.orderBy("term").limit(k)


def expand_by_join(prompts: DataFrame, abbreviations: DataFrame, key: str = "prompt_id", text: str = "text") -> DataFrame:
    """Token expansion against an abbreviation table of any size, one row per prompt.

    Same result as ``features.normalize`` with the table as literals; a NULL text becomes empty. Texts stay
    where they are and meet the table block by block, see ``automata``.
    """
    path, blocks = automata.write_blocks(abbreviations.select("term", "expansion"), "abbreviations", ["term"])
    spaced = prompts.select(F.col(key), F.coalesce(tx.spaced(F.lower(F.col(text))), F.lit("")).alias("_spaced"))
    found = automata.with_found(spaced, "_spaced", "_found", automata.EXPANSION, path, blocks, automata.expansion_finder)

    def expanded(token: Column, i: Column) -> Column:
        own = F.element_at("_at", i)
        return F.when(own.isNull(), token).otherwise(
            F.concat(own["expansion"], F.substring(token, own["chars"] + 1, F.char_length(token))))

    at = F.map_from_entries(F.transform("_found", lambda f: F.struct(f["i"], f)))
    return found.withColumn("_at", at).select(key, F.when(F.size("_found") == 0, F.col("_spaced")).otherwise(
        F.array_join(F.transform(F.split("_spaced", " "), expanded), " ")).alias("normalized_query"))


def terms_by_join(normalized: DataFrame, lexicon: DataFrame, key: str = "prompt_id", text: str = "normalized_query") -> DataFrame:
    """Key terms against a lexicon of any size; same result as the literal form, so a prompt
    without a hit has an empty array. Prompts with equal keys are one prompt.

    Texts stay where they are and meet the lexicon block by block, see ``automata``; only hits travel.
    """
    path, blocks = automata.write_blocks(lexicon.select("term", "n_words"), "terms", ["term"])
    found = automata.with_found(
        normalized.select(F.col(key), F.col(text).alias("_text")), "_text", "_hits", automata.HIT, path, blocks, automata.term_finder)
    first = found.select(key, F.explode_outer("_hits").alias("h")).groupBy(
        key, F.col("h.part").alias("part"), F.col("h.term").alias("term")).agg(F.min("h.i").alias("i"))
    hit = F.when(F.col("term").isNotNull(), F.struct("part", "i", "term"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias("hits")).select(
        key, F.transform("hits", lambda h: h["term"]).alias("key_terms"))
