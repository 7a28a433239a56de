"""Prompt normalisation and lexicon features as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweir.functions import text as tx
from promptweir.sources.lexicons import NO_TECH_GROUP, Lexicon


def _strings(values) -> Column:
    """Constant string array; folded when the plan is optimised."""
    return F.split(F.lit("\n".join(values)), "\n")


def expand_tokens(spaced: Column, abbreviations: dict[str, str]) -> Column:
    """Replace known abbreviations; what follows the cleaned length of the token stays.

    Most tokens are no abbreviation. The hashed membership test spares them the
    linear search of the literal map.
    """
    table = F.map_from_arrays(_strings(abbreviations), _strings(abbreviations.values()))
    keys = list(abbreviations)

    def expand(token: Column, clean: Column) -> Column:
        tail = F.substring(token, F.char_length(clean) + 1, F.char_length(token))
        return F.when(clean.isin(keys), F.concat(F.element_at(table, clean), tail)).otherwise(token)

    return F.zip_with(F.split(spaced, " "), tx.clean_tokens(spaced), expand)


def key_terms(normalized: Column, lexicon: Lexicon) -> Column:
    """Single-word hits in order of first use, then multi-word hits in alphabetical order."""
    single = F.array_intersect(tx.clean_tokens(normalized), _strings(lexicon.single_terms))
    # Every multi-word term holds a blank and its second word; one regex pass settles
    # whether any term can occur at all.
    seconds = sorted({re.escape(t.split(" ")[1]) for t in lexicon.multi_terms})
    multi = F.when(
        normalized.rlike(f" (?:{'|'.join(seconds)})"),
        F.filter(_strings(lexicon.multi_terms), lambda term: F.contains(normalized, term)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(single, multi)


def verb_hits(words: Column, lexicon: Lexicon) -> Column:
    """Action verbs by exact token, in order, repeats kept."""
    return F.filter(words, lambda w: w.isin(list(lexicon.verbs)))


def tech_category(terms: Column, lexicon: Lexicon) -> Column:
    """Technology group with most hits; a term counts when a group entry contains it."""
    def hits(group: tuple[str, ...]) -> Column:
        return F.size(F.filter(terms, lambda k: F.exists(_strings(group), lambda entry: F.contains(entry, k))))

    scores = F.array(*[
        F.struct(
            hits(group).alias("score"),
            F.lit(-order).alias("rank"),
            F.lit(name).alias("name"))
        for order, (name, group) in enumerate(lexicon.tech_groups.items())
    ])
    best = F.array_max(scores)
    return F.when(best["score"] > 0, best["name"]).otherwise(NO_TECH_GROUP)


def complexity(words: Column, normalized: Column, terms: Column, lexicon: Lexicon) -> Column:
    n_words = F.size(words)
    return F.struct(
        normalized.rlike(r"[{}()\[\];]").alias("has_code_markers"),
        normalized.rlike(r"[<>@#$%^&*]").alias("has_special_chars"),
        n_words.alias("word_count"),
        F.char_length(normalized).alias("char_count"),
        normalized.rlike(r"\p{Nd}").alias("has_numbers"),
        normalized.rlike(r"https?://|www\.").alias("has_urls"),
        F.size(F.filter(words, lambda w: w.isin(list(lexicon.question_words)))).alias("question_words"),
        F.when(n_words > 0, F.size(terms) / n_words).otherwise(F.lit(0.0)).alias("tech_density"),
    )


def with_normalized(prompts: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    spaced = prompts.withColumn("_spaced", tx.spaced(F.lower(F.col(text))))
    expanded = F.array_join(expand_tokens(F.col("_spaced"), lexicon.abbreviations), " ")
    return spaced.withColumn("normalized_query", expanded).drop("_spaced")


def with_words(prompts: DataFrame) -> DataFrame:
    """Tokens of the normalised text; expansions may hold several words."""
    return prompts.withColumn("words", F.filter(F.split("normalized_query", " "), lambda w: w != ""))


def preprocess(prompts: DataFrame, lexicon: Lexicon | None = None, text: str = "text") -> DataFrame:
    """Adds normalized_query, key_terms, action_verbs and the features struct.

    Each step is its own projection, so that no higher-order function runs twice. A NULL
    prompt is kept as a row with ``error`` set.
    """
    lexicon = lexicon or Lexicon()
    normalized = F.col("normalized_query")
    steps = with_words(with_normalized(prompts, lexicon, text))
    steps = steps.withColumn("key_terms", key_terms(normalized, lexicon))
    steps = steps.withColumn("action_verbs", verb_hits(F.col("words"), lexicon))
    steps = steps.withColumn("_complexity", complexity(F.col("words"), normalized, F.col("key_terms"), lexicon))
    features = F.struct(
        F.col("key_terms").alias("tech_keywords"),
        F.col("action_verbs").alias("action_verbs"),
        F.col("_complexity.word_count").alias("word_count"),
        F.col("_complexity").alias("complexity"),
        (F.size("key_terms") > 0).alias("has_tech_terms"),
        F.size("key_terms").alias("tech_term_count"),
        tech_category(F.col("key_terms"), lexicon).alias("primary_tech_category"),
    )
    return (
        steps.withColumn("features", features)
        .withColumn("error", F.when(F.col(text).isNull(), "prompt text is missing"))
        .drop("words", "_complexity")
    )

