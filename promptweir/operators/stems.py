"""Words of token lists, and the synonym sets of their stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def token_words(texts: DataFrame, tokens: str, least: int) -> DataFrame:
    """The words of a token list that are stemmed."""
    # explode_outer: see pairs.flatten_turns.
    longer = F.filter(tokens, lambda w: F.char_length(w) >= least)
    return texts.select(F.explode_outer(F.array_distinct(longer)).alias("word")).where("word IS NOT NULL")


def synonym_sets(texts: DataFrame, key: str, stems: Column, synonyms: DataFrame, salts: int = SALTS) -> DataFrame:
    """``key``, and of the text with that key ``sets``: array<struct<stem, sets>> of the stems that are in a
    synonym set. Texts without any have no row.

    synonyms: word, set_id. Only the distinct stems of a text travel, once each. A frequent one occurs in many
    texts: they are spread over ``salts`` copies of its entry, so no task receives them all.
    """
    forms = texts.select(key, F.explode_outer(F.array_distinct(stems)).alias("form")).where("form IS NOT NULL")
    salted = forms.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    sets = synonyms.groupBy(F.col("word").alias("form")).agg(F.collect_set("set_id").alias("sets"))
    found = salted.join(sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["form", "salt"])
    return found.groupBy(key).agg(F.collect_list(F.struct(F.col("form").alias("stem"), "sets")).alias("sets"))
