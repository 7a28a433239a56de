"""Prepares a training corpus: quality, language, near copies, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `docs`. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweir.llm import langid, mixing, ngram_join, packing, quality
from promptweir.llm.common import remainder, table
from promptweir.llm.queries import ranks_path
from promptweir.session import written

#: A document stays if its likeliest language has at least this mean probability.
LANGUAGE_SCORE = 0.4
#: Ranks from here on belong to documents without an id.
NO_ID = 1 << 62


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of the quality classifier, which leaves the same
    documents out of training as its query does."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    return docs.where(quality.scores(model, F.col("text").cast("string")) >= quality.THRESHOLD)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told clearly. Where no document has a language to
    learn from, all stay."""
    model = langid.train(docs, remainder(F.col("doc_id"), 5) != 0)
    if model is None:
        return docs
    return docs.where(langid.predictions(model, F.col("text").cast("string"))["score"] >= LANGUAGE_SCORE)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), that with the
    smallest id; of repeated rows one. Documents without an id rank behind all others, by a hash of
    their text. The texts of an id stay together: all of them, if one is the smallest of its group."""
    ranked = docs.withColumn("__k_rank", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(
        F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))))
    marks = written(ngram_join.join(ranked, key="__k_rank").groupBy(F.col("doc_id").alias("__k_id")).agg(
        F.max("kept").alias("__k_keep"), F.count(F.lit(1)).alias("__k_n")).where("NOT __k_keep OR __k_n > 1"), "marks")
    both = ranked.join(marks, F.col("__k_rank") == F.col("__k_id"), "left")
    once = both.where("__k_n IS NULL").select(*docs.columns)
    again = both.where("__k_keep").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Rows of equal id, source and size share their
    copies evenly, what is left over by a hash of the text."""
    taken = mixing.mix(mixing.with_size(docs)).groupBy(
        F.col("doc_id").alias("__m_id"), F.col("source").alias("__m_source"), F.col("size").alias("__m_size")).agg(
        F.sum("copies").alias("__m_copies"), F.count(F.lit(1)).alias("__m_rows"))
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    both = docs.withColumn("__m_words", size).join(
        taken, F.expr("doc_id <=> __m_id AND source <=> __m_source AND __m_words = __m_size"))
    more = F.pmod(F.xxhash64("text"), F.col("__m_rows")) < F.col("__m_copies") % F.col("__m_rows")
    times = F.floor(F.col("__m_copies") / F.col("__m_rows")).cast("int") + more.cast("int")
    return both.where(times > 0).withColumn("__m_copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, ranks_path(), with_ids=False)).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_copies", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Learnt models and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
