"""The registered queries of this folder, thin over the operators, and their SQL twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweir.llm import (
    chat, embed_dedup, langid, lexical, lines, mixing, ngram_join, packing, quality, runs, sql, topk, urls, warc)
from promptweir.llm.common import table
from promptweir.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(chat.format_turns(turns))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", F.col("quality_held_out").alias("held_out"), F.col("quality_score").alias("score"),
                       F.col("quality_ok").alias("predicted"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), width=4, percent=85).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.with_size(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken(mixed).alias("taken"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), ranks_path(), with_ids=False)).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = langid.identify(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("lang_held_out").alias("held_out"), "language.lang_pred", "language.score")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, periodic from a place on in a tenth of the documents."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), edit=planted)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                              r["period"].cast("string"), F.lit("\n"))
    # Exact: of two exponents the one with the larger cross product is larger.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(
        r["length"].cast("decimal(20,0)") * a["period"] > a["length"].cast("decimal(20,0)") * r["period"], r).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_common_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_chat, op2_quality, op3_warc, op4_ngram_join, op5_mixing, op6_embed_dedup, op7_packing, op8_topk, op9_urls,
        op10_langid, op11_runs, op12_lines, op13_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": sql.OP1, "op3_warc": sql.OP3, "op4_ngram_join": sql.OP4, "op6_embed_dedup": sql.OP6,
            "op8_topk": sql.OP8, "op11_runs": sql.OP11, "op12_lines": sql.OP12, "op13_search": sql.OP13}
