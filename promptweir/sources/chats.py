"""Chat documents, pair rows and recorded model outputs: schemas, readers, writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.sources import ranges

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    # Kept as text so that a timestamp which is not an object does not spoil the row.
    T.StructField("timestamp", T.StringType()),
    T.StructField("metadata", T.StructType([
        T.StructField("promptTokens", T.LongType()),
        T.StructField("completionTokens", T.LongType()),
        T.StructField("latencyMs", T.DoubleType()),
        T.StructField("cost", T.DoubleType()),
    ])),
])

CHAT = T.StructType([
    T.StructField("userId", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("modelId", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
])

PAIR = T.StructType([
    T.StructField("userId", T.StringType()),
    T.StructField("query_number", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("modelId", T.StringType()),
    T.StructField("user_query", T.StringType()),
    T.StructField("user_timestamp", T.StringType()),
    T.StructField("LLM_answer", T.StringType()),
    T.StructField("answer_timestamp", T.StringType()),
    T.StructField("PromptTokens", T.LongType()),
    T.StructField("CompletionTokens", T.LongType()),
    T.StructField("LatencyMS", T.DoubleType()),
    T.StructField("Cost", T.DoubleType()),
])


#: Bits of a document's place in its file; those above number the files.
RECORD_BITS = 40


def read_chats(
    spark: SparkSession, path: str, layout: str = "array", order_column: str | None = None
) -> DataFrame:
    """Chat documents with a ``doc_seq`` order column.

    ``layout="array"`` reads files that hold one JSON array (or one object); a large file is read in ranges
    by many tasks. ``layout="lines"`` reads one document per line, ``layout="whole"`` array files
    by Spark's own reader, each in one task, where one malformed document makes the whole file malformed
    and timestamps kept as text keep the blanks between their tokens.
    ``order_column`` names a BIGINT field that already orders the documents. Without it
    the order of documents within and across files is taken from the input itself.
    """
    schema = CHAT if order_column is None else T.StructType([*CHAT.fields, T.StructField(order_column, T.LongType())])
    if layout == "array":
        found = ranges.records(spark, path, ranges.ObjectsOfArray()).select(
            (F.shiftleft("file", RECORD_BITS) + F.col("record")).alias("_place"), F.from_json("body", schema).alias("doc"))
        docs = found.select("doc.*", "_place")
        if order_column is None:
            return docs.withColumnRenamed("_place", "doc_seq")
        docs = docs.drop("_place")
    else:
        docs = spark.read.schema(schema).option("multiLine", layout == "whole").json(path)
    if order_column is not None:
        return docs.withColumnRenamed(order_column, "doc_seq")
    return docs.withColumn("doc_seq", F.monotonically_increasing_id())


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    """Pair rows as CSV with header; quotes, commas and line breaks survive a re-read."""
    pairs.select(*PAIR.fieldNames()).write.mode("errorifexists").option("header", True).option(
        "quote", '"').option("escape", '"').option("emptyValue", '""').csv(path)


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pair rows written by ``write_pairs_csv``; a large file is read in ranges by many tasks, with line
    breaks inside quotes wherever a range begins.

    An empty CSV field reads as NULL; the two texts are never NULL in a pair row, so
    there it means the empty text.
    """
    found = ranges.records(spark, path, ranges.QuotedLines()).where("record > 0")  # the header
    row = F.from_csv("body", PAIR.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                     {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return found.select(row.alias("row")).select("row.*").fillna("", ["user_query", "LLM_answer"])


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pair rows as Parquet, the default sink."""
    pairs.select(*PAIR.fieldNames()).write.mode("errorifexists").parquet(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """The request table an outside client works off, one folder per request kind."""
    requests.write.mode("errorifexists").partitionBy("kind").parquet(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded model outputs ``(request_id, model_id, raw)``."""
    schema = T.StructType([
        T.StructField("request_id", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("raw", T.StringType()),
    ])
    return spark.read.schema(schema).parquet(path)


def latest_responses(responses: DataFrame, key: str = "request_id", time: str = "responded_at") -> DataFrame:
    """One response per request: of several the latest, if the table has a column ``time``, and among equally late ones
    that with the largest text."""
    value = [c for c in responses.columns if c != key]
    order = [*([time] if time in value else []), "raw"]
    last = responses.where("raw IS NOT NULL").groupBy(key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_last"))
    return last.select(key, "_last.*")


def join_responses(requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests with their recorded output; a request without one keeps NULL."""
    return requests.join(responses, key, "left")
