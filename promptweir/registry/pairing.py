"""Chat documents to pair rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweir.operators import numbering, pairs
from promptweir.registry.inputs import pick, sql_pick, table, texts
from promptweir.session import shared_dir
from promptweir.sources import chats

# A document's lines act as the messages of a chat: several prompts per answer, mixed case,
# missing roles, answers without a prompt, prompts without an answer.
ROLES = ("user", "User", "assistant", "system", "", "user", "ASSISTANT")


def documents_as_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def message(line, i):
        timed = F.when(i % 5 != 4, F.struct(
            F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit("-"), i.cast("string")).alias("$date")))
        known = F.when((F.col("doc_id") + i) % 4 != 0, F.struct(
            i.cast("bigint").alias("promptTokens"), F.char_length(line).cast("bigint").alias("completionTokens"),
            (F.char_length(line) * 1.5).cast("double").alias("latencyMs"), (i * 0.25).cast("double").alias("cost")))
        role = F.nullif(pick(ROLES, i), F.lit(""))
        return F.struct(role.alias("role"), F.concat(F.lit(" "), line, F.lit(" ")).alias("content"),
                        timed.alias("timestamp"), known.alias("metadata"))

    return texts(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc_seq"),
        F.nullif("source", F.lit("src3")).alias("userId"),
        F.col("lang").alias("title"), F.concat(F.lit("model-"), "lang").alias("modelId"),
        F.transform(F.split("text", "\n"), message).alias("messages"))


_TURNS = f"""
lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
turns AS (
  SELECT doc_id AS doc_seq, nullif(source, 'src3') AS "userId", lang AS title, 'model-' || lang AS "modelId",
    pos, lower({sql_pick(ROLES, 'pos')}) AS role, trim(line, ' ' || chr(160) || chr(9) || chr(13)) AS content,
    CASE WHEN pos % 5 <> 4 THEN 't' || doc_id || '-' || pos END AS ts,
    (doc_id + pos) % 4 <> 0 AS known, length(line) AS n
  FROM lines),
meta AS (
  SELECT * EXCLUDE (known, n), CASE WHEN known THEN CAST(pos AS BIGINT) END AS prompt_tokens,
    CASE WHEN known THEN CAST(n AS BIGINT) END AS completion_tokens,
    CASE WHEN known THEN n * 1.5::DOUBLE END AS latency_ms, CASE WHEN known THEN pos * 0.25::DOUBLE END AS cost
  FROM turns),
ahead AS (
  SELECT *, min(CASE WHEN role = 'assistant' THEN pos END) OVER (
    PARTITION BY doc_seq ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer_pos
  FROM meta),
pairs AS (
  SELECT u.doc_seq, u.pos, u."userId", u.title, u."modelId", u.content AS user_query, u.ts AS user_timestamp,
    a.content AS "LLM_answer", a.ts AS answer_timestamp, a.prompt_tokens AS "PromptTokens",
    a.completion_tokens AS "CompletionTokens", a.latency_ms AS "LatencyMS", a.cost AS "Cost"
  FROM ahead u JOIN meta a ON a.doc_seq = u.doc_seq AND a.pos = u.answer_pos
  WHERE u.role = 'user'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY "userId" ORDER BY doc_seq, pos) AS query_number FROM pairs)
"""

_NUMBERED_COLUMNS = """doc_seq, CAST(pos AS BIGINT) AS pos, "userId", CAST(query_number AS BIGINT) AS query_number,
  title, "modelId", user_query, user_timestamp, "LLM_answer", answer_timestamp, "PromptTokens",
  "CompletionTokens", "LatencyMS", "Cost" """


def turn_flatten(spark, sf_dir):
    turns = pairs.flatten_turns(documents_as_chats(spark, sf_dir))
    return turns.withColumn("pos", F.col("pos").cast("bigint"))


def pair_extract(spark, sf_dir):
    rows = pairs.pair_documents(documents_as_chats(spark, sf_dir))
    return rows.withColumn("pos", F.col("pos").cast("bigint")).drop("nth")


def _numbered(docs):
    return pairs.extract_pairs(docs).withColumn("pos", F.col("pos").cast("bigint"))


def pair_numbering(spark, sf_dir):
    return _numbered(documents_as_chats(spark, sf_dir))


def pair_rejects(spark, sf_dir):
    judged = pairs.split_rejects(_numbered(documents_as_chats(spark, sf_dir)))
    return judged.groupBy("modelId", "reject_reason").agg(F.count(F.lit(1)).alias("rows"))


def usage_by_model(spark, sf_dir):
    rows = pairs.pair_documents(documents_as_chats(spark, sf_dir))
    return pairs.usage_report(rows, ["modelId", "userId"])


def chat_json_scan(spark, sf_dir):
    """Chats written as JSON lines, read back with the declared schema, then paired."""
    path = shared_dir(spark, "chats")
    documents_as_chats(spark, sf_dir).write.json(path)
    return _numbered(chats.read_chats(spark, path, layout="lines", order_column="doc_seq"))


def chat_array_scan(spark, sf_dir):
    """Chats written as files of one JSON array each, of at most 100 documents."""
    path = shared_dir(spark, "chats")
    docs = documents_as_chats(spark, sf_dir)
    arrays = docs.groupBy(F.floor(F.col("doc_seq") / 100).alias("file")).agg(
        F.collect_list(F.to_json(F.struct(*docs.columns))).alias("docs"))
    arrays.select(F.concat(F.lit("["), F.array_join("docs", ","), F.lit("]")).alias("value")).write.option(
        "maxRecordsPerFile", 1).text(path)
    return _numbered(chats.read_chats(spark, path, layout="array", order_column="doc_seq"))


def pair_csv_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "pairs")
    chats.write_pairs_csv(_numbered(documents_as_chats(spark, sf_dir)), path)
    return chats.read_pairs_csv(spark, path)


def _threads(spark, sf_dir):
    """Two conversations woven into one thread, so that prompts wait for a shared answer."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.floor(F.col("conv_id") / 2).alias("thread"), (F.col("turn") * 2 + F.col("conv_id") % 2).alias("pos"),
        (F.col("conv_id") % 17).cast("string").alias("user_id"), "role", "text")


def thread_pairs(spark, sf_dir):
    matched = pairs.pair_turns(_threads(spark, sf_dir), "thread", "pos", "role", F.col("text"), block=4)
    return matched.select("thread", "pos", "user_id", F.col("text").alias("user_query"), F.col("answer").alias("llm_answer"))


def thread_numbering(spark, sf_dir):
    matched = pairs.pair_turns(_threads(spark, sf_dir), "thread", "pos", "role", F.lit(True), block=4).where("answer")
    return numbering.running_number(
        matched.select("user_id", "thread", "pos"), "user_id", ["thread", "pos"], "query_number")


_THREADS = """
threads AS (
  SELECT conv_id // 2 AS thread, turn * 2 + conv_id % 2 AS pos, CAST(conv_id % 17 AS VARCHAR) AS user_id, role, text
  FROM conversations),
ahead AS (
  SELECT *, min(CASE WHEN role = 'assistant' THEN pos END) OVER (
    PARTITION BY thread ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer_pos
  FROM threads)
"""

QUERIES = {
    "turn_flatten": turn_flatten,
    "pair_extract": pair_extract,
    "pair_numbering": pair_numbering,
    "pair_rejects": pair_rejects,
    "usage_by_model": usage_by_model,
    "chat_json_scan": chat_json_scan,
    "chat_array_scan": chat_array_scan,
    "pair_csv_roundtrip": pair_csv_roundtrip,
    "thread_pairs": thread_pairs,
    "thread_numbering": thread_numbering,
}

ORACLES = {
    "turn_flatten": f"""WITH {_TURNS}
SELECT doc_seq, "userId", title, "modelId", CAST(pos AS BIGINT) AS pos, role, content, ts, prompt_tokens,
  completion_tokens, latency_ms, cost FROM meta""",
    "pair_extract": f"""WITH {_TURNS}
SELECT doc_seq, CAST(pos AS BIGINT) AS pos, "userId", title, "modelId", user_query, user_timestamp, "LLM_answer",
  answer_timestamp, "PromptTokens", "CompletionTokens", "LatencyMS", "Cost" FROM pairs""",
    "pair_numbering": f"WITH {_TURNS} SELECT {_NUMBERED_COLUMNS} FROM numbered",
    "pair_rejects": f"""WITH {_TURNS}
SELECT "modelId", CASE WHEN user_query = '' OR "LLM_answer" = '' THEN 'question and answer must be non-empty' END
  AS reject_reason, count(*) AS rows FROM pairs GROUP BY ALL""",
    "usage_by_model": f"""WITH {_TURNS}
SELECT "modelId", "userId", count(*) AS answers, CAST(sum("PromptTokens") AS BIGINT) AS prompt_tokens,
  CAST(sum("CompletionTokens") AS BIGINT) AS completion_tokens, avg("LatencyMS") AS mean_latency_ms,
  max("LatencyMS") AS max_latency_ms, quantile_disc("LatencyMS", 0.5) AS median_latency_ms, sum("Cost") AS cost
FROM pairs GROUP BY ALL""",
    "chat_json_scan": f"WITH {_TURNS} SELECT {_NUMBERED_COLUMNS} FROM numbered",
    "chat_array_scan": f"WITH {_TURNS} SELECT {_NUMBERED_COLUMNS} FROM numbered",
    "pair_csv_roundtrip": f"""WITH {_TURNS}
SELECT {_NUMBERED_COLUMNS.replace('doc_seq, CAST(pos AS BIGINT) AS pos, ', '')} FROM numbered""",
    "thread_pairs": f"""WITH {_THREADS}
SELECT u.thread, u.pos, u.user_id, u.text AS user_query, a.text AS llm_answer
FROM ahead u LEFT JOIN threads a ON a.thread = u.thread AND a.pos = u.answer_pos WHERE u.role = 'user'""",
    "thread_numbering": f"""WITH {_THREADS}
SELECT user_id, thread, pos, row_number() OVER (PARTITION BY user_id ORDER BY thread, pos) AS query_number
FROM ahead WHERE role = 'user' AND answer_pos IS NOT NULL""",
}
