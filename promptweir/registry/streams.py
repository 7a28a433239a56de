"""Stream jobs run over the data at hand; each equals its batch statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptweir.registry.classification import RULE_SQL
from promptweir.operators.pairs import content_text
from promptweir.registry.inputs import CHAT_PROMPTS, OPENINGS, pick, q, sql_pick, table
from promptweir.registry.prompts import FEATURES, NORMALIZED
from promptweir.registry.classification import _sql_case
from promptweir.sources.lexicons import DEFAULT_MODEL, SPECIALISED_MODELS
from promptweir.streaming import pairing, prompts, runs

#: Turns that come without a time.
NO_TIME_SQL = "conv_id % 9 = 4 AND pos = 1"
_START = "2024-01-01 00:00:00"
LATENESS = "30 seconds"


def stream_classify(spark, sf_dir):
    """Rule classification and routing of user turns as they arrive."""
    turns = runs.source(spark, sf_dir, "conversations.parquet").where("role = 'user'")
    arriving = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"),
        F.concat(pick(OPENINGS, F.col("conv_id") + F.col("turn")), F.lit(" "), "text").alias("text"))
    routed = prompts.routed_stream(arriving).select(
        "prompt_id", "category", F.round("confidence", 6).alias("confidence"), "complexity_level", "model")
    return runs.run_available(routed, "stream-classify")


def _timed_turns(spark, sf_dir):
    """Conversations start a minute apart; their turns follow every ten seconds."""
    turns = runs.source(spark, sf_dir, "conversations.parquet")
    seconds = F.col("conv_id") * 60 + F.col("turn") * 10
    return turns.select(
        "conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"),
        (F.col("conv_id") % 17).cast("string").alias("user_id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(_START)) + seconds).alias("ts"))


def _turn_keys(spark, sf_dir):
    """Turns whose content is their key, so that state holds no texts; some have no time."""
    turns = _timed_turns(spark, sf_dir).withColumn("content", F.concat_ws(":", "conv_id", "pos"))
    return turns.withColumn("ts", F.when(~F.expr(NO_TIME_SQL), F.col("ts")))


def stream_pairs(spark, sf_dir):
    """Pairs whose turns the watermark has passed, numbered per user within the stream; texts are
    found by the keys of the turns."""
    keyed = _timed_turns(spark, sf_dir).withColumn("content", F.concat_ws(":", "conv_id", "pos"))
    numbered = pairing.numbered_fates(keyed, LATENESS, timeout_ms=3_600_000)
    done = runs.run_available(numbered, "stream-pairs", keyed_state=True, partition_by=("status",))
    texts = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("key"), content_text(F.col("text")).alias("text"))
    side = lambda key, name: texts.select(F.col("key").alias(key), F.col("text").alias(name))
    pairs = done.where("status = 'paired'").withColumnsRenamed({"user_query": "asked", "llm_answer": "said"})
    return _plain_times(pairs.join(side("asked", "user_query"), "asked").join(side("said", "llm_answer"), "said").select(
        *pairing.NUMBERED_NAMES))


def stream_fates(spark, sf_dir):
    """Every turn of a stream by what became of it: settled, rejected, or still waiting."""
    settled = runs.run_available(
        pairing.fates(_turn_keys(spark, sf_dir), LATENESS, timeout_ms=15_000), "stream-fates", keyed_state=True,
        partition_by=("status",))
    rejected = runs.run_available(pairing.dead_letters(_turn_keys(spark, sf_dir)), "dead-letters")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"))
    own = F.when(F.col("status").isin("paired", "timed_out") | F.col("answer_pos").isNull(), F.col("user_query")).otherwise(F.col("llm_answer"))
    known = settled.select(own.alias("key"), "status", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select(F.col("content").alias("key"), F.lit("rejected").alias("status"), F.col("reject_reason").alias("reason")))
    return turns.join(known, "key", "left").groupBy(F.coalesce("status", F.lit("waiting")).alias("status"), "reason").agg(
        F.count(F.lit(1)).alias("turns"))


def stream_category_windows(spark, sf_dir):
    """Rule categories of user events per hour; events carry the event time, and the
    opening stands for what the user asked."""
    events = runs.source(spark, sf_dir, "events.parquet")
    arriving = events.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(
        pick(OPENINGS, F.col("event_id")), F.lit(" "), "event_type", F.lit(" "), "props").alias("text"))
    counted = prompts.category_windows(prompts.routed_stream(arriving), "ts", "1 hour", LATENESS)
    done = runs.run_available(counted.withColumn("mean_confidence", F.round("mean_confidence", 6)), "stream-windows")
    return _plain_times(done)


def _plain_times(df):
    """Timestamps without zone, as the tables hold them."""
    return df.select(*[
        F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


QUERIES = {
    "stream_classify": stream_classify,
    "stream_pairs": stream_pairs,
    "stream_fates": stream_fates,
    "stream_category_windows": stream_category_windows,
}

_SLIM = f"{NORMALIZED}, {RULE_SQL}"
_EVENT_PROMPTS = f"""prompts AS (
  SELECT event_id AS prompt_id, {sql_pick(OPENINGS, 'event_id')} || ' ' || event_type || ' ' || props AS text FROM events)"""
ORACLES = {
    # Without a vector the rule result also fills the embedding slot.
    "stream_classify": f"""WITH {CHAT_PROMPTS}, {FEATURES}, {RULE_SQL}
SELECT prompt_id, rule_category AS category, round(rule_confidence, 6) AS confidence,
  CASE WHEN word_count < 5 THEN 'BASIC' WHEN word_count < 20 AND has_code_markers THEN 'INTERMEDIATE'
    WHEN word_count < 20 THEN 'BASIC' ELSE 'ADVANCED' END AS complexity_level,
  CASE WHEN rule_confidence >= 0.6 THEN {_sql_case('rule_category', SPECIALISED_MODELS, q(DEFAULT_MODEL))}
    ELSE {q(DEFAULT_MODEL)} END AS model
FROM rule_result JOIN flags USING (prompt_id)""",
    "stream_pairs": f"""WITH turns AS (
  SELECT conv_id, turn AS pos, role, text, CAST(conv_id % 17 AS VARCHAR) AS user_id,
    TIMESTAMP '{_START}' + to_seconds(conv_id * 60 + turn * 10) AS ts FROM conversations),
settled AS (
  SELECT * FROM turns WHERE role IN ('user', 'assistant')
    AND ts <= (SELECT max(ts) FROM turns WHERE role IN ('user', 'assistant')) - INTERVAL {LATENESS}),
ahead AS (
  SELECT *, min(CASE WHEN role = 'assistant' THEN pos END) OVER (
    PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer_pos FROM settled)
SELECT u.user_id, row_number() OVER (PARTITION BY u.user_id ORDER BY a.ts, CAST(u.conv_id AS VARCHAR), u.pos) AS query_number,
  CAST(u.conv_id AS VARCHAR) AS conv_id, u.pos, u.text AS user_query, u.ts AS user_ts, a.text AS llm_answer, a.ts AS answer_ts
FROM ahead u JOIN settled a ON a.conv_id = u.conv_id AND a.pos = u.answer_pos WHERE u.role = 'user'""",
    "stream_fates": f"""WITH turns AS (
  SELECT conv_id, turn AS pos, role, CASE WHEN NOT (conv_id % 9 = 4 AND turn = 1) THEN
    TIMESTAMP '{_START}' + to_seconds(conv_id * 60 + turn * 10) END AS ts FROM conversations),
mark AS (SELECT max(ts) - INTERVAL {LATENESS} AS mark FROM turns WHERE ts IS NOT NULL),
fit AS (SELECT * FROM turns, mark WHERE ts IS NOT NULL AND role IN ('user', 'assistant')),
ahead AS (
  SELECT *, min(CASE WHEN role = 'assistant' AND ts <= mark THEN ts END) OVER (
    PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer_ts FROM fit),
asked AS (
  SELECT *, answer_ts - ts <= INTERVAL 15 seconds AS paired FROM ahead WHERE role = 'user' AND ts <= mark),
told AS (
  SELECT conv_id, pos, CASE WHEN paired THEN 'paired' WHEN answer_ts IS NOT NULL OR ts + INTERVAL 15 seconds <= mark THEN 'timed_out'
    ELSE 'waiting' END AS status, NULL AS reason FROM asked
  UNION ALL
  SELECT conv_id, pos, CASE WHEN EXISTS (SELECT 1 FROM asked q WHERE q.paired AND q.conv_id = f.conv_id AND q.answer_ts = f.ts)
    THEN 'answer' ELSE 'unasked' END, NULL FROM fit f WHERE role = 'assistant' AND ts <= mark
  UNION ALL SELECT conv_id, pos, 'waiting', NULL FROM fit WHERE ts > mark
  UNION ALL SELECT conv_id, pos, 'rejected', CASE WHEN ts IS NULL THEN 'no time' ELSE 'other role' END
  FROM turns WHERE ts IS NULL OR role NOT IN ('user', 'assistant'))
SELECT status, reason, count(*) AS turns FROM told GROUP BY ALL""",
    "stream_category_windows": f"""WITH {_EVENT_PROMPTS}, {_SLIM},
closed AS (SELECT max(ts) - INTERVAL {LATENESS} AS mark FROM events)
SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end,
  rule_category AS category, count(*) AS prompts, round(avg(rule_confidence), 6) AS mean_confidence
FROM rule_result JOIN events ON event_id = prompt_id
WHERE time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT mark FROM closed) GROUP BY ALL""",
}
