"""Pairing and numbering, also where one chat or user holds nearly all rows."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.operators import numbering, pairs
from promptweir.sources import chats
from promptweir.streaming import pairing, runs


def brute(docs):
    """Row loop over documents in order."""
    counts, out = {}, []
    for doc in docs:
        messages = doc.get("messages") or []
        for i, m in enumerate(messages):
            if (m.get("role") or "").lower() != "user":
                continue
            answer = next((a for a in messages[i + 1:] if (a.get("role") or "").lower() == "assistant"), None)
            if answer is None:
                continue
            user = doc.get("userId")
            counts[user] = counts.get(user, 0) + 1
            stamp = m.get("timestamp")
            out.append((user, counts[user], (m.get("content") or "").strip(), (answer.get("content") or "").strip(),
                        stamp.get("$date") if isinstance(stamp, dict) else None,
                        (answer.get("metadata") or {}).get("promptTokens")))
    return out


DOCS = [
    {"userId": "u1", "title": "a", "modelId": "m", "messages": [
        {"role": "User", "content": " one ", "timestamp": {"$date": "2024"}}, {"role": "user", "content": "two"},
        {"role": "assistant", "content": "A", "metadata": {"promptTokens": 3}}, {"role": "user", "content": "tail"}]},
    {"title": "no user", "messages": [
        {"role": "system", "content": "s"}, {"role": "user", "content": "q,\"x\"\ny", "timestamp": "plain"},
        {"role": "ASSISTANT", "content": ""}]},
    {"userId": "u2", "messages": []},
    {"userId": "u1", "messages": [{"content": "?"}, {"role": "user", "content": "three"}, {"role": "assistant"}]},
    {"messages": [{"role": "user", "content": "n2"}, {"role": "assistant", "content": "B"}]},
    {"userId": "u3"},
]


def got(frame):
    rows = frame.orderBy("doc_seq", "pos").collect()
    return [(r.userId, r.query_number, r.user_query, r.LLM_answer, r.user_timestamp, r.PromptTokens) for r in rows]


def test_json_array_to_pairs(spark, tmp_path):
    (tmp_path / "chats.json").write_text(json.dumps(DOCS))
    docs = chats.read_chats(spark, str(tmp_path / "chats.json"))
    assert got(pairs.extract_pairs(docs)) == brute(DOCS)
    assert got(pairs.extract_pairs(docs.repartition(5))) == brute(DOCS)


def test_json_lines_and_csv_round_trip(spark, tmp_path):
    lines = [{**d, "seq": i} for i, d in enumerate(DOCS)]
    (tmp_path / "chats.jsonl").write_text("\n".join(map(json.dumps, lines)))
    docs = chats.read_chats(spark, str(tmp_path / "chats.jsonl"), layout="lines", order_column="seq")
    table = pairs.extract_pairs(docs)
    assert got(table) == brute(DOCS)
    chats.write_pairs_csv(table, str(tmp_path / "csv"))
    back = chats.read_pairs_csv(spark, str(tmp_path / "csv"))
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, back.collect()), key=key) == sorted(
        map(tuple, table.select(*chats.PAIR.fieldNames()).collect()), key=key)


def test_one_chat_holds_most_turns(spark):
    """A long stretch without an answer crosses many blocks."""
    turns = spark.range(5000).select(
        F.when(F.col("id") < 4500, 0).otherwise(F.col("id")).alias("doc"), F.col("id").alias("pos"),
        F.when(F.col("id").isin(0, 1700, 4499, 4700), "assistant").otherwise("user").alias("role"))
    matched = pairs.pair_turns(turns, "doc", "pos", "role", F.col("pos"), block=64)
    rows = {r.pos: r.answer for r in matched.collect()}
    assert len(rows) == 4996
    for pos, answer in rows.items():
        expected = 1700 if pos < 1700 else 4499 if pos < 4499 else None
        assert answer == expected, pos


def test_one_user_holds_most_rows(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.lit(None)).alias("user"),
        F.floor(F.col("id") / 37).alias("doc"), F.col("id").alias("pos"))
    numbered = numbering.running_number(rows, "user", ["doc", "pos"], "n")
    by_user = {}
    for r in sorted(numbered.collect(), key=lambda r: (r.doc, r.pos)):
        by_user.setdefault(r.user, []).append(r.n)
    assert set(by_user) == {"hot", None} and sum(map(len, by_user.values())) == 6000
    assert all(ns == list(range(1, len(ns) + 1)) for ns in by_user.values())


def test_sparse_keys_of_one_user(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("user"), (F.col("id") * 987_654_321).alias("ms"))
    got = numbering.running_number(rows.repartition(7), "user", ["ms"], "n").collect()
    assert all(r.n == r.ms // 987_654_321 + 1 for r in got) and len(got) == 5000


def test_equal_and_missing_document_keys(spark):
    chat = lambda text: [("user", text, None, None), ("assistant", "a " + text, None, None)]
    docs = spark.createDataFrame(
        [("u", "t", "m", chat("late"), None), ("u", "t", "m", chat("x"), 5), ("u", "t", "m", chat("y"), 5), ("u", "t", "m", chat("first"), 0)],
        T.StructType([*chats.CHAT.fields, T.StructField("doc_seq", T.LongType())]))
    rows = {r.user_query: r.query_number for r in pairs.extract_pairs(docs).collect()}
    assert rows["first"] == 1 and rows["late"] == 4 and {rows["x"], rows["y"]} == {2, 3}


def test_answer_without_text_is_the_answer(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "assistant", "later")], "doc int, pos int, role string, text string")
    assert [r.answer for r in pairs.pair_turns(turns, "doc", "pos", "role", F.col("text")).collect()] == [""]


def test_medians_are_exact(spark):
    rows = spark.range(200_001).select(
        F.when(F.col("id") % 3 == 0, "a").alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    got = {r.g: r.m for r in pairs.exact_medians(rows, ["g"], "v", "m").collect()}
    values = {"a": [], None: []}
    for i in range(200_001):
        values["a" if i % 3 == 0 else None].append(float(i * 7919 % 200_003))
    assert got == {g: sorted(v)[(len(v) - 1) // 2] for g, v in values.items()}


def test_rejects_and_usage(spark):
    frame = spark.createDataFrame([("q", "a"), ("", "a"), ("q", None)], "user_query string, LLM_answer string")
    assert [r.reject_reason is None for r in pairs.split_rejects(frame).collect()] == [True, False, False]


def test_stream_pairs_of_one_user_are_spread_and_counted_on(spark, tmp_path):
    """Most pairs belong to no user; they are numbered in several tasks, on from earlier calls."""
    def arriving(first, last):
        return spark.range(first, last, 1, 8).select(
            F.col("id").cast("string").alias("conv_id"), F.lit(0).cast("bigint").alias("pos"),
            F.when(F.col("id") % 10 == 0, "u").alias("user_id"), F.lit("q").alias("user_query"),
            F.timestamp_seconds("id").alias("user_ts"), F.lit("a").alias("llm_answer"),
            F.lit(1).cast("bigint").alias("answer_pos"), F.timestamp_seconds(F.col("id") + 1).alias("answer_ts"))

    numbered = pairing.NumberedPairs(str(tmp_path / "numbers"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # these rows are few; Spark would put them together
    spark.conf.set(name, "false")
    numbered(arriving(0, 3000), 0)
    spark.conf.unset(name)
    first = numbered.rows(spark).where("user_id IS NULL")
    assert first.select(F.input_file_name()).distinct().count() > 4
    numbered(arriving(3000, 3500), 1)
    numbered(arriving(3000, 5000), 1)
    numbered(arriving(5000, 5000), 2)
    numbered(arriving(5000, 5010), 3)
    by_user = {}
    for r in sorted(numbered.rows(spark).collect(), key=lambda r: int(r.conv_id)):
        by_user.setdefault(r.user_id, []).append(r.query_number)
    assert by_user == {"u": list(range(1, 502)), None: list(range(1, 4510))}


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(7).write.parquet(f"{tmp_path}/u.parquet")
    stream = runs.source(spark, str(tmp_path), "t.parquet")
    assert sorted(r.id for r in runs.run_available(stream, "many-files").collect()) == list(range(100))
