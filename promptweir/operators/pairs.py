"""From chat documents or flat turns to one row per answered user prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.functions import text as tx
from promptweir.operators import numbering
from promptweir.session import written

PAIR_COLUMNS = (
    "userId", "query_number", "title", "modelId", "user_query", "user_timestamp",
    "LLM_answer", "answer_timestamp", "PromptTokens", "CompletionTokens", "LatencyMS", "Cost",
)
TURN_BLOCK = 1024


def has_role(role: Column, name: str) -> Column:
    """Role test that ignores case; a missing role matches nothing."""
    return F.lower(F.coalesce(role, F.lit(""))) == name


def date_text(timestamp: Column, as_struct: bool) -> Column:
    """The ``$date`` text of a timestamp object; anything but an object gives NULL."""
    return timestamp["$date"] if as_struct else F.get_json_object(timestamp, "$['$date']")


def _struct_dates(docs: DataFrame) -> bool:
    """True when timestamps were read as structs, False when read as JSON text."""
    return isinstance(docs.schema["messages"].dataType.elementType["timestamp"].dataType, T.StructType)


def content_text(content: Column) -> Column:
    return tx.strip(F.coalesce(content, F.lit("")))


def flatten_turns(docs: DataFrame) -> DataFrame:
    """One row per message with its position; documents without messages vanish."""
    header = [c for c in docs.columns if c != "messages"]
    # The outer form keeps Spark from inferring a filter on the array. Pushed down, such
    # a filter computes the array a second time when it is not a stored column.
    turns = docs.select(*header, F.posexplode_outer("messages").alias("pos", "message")).where("pos is not null")
    dates = _struct_dates(docs)
    return turns.select(
        *header, "pos",
        F.lower(F.coalesce("message.role", F.lit(""))).alias("role"),
        content_text(F.col("message.content")).alias("content"),
        date_text(F.col("message.timestamp"), dates).alias("ts"),
        F.col("message.metadata.promptTokens").alias("prompt_tokens"),
        F.col("message.metadata.completionTokens").alias("completion_tokens"),
        F.col("message.metadata.latencyMs").alias("latency_ms"),
        F.col("message.metadata.cost").alias("cost"),
    )


def _answer_positions(messages: Column) -> Column:
    """1-based positions of assistant messages, in order."""
    spots = F.transform(messages, lambda m, i: F.when(has_role(m["role"], "assistant"), i + 1))
    return F.filter(spots, lambda p: p.isNotNull())


def pair_documents(docs: DataFrame) -> DataFrame:
    """Each user turn with the nearest later answer of its document, no shuffle.

    The answers cut a message list into stretches, and every user turn of a stretch
    shares the answer that ends it. Turns after the last answer lie in no stretch.
    ``nth`` numbers the answered turns of the document from zero.
    """
    header = [c for c in docs.columns if c != "messages"]
    dates = _struct_dates(docs)

    def asked(cut: Column) -> Column:
        stretch = F.slice("messages", cut["begin"], cut["end"] - cut["begin"])
        placed = F.transform(stretch, lambda m, i: F.struct((cut["begin"] - 1 + i).alias("pos"), m.alias("m")))
        users = F.filter(placed, lambda t: has_role(t["m"]["role"], "user"))
        return F.transform(users, lambda t: F.struct(
            t["pos"].alias("pos"), t["m"].alias("asked"),
            F.element_at("messages", cut["end"]).alias("answer")))

    cuts = F.transform(F.col("_ends"), lambda end, i: F.struct(
        F.when(i == 0, F.lit(1)).otherwise(F.get(F.col("_ends"), i - 1) + 1).alias("begin"),
        end.alias("end")))
    matched = (
        docs.withColumn("_ends", _answer_positions(F.col("messages")))
        .withColumn("_cuts", cuts)
        .select(*header, F.posexplode_outer(F.flatten(F.transform("_cuts", asked))).alias("nth", "_p"))
        .where("nth is not null")
    )
    return matched.select(
        *header, "nth",
        F.col("_p.pos").alias("pos"),
        content_text(F.col("_p.asked.content")).alias("user_query"),
        date_text(F.col("_p.asked.timestamp"), dates).alias("user_timestamp"),
        content_text(F.col("_p.answer.content")).alias("LLM_answer"),
        date_text(F.col("_p.answer.timestamp"), dates).alias("answer_timestamp"),
        F.col("_p.answer.metadata.promptTokens").alias("PromptTokens"),
        F.col("_p.answer.metadata.completionTokens").alias("CompletionTokens"),
        F.col("_p.answer.metadata.latencyMs").alias("LatencyMS"),
        F.col("_p.answer.metadata.cost").alias("Cost"),
    )


def extract_pairs(docs: DataFrame) -> DataFrame:
    """The 12-column pair table, plus ``doc_seq`` and ``pos``.

    ``query_number`` counts a user's answered prompts across documents, by ``doc_seq`` (NULL last),
    then by document, then by position. Documents are paired inside their row, so only pairs
    travel to be numbered.
    """
    pairs = pair_documents(docs.withColumn("_doc", F.monotonically_increasing_id()))
    return numbering.running_number(pairs, "userId", ["doc_seq", "_doc", "pos"], "query_number").select(
        "doc_seq", "pos", *PAIR_COLUMNS)


def pair_turns(
    turns: DataFrame, doc: str, pos: str, role: str, answer: Column, block: int = TURN_BLOCK
) -> DataFrame:
    """Flat form of the same match: user turns with ``answer`` taken from the nearest
    later assistant turn of the document, NULL when there is none. An assistant turn without
    text answers with the empty text. ``pos`` is the place of a turn in its document.

    The look-ahead runs inside blocks of ``block`` positions; a turn whose answer lies
    beyond its block takes the first answer of the next block that has one. A document
    of any length is therefore spread over many tasks.
    """
    answer = F.coalesce(answer, F.lit("")) if turns.select(answer).dtypes[0][1] == "string" else answer
    is_answer = has_role(F.col(role), "assistant")
    cut = turns.withColumn("_block", F.floor(F.col(pos) / block))
    # Descending order turns the look-ahead into a running frame, which Spark
    # evaluates in one pass; a frame that ends at the partition's end is rescanned per row.
    ahead = Window.partitionBy(doc, "_block").orderBy(F.col(pos).desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    near = cut.withColumn("_near", F.last(F.when(is_answer, answer), ignorenulls=True).over(ahead))

    later = Window.partitionBy("_d").orderBy(F.col("_b").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    first_answers = (
        cut.groupBy(F.col(doc).alias("_d"), F.col("_block").alias("_b"))
        .agg(F.min_by(F.when(is_answer, answer), F.when(is_answer, F.col(pos))).alias("_first"))
        .withColumn("_far", F.last("_first", ignorenulls=True).over(later))
        .where("_far is not null")
        .select("_d", "_b", "_far")
    )
    return (
        near.where(has_role(F.col(role), "user"))
        .join(first_answers, (F.col(doc) == F.col("_d")) & (F.col("_block") == F.col("_b")), "left")
        .withColumn("answer", F.coalesce("_near", "_far"))
        .drop("_block", "_near", "_d", "_b", "_far")
    )


def split_rejects(pairs: DataFrame, question: str = "user_query", answer: str = "LLM_answer") -> DataFrame:
    """Rows with a ``reject_reason``; NULL marks a row that may be judged."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return pairs.withColumn(
        "reject_reason",
        F.when(empty(question) | empty(answer), "question and answer must be non-empty"))


def exact_medians(rows: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The lower median of a column per group, NULL values left out.

    Values are counted first. Each group's distinct values are cut into ranges, and the
    running counts of ranges lead to the one value, so no task orders a whole group.
    """
    keys = [F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")).alias(f"_{g}") for g in group]
    names = [f"_{g}" for g in group]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = [*[F.col(n) for n in names], F.col(value)]
    ranged = written(counts.select("*", *keys).repartitionByRange(*placed).withColumn("_part", F.spark_partition_id()), "values")
    totals = ranged.groupBy(*names, "_part").agg(F.sum("_n").alias("_all"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    middle = totals.select(
        *names, "_part", "_all", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"),
        F.ceil(F.sum("_all").over(Window.partitionBy(*names)) / 2).alias("_want")).where(
        "_before < _want AND _want <= _before + _all").drop("_all")
    inside = Window.partitionBy(*names, "_part").orderBy(value)
    found = ranged.join(middle, [*names, "_part"]).withColumn("_until", F.col("_before") + F.sum("_n").over(inside))
    return found.where("_until >= _want AND _until - _n < _want").select(*group, F.col(value).alias(out))


def usage_report(rows: DataFrame, group: list[str]) -> DataFrame:
    """Token, latency and cost totals per group; partial sums shrink the shuffle."""
    medians = exact_medians(rows, group, "LatencyMS", "median_latency_ms").select(
        *[F.col(g).alias(f"_{g}") for g in group], "median_latency_ms")
    sums = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("answers"),
        F.sum("PromptTokens").alias("prompt_tokens"),
        F.sum("CompletionTokens").alias("completion_tokens"),
        F.avg("LatencyMS").alias("mean_latency_ms"),
        F.max("LatencyMS").alias("max_latency_ms"),
        F.sum("Cost").alias("cost"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return sums.join(medians, same, "left").drop(*[f"_{g}" for g in group])
