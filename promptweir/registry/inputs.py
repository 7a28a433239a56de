"""Inputs of the registered queries, derived from whole tables, with their SQL twins.

The tables hold invented prose in which lexicon words hardly occur. Each prompt is
therefore a fixed opening, chosen by key, followed by the whole text of its row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweir.session import spread
from promptweir.sources.lexicons import CATEGORIES

OPENINGS: tuple[str, ...] = (
    "Sketch a small JS parser that ranks rows with ML",
    "Which tf layers suit deep learning on a laptop, in py?",
    "My loop for (k of items) { print(k); } throws an error, debug it",
    "Why do cities plant trees along their streets?",
    "My landlord breaks the contract: which legal steps can I take?",
    "Compare machine learning with deep learning for sensor data",
    "Compose a song and a poem about rain, then design its cover",
    "Outline a marketing strategy, a business plan and an email for a bakery",
    "Give me advice: should I move, and what do you recommend for a friend?",
    "Connect node.js to a nosql db (js) and document the \"api\"",
    "Analyze the survey: calculate means, solve the equation, list 37 results for the study",
    "Set up continuous integration with docker, k8s and Jenkins, see http://example.net",
    "wrap our APIs",
    "",
    "Hello",
    "Teach me how volcanoes work and help me understand rocks",
    "Vue.js or React for the front-end, 90% <i>mobile</i> users @work",
    "Is a database algorithm patent-able? Read www.example.net first",
    "Try PyTorch\tand TensorFlow for unit testing of pandas code",
    "your opinion: need help with art, music and a math problem",
)

USER_ID = "CAST(conv_id % 17 AS VARCHAR)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are about to be worked on, dealt out if the session asks for it."""
    return spread(table(spark, sf_dir, name), int(spark.conf.get("spark.promptweir.spread", "0")))


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values, index: str) -> str:
    return f"({sql_list(values)})[1 + ({index}) % {len(values)}]"


# --- prompts -----------------------------------------------------------------------

def document_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("prompt_id"),
        F.concat(pick(OPENINGS, F.col("doc_id")), F.lit(" "), "text").alias("text"))


DOCUMENT_PROMPTS = f"""prompts AS (
  SELECT doc_id AS prompt_id, {sql_pick(OPENINGS, 'doc_id')} || ' ' || text AS text FROM documents)"""


def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns; short enough to reach every complexity level."""
    turns = texts(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"),
        F.concat(pick(OPENINGS, F.col("conv_id") + F.col("turn")), F.lit(" "), "text").alias("text"))


CHAT_PROMPTS = f"""prompts AS (
  SELECT conv_id * 1000 + turn AS prompt_id,
    {sql_pick(OPENINGS, 'conv_id + turn')} || ' ' || text AS text
  FROM conversations WHERE role = 'user')"""


# --- labelled vectors ----------------------------------------------------------------

def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        "vec_id", "embedding", F.reverse("embedding").alias("variant"),
        pick(CATEGORIES, F.col("label")).alias("category"))


LABELLED_VECTORS = f"""vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding,
    CAST(list_reverse(embedding) AS DOUBLE[]) AS variant, {sql_pick(CATEGORIES, 'label')} AS category
  FROM embeddings)"""


def prompt_vectors(spark: SparkSession, sf_dir: str, prompts: DataFrame) -> DataFrame:
    """Prompts with a recorded vector each, found by an equi-join on a derived key."""
    vectors = labelled_vectors(spark, sf_dir)
    size = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()
    keyed = prompts.withColumn("vec_id", F.pmod(F.col("prompt_id") * 7, size))
    return keyed.join(vectors.select("vec_id", "embedding", "variant"), "vec_id").drop("vec_id")


PROMPT_VECTORS = """prompt_vectors AS (
  SELECT p.prompt_id, v.embedding, v.variant FROM prompts p
  JOIN vectors v ON v.vec_id = (p.prompt_id * 7) % (SELECT count(*) FROM embeddings))"""


# --- recorded model outputs ------------------------------------------------------------

def escaped(text: Column) -> Column:
    """Text as the inside of a JSON string; the tables hold no other control characters."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def sql_escaped(text: str) -> str:
    return (f"replace(replace(replace(replace({text}, '\\', '\\\\'), '\"', '\\\"'), "
            "chr(10), '\\n'), chr(9), '\\t')")


# Parts: C category, F confidence, T the row's own text (escaped), R the same unescaped.
VERDICT_FORMS: tuple[str, ...] = (
    '{"category": "C", "confidence": F, "reasoning": "T"}',
    '<think>maybe {"category": "no"} R</think> {"category": "C", "confidence": F, "reasoning": "T"}',
    ' Sure: {"category": "c", "confidence": F} R',
    '{"category": "C", "confidence": F, "reasoning": "T',
    '{"category": "C, I think", "confidence": 1.7, "reasoning": "T"}',
    '{"category": "COOKING", "confidence": -0.5} R',
    '{"category": "C", "confidence": null, "reasoning": "T"}',
    '{"category": ["C"], "confidence": F}',
    'R',
    '{"confidence": "F", "reasoning": "T"}',
    '{"Category": "x", "category": "legal BUSINESS", "confidence": F,} R',
    '{"category": "C", "reasoning": "T"} trailing',
    '{"category": "C" "confidence": 1.2.3} R',
    '{"category": "C", "confidence": "0.9d"}',
    '[1, 2] R',
    '[1, 2]',
    '{"category": "C", "confidence": "high", "reasoning": "T"}',
    '{"category": "Science MATHEMATICAL", "confidence": true}',
    '<think>no end {"category": "C", "confidence": F, "reasoning": "T"}',
    '{"category": "COOKING", "confidence": F, "category": "C", "reasoning": "T", "confidence": 0.55}',
    '{"category": "C", "confidence": NaN, "reasoning": "T"}',
    '{"category": ["C"], "category": "C", "confidence": -Infinity, "reasoning": "NaN T"}',
    '{"category": "C", "confidence": F, "confidence": null, "reasoning": "T"}',
    '{"category": "C", "category": "C", "confidence": F, "reasoning": "T",}',
)

# Parts: S score, B boolean, T and R as above.
JUDGE_FORMS: tuple[str, ...] = (
    '{"score": S, "accuracy": S, "completeness": 4, "clarity": 3.5, "is_correct": B, "justification": "T"}',
    '<think>R</think>{"score": "S", "accuracy": S, "completeness": 4, "clarity": 3, "is_correct": B, "justification": "T"} ok',
    '{"score": S, "justification": "T", "is_correct": B}',
    'Result: {"score": S, "justification": "T"}',
    '{"score": S, "justification": "T"',
    '{"score": S, "justification": "T",} {R}',
    'R',
    '[S, 2]',
    '"S"',
    'S',
    'null',
    '{"is_correct": B, "justification": "T"}',
    '<think>a</think><think>R</think> {"score": S, "accuracy": 1, "completeness": 2, "clarity": 3, "is_correct": B, "justification": null}',
    '{"score": S, "accuracy": 1, "completeness": 2, "clarity": 3, "is_correct": B, "justification": "T"} }',
    '{"score": 1, "accuracy": S, "completeness": 4, "clarity": 2.5, "is_correct": B, "justification": "R", "score": S, "weight": NaN, "justification": "T"}',
    '{"score": S, "score": 3, "is_correct": B, "is_correct": false, "justification": "T"}',
    '{"score": S, "justification": "T", "weights": [NaN, -Infinity]}',
    '[NaN, S]',
    'Infinity',
)

ANSWER_FORMS: tuple[str, ...] = (
    '<think>R</think>\nAnswer: R',
    '<think>open R',
    'R\nAnswer:  R ',
    '  R  ',
    '<think>a</think> R <think>a</think> R <think>b</think>',
    'Answer: R Answer: R',
)


def marked(form: str, letters: str) -> str:
    """The form with its parts marked, so that filling in one leaves the texts alone."""
    return re.sub(rf"\b([{letters}])\b", r"^~\1^~", form)


def fill(forms: tuple[str, ...], index: Column, parts: dict[str, Column]) -> Column:
    form = pick([marked(f, "".join(parts)) for f in forms], index)
    for letter, value in parts.items():
        form = F.replace(form, F.lit(f"^~{letter}^~"), value)
    return form


def sql_fill(forms: tuple[str, ...], index: str, parts: dict[str, str]) -> str:
    form = sql_pick([marked(f, "".join(parts)) for f in forms], index)
    for letter, value in parts.items():
        form = f"replace({form}, '^~{letter}^~', {value})"
    return form
