"""Request tables: what an outside client would send to a model, one row per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweir.operators.ensemble import lookup
from promptweir.sources.lexicons import (
    BASE_INSTRUCTION, CATEGORY_INSTRUCTIONS, COMPLEXITY_INSTRUCTIONS, DEFAULT_MODEL, REFERENCE_MODELS,
)

# --- fixed values: request texts and settings --------------------------------------
CLASSIFY_SYSTEM = "Respond only with JSON. No explanations, no thinking, just JSON."
CLASSIFY_HEAD = 'Classify this query into ONE category:\n\n    Query: "'
CLASSIFY_TAIL = '''"

    Categories:
    1. CODE_TECHNICAL - Programming/coding
    2. MATHEMATICAL_SCIENTIFIC - Math/science/analysis  
    3. EDUCATIONAL_ACADEMIC - Learning/teaching/explanations
    4. CREATIVE_ARTISTIC - Creative writing/art/design
    5. BUSINESS_PROFESSIONAL - Business/legal/professional
    6. CONVERSATIONAL_ADVICE - Personal advice/opinions

    Rules:
    - Legal questions (lawsuits, contracts) = BUSINESS_PROFESSIONAL
    - "What are benefits of..." = EDUCATIONAL_ACADEMIC
    - Programming help = CODE_TECHNICAL
    - Personal advice = CONVERSATIONAL_ADVICE

    Respond with JSON only. Be conservative with confidence (0.0-1.0):
    {"category": "CATEGORY_NAME", "confidence": 0.85, "reasoning": "Brief explanation of why this category was chosen"}'''

LIGHT_JUDGE_HEAD = """
        Please evaluate the following LLM response to a user query on a scale of 1-5:
        
        User Query: """
LIGHT_JUDGE_MIDDLE = "\n        LLM Response: "
LIGHT_JUDGE_TAIL = """
        
        Consider:
        - Relevance to the query
        - Accuracy of information
        - Clarity and helpfulness
        - Completeness of the answer
        
        Respond with a JSON object containing:
        - "score": integer from 1-5
        - "justification": explanation of your rating
        - "is_correct": boolean indicating if the response is factually correct
        """

FULL_JUDGE_SYSTEM = """You are an expert LLM evaluator. Examine every clause of the answer for constitutional correctness. \
For instance, if the answer says 'pineapple is blue and yellow,' you must mark that as wrong. \
I will give you a user’s question and an LLM-generated answer. \
Do NOT think or reason step-by-step out loud. Do NOT output any <think> or </think> tags.  \
Return ONLY a JSON object with exactly these keys (no extra text):
  "is_correct": <true/false>,
  "accuracy": <int 1–5>,
    - 1 = Contains major factual errors,
    2 = Mostly inaccurate,
    3 = Partially accurate with some errors,
    4 = Mostly accurate with minor errors,
    5 = Completely accurate.
  "completeness": <int 1–5>,
    1 = Completely incomplete,
    2 = Mostly incomplete,
    3 = Partially complete but missing key points,
    4 = Mostly complete but missing minor points,
    5 = Completely complete.
  "clarity": <int 1–5>,
    1 = Completely unclear,
    2 = Mostly unclear,
    3 = Partially clear but with some confusing parts,
    4 = Mostly clear but with minor confusion,
    5 = Completely clear and easy to understand.
  "score": <int 1–5>,
    - Combination of "accuracy", "completeness", and "clarity".
  "justification": "<three-sentence rationale>"
If any clause is factually wrong (for example, 'President executes state laws'), set "is_correct" to false. \
Format exactly as valid JSON, with no extra commentary."""

REFERENCE_SYSTEM = "You are a helpful, fact-focused assistant."
REFERENCE_HEAD = """You are a helpful, fact-focused assistant. \
You must strictly enclose your internal reasoning in <think>...</think>. \
Once your thinking is complete, immediately write the final answer on a **new line** \
starting with exactly: Answer: (no quotes). \
The answer must be full, clear, and independent of the reasoning. \
You MUST include an Answer: line. Do NOT stop after <think>. \
Respond only with <think>…</think> and then Answer: … Nothing else.

### User Question:
"""
REFERENCE_TAIL = """

### Format:
<think>Your internal reasoning...</think>
Answer: Your final answer here."""
FULL_JUDGE_HEAD, FULL_JUDGE_MIDDLE, FULL_JUDGE_TAIL = "### User Question:\n", "\n\n### LLM Answer:\n", "\n"
# Temperature and most tokens of each kind of request.
SETTINGS: dict[str, tuple[float, int | None]] = {
    "classify": (0.0, 100), "answer": (0.7, 1000), "light_judge": (0.3, None), "full_judge": (0.0, 250), "reference": (0.0, 200),
}


def system_text(category: Column, level: Column) -> Column:
    """Instruction text of a routed prompt."""
    return F.concat_ws(
        " ", F.lit(BASE_INSTRUCTION), lookup(category, CATEGORY_INSTRUCTIONS, None),
        lookup(level, COMPLEXITY_INSTRUCTIONS, None))


def _request(kind: str, key: Column, model: Column, system: Column, user: Column) -> Column:
    temperature, max_tokens = SETTINGS[kind]
    return F.struct(
        F.concat_ws(":", F.lit(kind), key.cast("string"), model).alias("request_id"),
        F.lit(kind).alias("kind"), model.alias("model"),
        system.alias("system_text"), user.alias("user_text"),
        F.lit(temperature).alias("temperature"), F.lit(max_tokens).cast("int").alias("max_tokens"))


def _rows(df: DataFrame, requests: list[Column]) -> DataFrame:
    return df.select(F.inline_outer(F.array(*requests)))


def classification_requests(prompts: DataFrame, key: str = "prompt_id", text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    user = F.concat(F.lit(CLASSIFY_HEAD), F.col(text), F.lit(CLASSIFY_TAIL))
    return _rows(prompts, [_request("classify", F.col(key), F.lit(model), F.lit(CLASSIFY_SYSTEM), user)])


def answer_requests(routed: DataFrame, key: str = "prompt_id", text: str = "text") -> DataFrame:
    system = system_text(F.col("category"), F.col("complexity_level"))
    return _rows(routed, [_request("answer", F.col(key), F.col("model"), system, F.col(text))])


def _reference_requests(key: str, question: str, models: tuple[str, ...]) -> list[Column]:
    text = F.concat(F.lit(REFERENCE_HEAD), F.col(question), F.lit(REFERENCE_TAIL))
    return [_request("reference", F.col(key), F.lit(m), F.lit(REFERENCE_SYSTEM), text) for m in models]


def reference_requests(pairs: DataFrame, key: str, question: str, models: tuple[str, ...] = REFERENCE_MODELS) -> DataFrame:
    """One reference answer per model, beside the key of its row."""
    asked = pairs.select(F.col(key).alias("_key"), F.inline_outer(F.array(*_reference_requests(key, question, models))))
    return asked.withColumnRenamed("_key", key)


def addressed(requests: DataFrame) -> DataFrame:
    """Requests with ``content_id``, the same for the same request whenever it is made: a digest of all that an
    answer depends on. Parts are told apart by their lengths, so keys and texts may hold anything."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
             ("kind", "request_id", "model", "system_text", "user_text", "temperature", "max_tokens")]
    sized = [F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return requests.withColumn("content_id", F.sha2(F.concat(*sized), 256))


def open_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The requests, each once, that no recorded response answers: what a further run has to ask.

    responses: content_id, raw. A response without text does not count as one.
    """
    once = addressed(requests).dropDuplicates(["content_id"])
    return once.join(responses.where("raw IS NOT NULL").select("content_id"), "content_id", "left_anti")


def evaluation_requests(
    pairs: DataFrame, key: str, question: str = "user_query", answer: str = "LLM_answer",
    judge_model: str = DEFAULT_MODEL, reference_models: tuple[str, ...] = REFERENCE_MODELS,
) -> DataFrame:
    """Light judge, full judge and one reference answer per reference model."""
    q, a, judge = F.col(question), F.col(answer), F.lit(judge_model)
    light = F.concat(F.lit(LIGHT_JUDGE_HEAD), q, F.lit(LIGHT_JUDGE_MIDDLE), a, F.lit(LIGHT_JUDGE_TAIL))
    full = F.concat(F.lit(FULL_JUDGE_HEAD), q, F.lit(FULL_JUDGE_MIDDLE), a, F.lit(FULL_JUDGE_TAIL))
    return _rows(pairs, [
        _request("light_judge", F.col(key), judge, F.lit(None).cast("string"), light),
        _request("full_judge", F.col(key), judge, F.lit(FULL_JUDGE_SYSTEM), full),
        *_reference_requests(key, question, reference_models),
    ])
