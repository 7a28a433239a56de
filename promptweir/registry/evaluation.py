"""Scoring recorded answers against reference answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptweir.operators import bleu, meteor, requests, rouge, sampling, stems, token_match, verdicts
from promptweir.plans import evaluation as plan
from promptweir.functions import porter
from promptweir.registry.inputs import (
    ANSWER_FORMS, JUDGE_FORMS, escaped, fill, pick, q, sql_escaped, sql_fill, sql_pick, table, texts,
)
from promptweir.registry.prompts import _WORD_LIST
from promptweir.registry.stem_sql import stems_sql
from promptweir.registry.verdict_sql import clean_answer_sql, strict_judge_sql
from promptweir.sources.lexicons import DEFAULT_MODEL, REFERENCE_MODELS

METRICS = plan.METRICS
_SAMPLE, _SEED = 5, 23


def _text_ids(spark, sf_dir):
    """Recorded vectors stand for texts: a run of eight for the tokens of a text, and the vector
    with the number of the text for the whole of it."""
    return table(spark, sf_dir, "embeddings").agg(F.floor(F.count(F.lit(1)) / 8)).scalar()


def _vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return {
        "sentence_vectors": vectors.select(F.col("vec_id").alias("text_id"), "embedding"),
        "token_vectors": vectors.select(
            F.floor(F.col("vec_id") / 8).alias("text_id"), (F.col("vec_id") % 8).alias("pos"), "embedding")}


def _candidates(spark, sf_dir):
    """Assistant turns as candidate answers, each to its own question."""
    turns = texts(spark, sf_dir, "conversations").where("role = 'assistant'")
    key = F.col("conv_id") * 1000 + F.col("turn")
    return turns.select(key.alias("candidate_id"), key.alias("question_id"), F.col("text").alias("candidate"),
                        F.pmod(key, _text_ids(spark, sf_dir)).alias("candidate_text_id"))


def _references(spark, sf_dir):
    """Three references per question: a benchmark text, the plain lower-case form of the
    answer, and the question itself."""
    turns = texts(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    answers = turns.where("role = 'assistant'")
    items = table(spark, sf_dir, "benchmark")
    size = items.agg(F.count(F.lit(1))).scalar()
    drawn = answers.select(key.alias("question_id")).withColumn("item_id", F.pmod("question_id", size)).join(
        items, "item_id").select("question_id", F.lit("bench").alias("model_id"), F.col("text").alias("ref_text"))
    plain = answers.select(key.alias("question_id"), F.lit("plain").alias("model_id"),
                           F.lower(F.regexp_replace("text", "[,.]", "")).alias("ref_text"))
    asked = turns.where("role = 'user'").select(
        (key + 1).alias("question_id"), F.lit("question").alias("model_id"), F.col("text").alias("ref_text"))
    place = F.col("question_id") * 3 + F.when(F.col("model_id") == "bench", 1).when(F.col("model_id") == "plain", 2).otherwise(3)
    return drawn.unionByName(plain).unionByName(asked).withColumn("ref_text_id", F.pmod(place, _text_ids(spark, sf_dir)))


_INPUT = """
candidates AS (
  SELECT conv_id * 1000 + turn AS candidate_id, text AS candidate FROM conversations WHERE role = 'assistant'),
refs AS (
  SELECT candidate_id AS question_id, 'bench' AS model_id, b.text AS ref_text
  FROM candidates JOIN benchmark b ON b.item_id = candidate_id % (SELECT count(*) FROM benchmark)
  UNION ALL SELECT candidate_id, 'plain', lower(regexp_replace(candidate, '[,.]', '', 'g')) FROM candidates
  UNION ALL SELECT conv_id * 1000 + turn + 1, 'question', text FROM conversations WHERE role = 'user'),
pairs AS (
  SELECT candidate_id, model_id, candidate, ref_text FROM candidates JOIN refs ON question_id = candidate_id)"""

VECTOR_SQL = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT count(*) // 8 FROM embeddings) AS n FROM embeddings),
ids AS (
  SELECT candidate_id, model_id, candidate_id % n AS ct,
    (candidate_id * 3 + CASE model_id WHEN 'bench' THEN 1 WHEN 'plain' THEN 2 ELSE 3 END) % n AS rt
  FROM pairs, (SELECT max(n) AS n FROM v)),
sberts AS (
  SELECT candidate_id, model_id, list_cosine_similarity(a.e, b.e) AS sbert
  FROM ids JOIN v a ON a.vec_id = ct JOIN v b ON b.vec_id = rt),
sims AS (
  SELECT candidate_id, model_id, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS s
  FROM ids JOIN v a ON a.vec_id // 8 = ct JOIN v b ON b.vec_id // 8 = rt),
berts AS (
  SELECT candidate_id, model_id, 2 * p * r / (p + r) AS bertscore FROM
    (SELECT candidate_id, model_id, avg(s) AS p FROM (
      SELECT candidate_id, model_id, i, max(s) AS s FROM sims GROUP BY ALL) GROUP BY ALL)
    JOIN (SELECT candidate_id, model_id, avg(s) AS r FROM (
      SELECT candidate_id, model_id, j, max(s) AS s FROM sims GROUP BY ALL) GROUP BY ALL) USING (candidate_id, model_id))"""


def edit_similarity(spark, sf_dir):
    return _one_metric(spark, sf_dir, "edit_sim")


# DuckDB's levenshtein counts bytes. The texts hold 21 letters beyond ASCII; giving each an
# unused ASCII code makes bytes and characters the same.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CODES = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 27)])
_BYTES = lambda column: f"translate({column}, '{_LETTERS}', {_CODES})"
EDIT_SQL = f"""edits AS (
  SELECT candidate_id, model_id, CASE WHEN greatest(length(candidate), length(ref_text)) = 0 THEN 0.0::DOUBLE ELSE
    1 - levenshtein({_BYTES('candidate')}, {_BYTES('ref_text')}) / greatest(length(candidate), length(ref_text)) END AS edit_sim
  FROM pairs)"""


def _token_pairs(spark, sf_dir):
    return plan.bleu_token_pairs(_candidates(spark, sf_dir), _references(spark, sf_dir))


def bleu_pairs(spark, sf_dir):
    pairs = _token_pairs(spark, sf_dir)
    return bleu.sentence_bleu(pairs, plan.KEYS, "c_tokens", "r_tokens").withColumn("bleu", F.round("bleu", 9))


def bleu_corpus(spark, sf_dir):
    pairs = _token_pairs(spark, sf_dir)
    counts = bleu.ngram_counts(pairs, plan.KEYS, "c_tokens", "r_tokens")
    return bleu.corpus_bleu(counts, ["model_id"]).withColumn("bleu", F.round("bleu", 9))


def _tokens_13a_sql(text: str) -> str:
    line = f"replace(replace(replace(rtrim({text}), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in bleu.ENTITIES:
        line = f"replace({line}, {q(entity)}, {q(char)})"
    line = f"(' ' || {line} || ' ')"
    for pattern, replacement in bleu.TOKEN_RULES:
        line = f"regexp_replace({line}, {q(pattern)}, {q(replacement.replace('$', chr(92)))}, 'g')"
    return f"list_filter(string_split_regex({line}, '\\s+'), lambda x: x <> '')"


BLEU_SQL = f"""
toks AS (
  SELECT candidate_id, model_id, {_tokens_13a_sql('candidate')} AS c, {_tokens_13a_sql('ref_text')} AS r FROM pairs),
grams AS (
  SELECT candidate_id, model_id, n, true AS own, array_to_string(c[i:i + n - 1], ' ') AS gram FROM (
    SELECT *, unnest(range(1, len(c) - n + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS n FROM toks))
  UNION ALL
  SELECT candidate_id, model_id, n, false, array_to_string(r[i:i + n - 1], ' ') FROM (
    SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS n FROM toks))),
gram_counts AS (
  SELECT candidate_id, model_id, n, gram, count(*) FILTER (own) AS c, count(*) FILTER (NOT own) AS r FROM grams GROUP BY ALL),
matches AS (
  SELECT candidate_id, model_id, n, sum(least(c, r)) AS m, sum(c) AS t, sum(r) AS rt FROM gram_counts GROUP BY ALL),
orders AS (
  SELECT *, count(*) FILTER (m = 0) OVER (PARTITION BY candidate_id, model_id ORDER BY n) AS zeros FROM matches WHERE t > 0),
logs AS (
  SELECT candidate_id, model_id, sum(m) AS hits, avg(ln(CASE WHEN m = 0 THEN 1 / pow(2, zeros) / t ELSE m / t END)) AS l
  FROM orders GROUP BY ALL),
bleus AS (
  SELECT p.candidate_id, p.model_id, CASE WHEN coalesce(hits, 0) = 0 THEN 0.0::DOUBLE
    ELSE CASE WHEN len(c) < len(r) THEN exp(1 - len(r) / len(c)) ELSE 1 END * exp(l) END AS bleu
  FROM toks p LEFT JOIN logs USING (candidate_id, model_id))"""


def stem_words(spark, sf_dir):
    """Stems of every distinct word of the documents."""
    docs = texts(spark, sf_dir, "documents").select(rouge.tokens(F.col("text")).alias("tokens"))
    return porter.with_stem(stems.token_words(docs, "tokens", 1).distinct(), "word")


def _one_metric(spark, sf_dir, name, **options):
    done = plan.score_table(_candidates(spark, sf_dir), _references(spark, sf_dir), metrics=(name,), **options)
    return _rounded(done, (name,))


def rouge_l(spark, sf_dir):
    return _one_metric(spark, sf_dir, "rouge")


def meteor_pairs(spark, sf_dir):
    return _one_metric(spark, sf_dir, "meteor")


def _synonyms(spark, sf_dir):
    """Short words of the texts that begin with the same two letters stand for synonyms."""
    words = texts(spark, sf_dir, "conversations").select(F.explode_outer(meteor.tokens(F.col("text"))).alias("word"))
    return words.where("word RLIKE '^[a-z]{3,5}$'").distinct().select("word", F.left("word", F.lit(2)).alias("set_id"))


def meteor_synonyms(spark, sf_dir):
    """METEOR with a synonym table."""
    return _one_metric(spark, sf_dir, "meteor", synonyms=_synonyms(spark, sf_dir))


def _stemmed_sql(name: str, tokens, min_length: int) -> str:
    """Long token table of both sides with stems."""
    return f"""
{name}_lists AS (
  SELECT candidate_id, model_id, {tokens('candidate')} AS c, {tokens('ref_text')} AS r FROM pairs),
{name}_toks AS (
  SELECT candidate_id, model_id, 'c' AS side, unnest(c) AS word, generate_subscripts(c, 1) AS pos FROM {name}_lists
  UNION ALL
  SELECT candidate_id, model_id, 'r', unnest(r), generate_subscripts(r, 1) FROM {name}_lists),
{name}_words AS (SELECT DISTINCT word FROM {name}_toks WHERE length(word) >= {min_length}),
{stems_sql(f'{name}_words', f'{name}_stem')},
{name}_stemmed AS (
  SELECT t.*, coalesce(s.stem, t.word) AS stem FROM {name}_toks t LEFT JOIN {name}_stem s USING (word))"""


_ROUGE_TOKENS = lambda text: f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"
_METEOR_TOKENS = lambda text: _WORD_LIST.replace("trim(text,", f"trim({text},")

# One row of the alignment table per step: entry j grows when token i occurs at or before j
# with a match left of its last such place.
ROUGE_SQL = f"""{_stemmed_sql('g', _ROUGE_TOKENS, rouge.STEM_FROM_LENGTH)},
g_arrays AS (
  SELECT candidate_id, model_id, list(stem ORDER BY pos) FILTER (side = 'c') AS a, list(stem ORDER BY pos) FILTER (side = 'r') AS b
  FROM g_stemmed GROUP BY ALL),
lcs AS (
  SELECT candidate_id, model_id, a, b, 0 AS i, list_transform(b, lambda x: 0) AS t FROM g_arrays
  WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL
  SELECT candidate_id, model_id, a, b, i + 1, CASE WHEN len(spots) = 0 THEN t ELSE list_transform(range(1, len(t) + 1),
    lambda j: greatest(t[j], CASE WHEN spots[1] <= j
      THEN 1 + coalesce(t[list_max(list_filter(spots, lambda k: k <= j)) - 1], 0) ELSE 0 END)) END
  FROM (SELECT *, list_filter(range(1, len(b) + 1), lambda k: b[k] = a[i + 1]) AS spots FROM lcs WHERE i < len(a))),
rouges AS (
  SELECT p.candidate_id, p.model_id, coalesce(CASE WHEN t[-1] > 0 THEN 2.0 * t[-1] / (len(l.a) + len(l.b)) END, 0.0)::DOUBLE AS rouge
  FROM pairs p LEFT JOIN (SELECT * FROM lcs WHERE i = len(a)) l USING (candidate_id, model_id))"""

METEOR_SQL = f"""{_stemmed_sql('m', _METEOR_TOKENS, 1)},
exact_rank AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id, model_id, side, word ORDER BY pos DESC) AS k FROM m_stemmed),
exact_match AS (
  SELECT c.candidate_id, c.model_id, c.pos AS cp, r.pos AS rp FROM exact_rank c JOIN exact_rank r
    ON c.candidate_id = r.candidate_id AND c.model_id = r.model_id AND c.word = r.word AND c.k = r.k
  WHERE c.side = 'c' AND r.side = 'r'),
left_over AS (
  SELECT s.* FROM m_stemmed s ANTI JOIN (
    SELECT candidate_id, model_id, 'c' AS side, cp AS pos FROM exact_match
    UNION ALL SELECT candidate_id, model_id, 'r', rp FROM exact_match) e USING (candidate_id, model_id, side, pos)),
stem_rank AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id, model_id, side, stem ORDER BY pos DESC) AS k FROM left_over),
all_match AS (
  FROM exact_match UNION ALL
  SELECT c.candidate_id, c.model_id, c.pos, r.pos FROM stem_rank c JOIN stem_rank r
    ON c.candidate_id = r.candidate_id AND c.model_id = r.model_id AND c.stem = r.stem AND c.k = r.k
  WHERE c.side = 'c' AND r.side = 'r'),
steps AS (
  SELECT *, cp - lag(cp) OVER w = 1 AND rp - lag(rp) OVER w = 1 AS follows FROM all_match
  WINDOW w AS (PARTITION BY candidate_id, model_id ORDER BY cp)),
chunked AS (
  SELECT candidate_id, model_id, count(*) AS m, count(*) FILTER (follows IS DISTINCT FROM true) AS ch FROM steps GROUP BY ALL),
meteors AS (
  SELECT l.candidate_id, l.model_id, CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE
    (1 - 0.5 * pow(ch / m, 3)) * (m / len(c)) * (m / len(r)) / (0.9 * (m / len(c)) + 0.1 * (m / len(r))) END AS meteor
  FROM m_lists l LEFT JOIN chunked USING (candidate_id, model_id))"""

# As above, with a third stage: every word of the table has one set, so the k-th last free words of a set pair up.
SYNONYM_SQL = METEOR_SQL.replace("all_match AS (\n  FROM exact_match UNION ALL\n  SELECT c.candidate_id, c.model_id, c.pos, r.pos", """stem_match AS (
  SELECT c.candidate_id, c.model_id, c.pos AS cp, r.pos AS rp""").replace("steps AS (", f"""sets AS (
  SELECT DISTINCT word, word[1:2] AS set_id FROM (SELECT unnest({_METEOR_TOKENS('text')}) AS word FROM conversations)
  WHERE regexp_full_match(word, '[a-z]{{3,5}}')),
set_rank AS (
  SELECT s.*, set_id, row_number() OVER (PARTITION BY candidate_id, model_id, side, set_id ORDER BY pos DESC) AS k
  FROM left_over s JOIN sets ON sets.word = s.stem ANTI JOIN (
    SELECT candidate_id, model_id, 'c' AS side, cp AS pos FROM stem_match
    UNION ALL SELECT candidate_id, model_id, 'r', rp FROM stem_match) e USING (candidate_id, model_id, side, pos)),
all_match AS (
  FROM exact_match UNION ALL FROM stem_match UNION ALL
  SELECT c.candidate_id, c.model_id, c.pos, r.pos FROM set_rank c JOIN set_rank r
    ON c.candidate_id = r.candidate_id AND c.model_id = r.model_id AND c.set_id = r.set_id AND c.k = r.k
  WHERE c.side = 'c' AND r.side = 'r'),
steps AS (""")


def token_match_f1(spark, sf_dir):
    """Runs of eight recorded vectors stand for the tokens of a text; each text is
    compared with the next one."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("text_id"), (F.col("vec_id") % 8).alias("pos"), "embedding")
    pairs = vectors.select("text_id").distinct().withColumn("other_id", F.col("text_id") + 1)
    scored = token_match.token_match_f1(pairs, ["text_id"], "text_id", "other_id", vectors, block=3)
    return scored.select("text_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _scores(spark, sf_dir):
    return plan.score_table(_candidates(spark, sf_dir), _references(spark, sf_dir), **_vectors(spark, sf_dir))


def _rounded(df, names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns])


def score_table(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir), METRICS)


def score_averages(spark, sf_dir):
    done = plan.averages(_candidates(spark, sf_dir), _scores(spark, sf_dir), METRICS)
    return _rounded(done, METRICS)


def model_leaderboard(spark, sf_dir):
    return _rounded(plan.leaderboard(_scores(spark, sf_dir), METRICS), METRICS)


def sample_eval(spark, sf_dir):
    done = plan.sampled_scores(
        _candidates(spark, sf_dir), _references(spark, sf_dir), _SAMPLE, _SEED, **_vectors(spark, sf_dir))
    return _rounded(done, METRICS)


def _qa(spark, sf_dir):
    """Question and answer rows: each answer with the turn before it."""
    turns = texts(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    asked = turns.where("role = 'user'").select((key + 1).alias("pair_id"), F.col("text").alias("user_query"))
    return asked.join(_candidates(spark, sf_dir).select(
        F.col("candidate_id").alias("pair_id"), F.col("candidate").alias("LLM_answer")), "pair_id")


def _judge_raw():
    key = F.col("pair_id")
    return fill(JUDGE_FORMS, F.floor(key / 3), {
        "S": pick(("1", "2", "3", "4", "5"), key), "B": pick(("true", "false"), F.floor(key / 2)),
        "T": escaped(F.col("LLM_answer")), "R": F.col("LLM_answer")})


def sample_judge(spark, sf_dir):
    """A sample of pairs, their judge requests, the recorded replies, and the verdicts."""
    pairs = _qa(spark, sf_dir)
    sample = sampling.sample_rows(pairs, _SAMPLE, _SEED, ["pair_id"])
    asked = requests.evaluation_requests(sample, "pair_id").where("kind = 'full_judge'")
    replies = pairs.select(
        F.concat(F.lit("full_judge:"), F.col("pair_id").cast("string"), F.lit(f":{DEFAULT_MODEL}")).alias("request_id"),
        _judge_raw().alias("raw"))
    done = verdicts.judge_verdicts(asked.select("request_id", F.col("model").alias("model_id")).join(replies, "request_id", "left"))
    return done.drop("raw")


def evaluation_requests(spark, sf_dir):
    return requests.evaluation_requests(_qa(spark, sf_dir), "pair_id")


def _recorded(spark, sf_dir):
    """Every pair, and a recorded response of every reference model to it, with its number and raw text."""
    key, ids = F.col("pair_id"), _text_ids(spark, sf_dir)
    pairs = _qa(spark, sf_dir).withColumn("candidate_text_id", F.pmod(key, ids))
    said = [F.col("LLM_answer"), F.col("user_query"), F.lower("LLM_answer")]
    each = F.array(*[F.struct(F.lit(m).alias("model"), said[i % 3].alias("said"), F.lit(i + 1).alias("place"))
                     for i, m in enumerate(REFERENCE_MODELS)])
    responses = pairs.select("pair_id", F.inline_outer(each)).select(
        "pair_id", "model", fill(ANSWER_FORMS, key, {"R": F.col("said")}).alias("raw"), F.pmod(key * 3 + F.col("place"), ids).alias("ref_text_id"))
    return pairs, responses


def _request_ids(responses, key):
    return responses.withColumn("request_id", F.concat_ws(":", F.lit("reference"), key, "model")).drop("model", "pair_id")


def evaluate_responses_all(spark, sf_dir):
    """Every pair with a recorded response of every reference model, by all metrics."""
    pairs, responses = _recorded(spark, sf_dir)
    responses = _request_ids(responses, F.col("pair_id").cast("string"))
    return _rounded(plan.evaluate_responses(pairs, responses, "pair_id", **_vectors(spark, sf_dir)), METRICS)


def evaluate_responses(spark, sf_dir):
    """All of them under keys that are texts, with odd rows beside them: pairs without an answer, pairs whose requests
    have no response, and requests that were answered twice, of which the latest counts."""
    pairs, responses = _recorded(spark, sf_dir)
    named = lambda prefix: F.concat(F.lit(prefix), F.col("pair_id").cast("string"))
    rows = pairs.withColumn("key", named("chat:")).unionByName(
        pairs.where("pair_id % 10 = 3").withColumn("LLM_answer", F.lit("")).withColumn("key", named("blank:"))).unionByName(
        pairs.where("pair_id % 7 = 5").withColumn("key", named("silent:")))
    replies = _request_ids(responses, named("chat:")).withColumn("responded_at", F.lit(2))
    earlier = _request_ids(responses.where("pair_id % 4 = 1"), named("chat:")).withColumns(
        {"raw": F.lit("zzz earlier answer"), "responded_at": F.lit(1)})
    done = plan.evaluate_responses(rows, replies.unionByName(earlier), "key", **_vectors(spark, sf_dir))
    return _rounded(done, METRICS)


QUERIES = {
    "evaluate_responses_all": evaluate_responses_all,
    "evaluate_responses": evaluate_responses,
    "edit_similarity": edit_similarity,
    "bleu_pairs": bleu_pairs,
    "bleu_corpus": bleu_corpus,
    "stem_words": stem_words,
    "rouge_l": rouge_l,
    "meteor": meteor_pairs,
    "meteor_synonyms": meteor_synonyms,
    "token_match_f1": token_match_f1,
    "score_table": score_table,
    "score_averages": score_averages,
    "model_leaderboard": model_leaderboard,
    "sample_eval": sample_eval,
    "sample_judge": sample_judge,
    "evaluation_requests": evaluation_requests,
}

_SCORES = f"""WITH RECURSIVE {_INPUT}, {EDIT_SQL}, {BLEU_SQL}, {ROUGE_SQL}, {METEOR_SQL}, {VECTOR_SQL},
scores AS (
  SELECT candidate_id, model_id, bleu, sbert, rouge, bertscore, edit_sim, meteor FROM edits JOIN bleus USING (candidate_id, model_id)
    JOIN rouges USING (candidate_id, model_id) JOIN meteors USING (candidate_id, model_id)
    LEFT JOIN sberts USING (candidate_id, model_id) LEFT JOIN berts USING (candidate_id, model_id))"""
_SAMPLED = _INPUT.replace(
    "candidates AS (\n  SELECT conv_id * 1000 + turn AS candidate_id, text AS candidate FROM conversations WHERE role = 'assistant')",
    f"""candidates AS (
  SELECT conv_id * 1000 + turn AS candidate_id, text AS candidate FROM conversations WHERE role = 'assistant'
  ORDER BY md5('{_SEED}|' || (conv_id * 1000 + turn)), 1 LIMIT {_SAMPLE})""")
_ROUNDED = ", ".join(f"round({m}, 9) AS {m}" for m in METRICS)
_MEANS = ", ".join(f"round(coalesce(avg({m}), 0), 9) AS {m}" for m in METRICS)
_QA_SQL = f"""qa AS (
  SELECT a.conv_id * 1000 + a.turn AS pair_id, u.text AS user_query, a.text AS answer
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant' AND u.role = 'user')"""
_REQUEST = lambda kind, model, system, user, temperature, tokens: (
    f"SELECT '{kind}:' || pair_id || ':' || {q(model)} AS request_id, '{kind}' AS kind, {q(model)} AS model, "
    f"{system} AS system_text, {user} AS user_text, {temperature}::DOUBLE AS temperature, {tokens} AS max_tokens FROM qa")

_PLACES = " ".join(f"WHEN {q(m)} THEN {i + 1}" for i, m in enumerate(REFERENCE_MODELS))
_MODELS_SQL = ", ".join(f"({i % 3}, {q(m)})" for i, m in enumerate(REFERENCE_MODELS))
_EVALUATED = f"""WITH RECURSIVE {_QA_SQL},
said AS (
  SELECT pair_id, answer, model, CASE i WHEN 0 THEN answer WHEN 1 THEN user_query ELSE lower(answer) END AS said
  FROM qa, (VALUES {_MODELS_SQL}) m(i, model) WHERE answer <> '' AND user_query <> ''),
recorded AS (SELECT *, {sql_fill(ANSWER_FORMS, 'pair_id', {'R': 'said'})} AS raw FROM said),
pairs AS (
  SELECT pair_id AS candidate_id, model AS model_id, answer AS candidate, {clean_answer_sql('raw')} AS ref_text FROM recorded),
{EDIT_SQL}, {BLEU_SQL}, {ROUGE_SQL}, {METEOR_SQL},
{VECTOR_SQL.replace("CASE model_id WHEN 'bench' THEN 1 WHEN 'plain' THEN 2 ELSE 3 END", f"CASE model_id {_PLACES} END")}
"""
_EVALUATED_COLUMNS = f"""model_id, {_ROUNDED}, NULL::VARCHAR AS reject_reason
FROM edits JOIN bleus USING (candidate_id, model_id) JOIN rouges USING (candidate_id, model_id)
  JOIN meteors USING (candidate_id, model_id) LEFT JOIN sberts USING (candidate_id, model_id) LEFT JOIN berts USING (candidate_id, model_id)"""
ORACLES = {
    "evaluate_responses_all": _EVALUATED + """SELECT candidate_id AS pair_id, """ + _EVALUATED_COLUMNS + """
UNION ALL SELECT pair_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'question and answer must be non-empty' FROM qa
WHERE answer = '' OR user_query = ''""",
    "evaluate_responses": _EVALUATED + """SELECT 'chat:' || candidate_id AS key, """ + _EVALUATED_COLUMNS + """
UNION ALL SELECT 'blank:' || pair_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'question and answer must be non-empty' FROM qa WHERE pair_id % 10 = 3
UNION ALL SELECT unnest(['chat:' || pair_id, CASE WHEN pair_id % 7 = 5 THEN 'silent:' || pair_id END]) AS key, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  'question and answer must be non-empty' FROM qa WHERE answer = '' OR user_query = ''""",
    "edit_similarity": f"""WITH {_INPUT}, {EDIT_SQL}
SELECT candidate_id, model_id, round(edit_sim, 9) AS edit_sim FROM edits""",
    "bleu_pairs": f"WITH {_INPUT}, {BLEU_SQL} SELECT candidate_id, model_id, round(bleu, 9) AS bleu FROM bleus",
    "bleu_corpus": f"""WITH {_INPUT}, {BLEU_SQL},
sums AS (SELECT model_id, n, sum(m) AS m, sum(t) AS t, sum(rt) AS rt FROM matches GROUP BY ALL),
ranked AS (SELECT *, count(*) FILTER (m = 0) OVER (PARTITION BY model_id ORDER BY n) AS zeros FROM sums),
parts AS (
  SELECT model_id, exp(avg(ln(CASE WHEN m = 0 THEN 1 / pow(2, zeros) / t ELSE m / t END))) AS p,
    max(CASE WHEN n = 1 THEN t END) AS c, max(CASE WHEN n = 1 THEN rt END) AS r FROM ranked GROUP BY model_id)
SELECT model_id, round(p * CASE WHEN c < r THEN exp(1 - r / c) ELSE 1 END, 9) AS bleu FROM parts""",
    "stem_words": f"""WITH words AS (SELECT DISTINCT unnest({_ROUGE_TOKENS('text')}) AS word FROM documents), {stems_sql('words')}
SELECT word, stem FROM stem_of""",
    "rouge_l": f"""WITH RECURSIVE {_INPUT}, {ROUGE_SQL}
SELECT candidate_id, model_id, round(rouge, 9) AS rouge FROM rouges""",
    "meteor_synonyms": f"""WITH {_INPUT}, {SYNONYM_SQL}
SELECT candidate_id, model_id, round(meteor, 9) AS meteor FROM meteors""",
    "meteor": f"""WITH {_INPUT}, {METEOR_SQL}
SELECT candidate_id, model_id, round(meteor, 9) AS meteor FROM meteors""",
    "token_match_f1": """WITH v AS (
  SELECT vec_id // 8 AS text_id, vec_id % 8 AS pos, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (
  SELECT a.text_id, a.pos AS i, b.pos AS j, list_cosine_similarity(a.e, b.e) AS s
  FROM v a JOIN v b ON b.text_id = a.text_id + 1),
p AS (SELECT text_id, avg(s) AS precision FROM (SELECT text_id, i, max(s) AS s FROM sims GROUP BY ALL) GROUP BY text_id),
r AS (SELECT text_id, avg(s) AS recall FROM (SELECT text_id, j, max(s) AS s FROM sims GROUP BY ALL) GROUP BY text_id)
SELECT text_id, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(2 * precision * recall / (precision + recall), 9) AS f1 FROM p JOIN r USING (text_id)""",
    "score_table": f"{_SCORES} SELECT candidate_id, model_id, {_ROUNDED} FROM scores",
    "score_averages": f"""{_SCORES}
SELECT candidate_id, {_MEANS} FROM candidates LEFT JOIN scores USING (candidate_id) GROUP BY candidate_id""",
    "model_leaderboard": f"{_SCORES} SELECT model_id, count(*) AS pairs, {_MEANS} FROM scores GROUP BY model_id",
    "sample_eval": f"""{_SCORES.replace(_INPUT, _SAMPLED)} SELECT candidate_id, model_id, {_ROUNDED} FROM scores""",
    "sample_judge": f"""WITH {_QA_SQL},
replies AS (
  SELECT 'full_judge:' || pair_id || ':{DEFAULT_MODEL}' AS request_id, {q(DEFAULT_MODEL)} AS model_id, {sql_fill(JUDGE_FORMS, 'pair_id // 3', {
      'S': sql_pick(("1", "2", "3", "4", "5"), 'pair_id'), 'B': sql_pick(("true", "false"), 'pair_id // 2'),
      'T': sql_escaped('answer'), 'R': 'answer'})} AS raw
  FROM qa ORDER BY md5('{_SEED}|' || pair_id), pair_id LIMIT {_SAMPLE}), {strict_judge_sql('replies')}
SELECT * FROM judge_result""",
    "evaluation_requests": f"WITH {_QA_SQL} " + " UNION ALL ".join([
        _REQUEST("light_judge", DEFAULT_MODEL, "NULL::VARCHAR",
                 f"{q(requests.LIGHT_JUDGE_HEAD)} || user_query || {q(requests.LIGHT_JUDGE_MIDDLE)} || answer || {q(requests.LIGHT_JUDGE_TAIL)}",
                 0.3, "NULL::INT"),
        _REQUEST("full_judge", DEFAULT_MODEL, q(requests.FULL_JUDGE_SYSTEM),
                 "'### User Question:' || chr(10) || user_query || chr(10) || chr(10) || '### LLM Answer:' || chr(10) || answer || chr(10)",
                 0.0, 250),
        *[_REQUEST("reference", m, q(requests.REFERENCE_SYSTEM),
                   f"{q(requests.REFERENCE_HEAD)} || user_query || {q(requests.REFERENCE_TAIL)}", 0.0, 200)
          for m in REFERENCE_MODELS]]),
}
