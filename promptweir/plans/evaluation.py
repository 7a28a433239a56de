"""Scoring candidate answers against reference answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweir.functions import vectors as vec
from promptweir.functions import word_stems
from promptweir.operators import bleu, edit, meteor, pairs as pairing, requests, rouge, sampling, stems, token_match, verdicts
from promptweir.session import small_batches, written
from promptweir.sources.chats import join_responses, latest_responses
from promptweir.sources.lexicons import REFERENCE_MODELS

KEYS = ["candidate_id", "model_id"]


@dataclass(frozen=True)
class Metric:
    """A number for a pair of texts.

    Text metrics have ``value``, a column made of the columns of a pair: ``candidate``, ``ref_text``, and for
    every entry of ``lists`` (name: tokeniser, least stemmed length or None) ``c_<name>`` and ``r_<name>``, and
    ``c_<name>_stems`` and ``r_<name>_stems`` if it is stemmed. Lists are cut once for all metrics that name them.
    Metrics on other tables have ``attach``: it is given the scored pairs with their text ids and the options
    of the call, and adds the column ``name``.
    """

    name: str
    value: Callable[[], Column] | None = None
    lists: dict[str, tuple[Callable[[Column], Column], int | None]] = field(default_factory=dict)
    attach: Callable[[DataFrame, dict], DataFrame] | None = None
    #: The column if synonym sets of the list ``words`` are at hand.
    with_synonyms: Callable[[], Column] | None = None


def _sentence_cosine(pairs: DataFrame, options: dict) -> DataFrame:
    vectors = options.get("sentence_vectors")
    if vectors is None:
        return pairs.withColumn("sbert", F.lit(None).cast("double"))
    side = lambda key, name: vectors.select(F.col("text_id").alias(f"_{key}"), F.col("embedding").alias(name))
    joined = pairs
    for key, name in (("candidate_text_id", "_a"), ("ref_text_id", "_b")):
        joined = joined.join(side(key, name), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    return joined.withColumn("sbert", vec.cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def _token_f1(pairs: DataFrame, options: dict) -> DataFrame:
    vectors = options.get("token_vectors")
    if vectors is None:
        return pairs.withColumn("bertscore", F.lit(None).cast("double"))
    ids = ["candidate_text_id", "ref_text_id"]
    f1 = token_match.token_match_f1(pairs.select(*ids).distinct(), ids, *ids, vectors)
    return pairs.join(f1.select(*ids, F.col("f1").alias("bertscore")), ids, "left")


_METEOR = ("c_words", "r_words")
BUILT_IN = {m.name: m for m in (
    Metric("bleu", lambda: bleu.bleu_of("c_pieces", "r_pieces"), {"pieces": (bleu.tokens_13a, None)}),
    Metric("sbert", attach=_sentence_cosine),
    Metric("rouge", lambda: rouge.rouge_of("c_terms", "r_terms"), {"terms": (rouge.tokens, rouge.STEM_FROM_LENGTH)}),
    Metric("bertscore", attach=_token_f1),
    Metric("edit_sim", lambda: edit.edit_similarity(F.col("candidate"), F.col("ref_text"))),
    Metric("meteor", lambda: meteor.meteor(*_METEOR), {"words": (meteor.tokens, meteor.STEM_FROM_LENGTH)},
           with_synonyms=lambda: meteor.meteor(*_METEOR, sets=("c_sets", "r_sets"))),
)}
METRICS = tuple(BUILT_IN)


def _chosen(metrics: Iterable[str | Metric]) -> list[Metric]:
    """The metrics in order, built-in ones by name; names must be known and differ, and lists of one name agree."""
    unknown = sorted({m for m in metrics if isinstance(m, str)} - set(BUILT_IN))
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; there are {list(METRICS)}")
    found = [BUILT_IN[m] if isinstance(m, str) else m for m in metrics]
    if len({m.name for m in found}) < len(found):
        raise ValueError("two metrics of one name")
    lists: dict[str, tuple] = {}
    for m in found:
        if m.value is None and m.attach is None:
            raise ValueError(f"metric {m.name} has neither value nor attach")
        for name, cut in m.lists.items():
            if lists.setdefault(name, cut) != cut:
                raise ValueError(f"two token lists named {name}")
    return [m for m in BUILT_IN.values() if m in found] + [m for m in found if m not in BUILT_IN.values()]


def pair_table(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Every candidate with each reference of its question.

    candidates: candidate_id, question_id, candidate; references: question_id, model_id, ref_text.
    """
    return candidates.join(references, "question_id")


def bleu_token_pairs(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Pairs with the BLEU tokens of both texts, cut before the join."""
    own = candidates.select("candidate_id", "question_id", bleu.tokens_13a(F.col("candidate")).alias("c_tokens"))
    other = references.select("question_id", "model_id", bleu.tokens_13a(F.col("ref_text")).alias("r_tokens"))
    return own.join(other, "question_id")


def _texts(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """The texts of both sides in one table, written once: every text is worked on there."""
    ids = lambda frame, name: F.col(name) if name in frame.columns else F.lit(None).cast("long")
    model = references.schema["model_id"].dataType
    own = candidates.select("question_id", "candidate_id", F.lit(None).cast(model).alias("model_id"),
                            F.col("candidate").alias("_text"), ids(candidates, "candidate_text_id").alias("_text_id"), F.lit("c").alias("_side"))
    other = references.select("question_id", F.lit(None).cast(candidates.schema["candidate_id"].dataType).alias("candidate_id"), "model_id",
                              F.col("ref_text").alias("_text"), ids(references, "ref_text_id").alias("_text_id"), F.lit("r").alias("_side"))
    return written(own.unionByName(other).withColumn("_row", F.monotonically_increasing_id()), "texts")


def scored_pairs(candidates: DataFrame, references: DataFrame, metrics: Iterable[str | Metric], **options) -> DataFrame:
    """KEYS, text ids and the chosen metrics, one row per pair of a candidate and a reference of its question.

    Texts are written once and meet once, by question; every text metric is a column of the pair's row. Tokens
    are stemmed there too; only synonym sets, a table, make the distinct stems of a text travel.
    """
    chosen = _chosen(metrics)
    small_batches(candidates.sparkSession)
    synonyms = options.get("synonyms")
    lists = {name: cut for m in chosen for name, cut in m.lists.items()}
    stemmed = {name: cut for name, cut in lists.items() if cut[1] is not None}
    texts = _texts(candidates, references)
    extra = []
    if synonyms is not None and "words" in lists:
        cut, least = lists["words"]
        words = cut(F.col("_text"))
        sets = stems.synonym_sets(texts, "_row", words if least is None else word_stems.stemmed(words, least), synonyms)
        extra = ["sets"]
        texts = texts.join(sets, "_row", "left")

    # The bytes are few and the work on each is much: by size the planner would gather the pairs into a task or two.
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(mark: str, text: str, text_id: str, keys: list[str]) -> DataFrame:
        return texts.repartition(tasks, "question_id").where(F.col("_side") == mark).select(
            *keys, F.col("_text").alias(text), F.col("_text_id").alias(text_id), *[F.col(c).alias(f"{mark}_{c}") for c in extra])

    pairs = side("c", "candidate", "candidate_text_id", ["candidate_id", "question_id"]).join(
        side("r", "ref_text", "ref_text_id", ["question_id", "model_id"]), "question_id")
    both = (("c", "candidate"), ("r", "ref_text"))
    pairs = pairs.select("*", *[cut(F.col(text)).alias(f"{mark}_{name}") for name, (cut, _) in lists.items() for mark, text in both])
    pairs = pairs.select("*", *[word_stems.stemmed(f"{mark}_{name}", least).alias(f"{mark}_{name}_stems")
                                for name, (_, least) in stemmed.items() for mark, _ in both])
    value = lambda m: m.with_synonyms() if synonyms is not None and m.with_synonyms else m.value()
    scored = pairs.select(*KEYS, "candidate_text_id", "ref_text_id", *[value(m).alias(m.name) for m in chosen if m.value])
    attached = [m for m in chosen if m.attach]
    if any(options.get(v) is not None for v in ("sentence_vectors", "token_vectors")) and attached:
        scored = written(scored, "scored")  # narrow, and joined several times
    for m in attached:
        scored = m.attach(scored, options)
    return scored.select(*KEYS, "candidate_text_id", "ref_text_id", *[m.name for m in chosen])


def score_table(
    candidates: DataFrame, references: DataFrame,
    sentence_vectors: DataFrame | None = None, token_vectors: DataFrame | None = None,
    metrics: Iterable[str | Metric] = METRICS, synonyms: DataFrame | None = None, **options,
) -> DataFrame:
    """One row per (candidate_id, model_id) with the chosen metrics: names of built-in ones, or a ``Metric`` of
    the caller's, which runs beside them. A repeated candidate or reference has a row for each pair it is in.

    sentence_vectors: text_id, embedding; token_vectors: text_id, pos, embedding; both refer
    to the ``candidate_text_id`` and ``ref_text_id`` columns of the inputs. Without them
    the metric is NULL. synonyms: see ``meteor``. Other options are handed to the metrics.
    """
    scored = scored_pairs(candidates, references, metrics, sentence_vectors=sentence_vectors, token_vectors=token_vectors,
                          synonyms=synonyms, **options)
    return scored.drop("candidate_text_id", "ref_text_id")


def averages(candidates: DataFrame, scores: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Mean of each metric per candidate; 0.0 for a candidate without references."""
    means = scores.groupBy("candidate_id").agg(*[F.avg(m).alias(m) for m in metrics])
    return candidates.select("candidate_id").join(means, "candidate_id", "left").select(
        "candidate_id", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics])


def leaderboard(scores: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Mean of each metric per reference model."""
    return scores.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("pairs"), *[F.avg(m).alias(m) for m in metrics])


def sampled_scores(candidates: DataFrame, references: DataFrame, n: int, seed: int, **options) -> DataFrame:
    """Scores of a repeatable sample of ``n`` candidates against all their references.

    The sample is written first; only references of its questions are then worked on.
    """
    sample = written(sampling.sample_rows(candidates, n, seed, ["candidate_id"]), "sample")
    wanted = references.join(sample.select("question_id").distinct(), "question_id", "left_semi")
    return score_table(sample, wanted, **options)


def evaluate_responses(
    pairs: DataFrame, responses: DataFrame, key: str, question: str = "user_query", answer: str = "LLM_answer",
    reference_models: tuple[str, ...] = REFERENCE_MODELS, **options,
) -> DataFrame:
    """From question and answer rows and recorded raw responses to scores.

    Rows with an empty text are set aside with their reason. Every other row asks each
    reference model once; the raw response found under the request's id is cleaned and becomes
    a reference of the row. Returns ``key``, model_id, the metrics and reject_reason; a rejected
    row has neither model nor metrics, a request without response has no row. Keys may be any text.
    responses: request_id, raw, and responded_at if the latest of several is to win. Recorded vectors (see ``score_table``) are found by the
    ``candidate_text_id`` of a pair, for its answer, and the ``ref_text_id`` of a response, for its
    cleaned text.
    """
    own_id = [c for c in pairs.columns if c == "candidate_text_id"]
    ref_id = [c for c in responses.columns if c == "ref_text_id"]
    if any(options.get(v) is not None for v in ("sentence_vectors", "token_vectors")) and not (own_id and ref_id):
        raise ValueError("vectors need candidate_text_id in the pairs and ref_text_id in the responses")
    judged = pairing.split_rejects(pairs, question, answer)
    accepted = judged.where("reject_reason IS NULL")
    asked = requests.reference_requests(accepted, key, question, reference_models).select(
        "request_id", F.col("model").alias("model_id"), key).distinct()
    order = [c for c in responses.columns if c == "responded_at"]
    replies = join_responses(asked, latest_responses(responses.select("request_id", "raw", *order, *ref_id))).where("raw IS NOT NULL")
    references = replies.select(
        F.col(key).alias("question_id"), "model_id", verdicts.clean_answer(F.col("raw")).alias("ref_text"), *ref_id)
    candidates = accepted.select(
        F.col(key).alias("candidate_id"), F.col(key).alias("question_id"), F.col(answer).alias("candidate"), *own_id)
    scores = score_table(candidates, references, **options)
    names = {c: scores.schema[c].dataType for c in scores.columns if c not in KEYS}
    done = scores.select(F.col("candidate_id").alias(key), "model_id", *names, F.lit(None).cast("string").alias("reject_reason"))
    rejected = judged.where("reject_reason IS NOT NULL").select(
        key, F.lit(None).cast("string").alias("model_id"), *[F.lit(None).cast(t).alias(m) for m, t in names.items()], "reject_reason")
    return done.unionByName(rejected)
