"""Verdict parsing, case by case."""

import pytest
from pyspark.sql import functions as F

from promptweir.operators import centroids, requests, verdicts
from promptweir.plans import router
from promptweir.sources import chats

CLASSIFIER = [
    ('{"category": "code_technical", "confidence": 0.9}', "q", "ok", "CODE_TECHNICAL", 0.9),
    ('<think>{"category": "x"}</think> {"category": "CREATIVE_ARTISTIC"}', "q", "ok", "CREATIVE_ARTISTIC", 0.7),
    ('{"category": "", "confidence": 7}', "q", "ok", "CODE_TECHNICAL", 1.0),
    ('{"category": "nothing", "confidence": "0.25"}', "q", "ok", "BUSINESS_PROFESSIONAL", 0.25),
    ('{"category": "CODE", "confidence": null}', "q", "no_verdict", None, None),
    ('{"category": null}', "q", "no_verdict", None, None),
    ('{"category": "academic stuff", "confidence": 3.5', "q", "rescued", "EDUCATIONAL_ACADEMIC", 3.5),
    ('{"category": "math", "confidence": 0.5 oops}', "q", "rescued", "BUSINESS_PROFESSIONAL", 0.5),
    ('{"category": "code", "confidence": 1.2.3 x}', "q", "no_verdict", None, None),
    ("no json", "May I file a Lawsuit?", "legal_default", "BUSINESS_PROFESSIONAL", 0.8),
    ("no json", "hello", "no_verdict", None, None),
    ("[1]", "lawsuit", "no_verdict", None, None),
    (None, "lawsuit", "no_verdict", None, None),
    # repeated keys and numbers that are none
    ('{"category": "x", "confidence": 1, "category": "CREATIVE_ARTISTIC", "confidence": 0.9}', "q", "ok", "CREATIVE_ARTISTIC", 0.9),
    ('{"category": "CODE_TECHNICAL", "confidence": NaN}', "q", "ok", "CODE_TECHNICAL", 1.0),
    ('{"category": "CODE_TECHNICAL", "confidence": -Infinity, "note": "NaN"}', "q", "ok", "CODE_TECHNICAL", 0.0),
    ('{"category": "CODE_TECHNICAL", "confidence": Infinity}', "q", "ok", "CODE_TECHNICAL", 1.0),
    ('{"category": "CODE_TECHNICAL", "category": null}', "q", "no_verdict", None, None),
    ('{"category": "CODE_TECHNICAL", "category": ["x"]}', "q", "no_verdict", None, None),
    ('{"category": "code", "category": "code", "confidence": +Infinity}', "q", "rescued", "CODE_TECHNICAL", 0.7),
    ('{"category": "code", "category": "code", "confidence": -INF}', "q", "rescued", "CODE_TECHNICAL", 0.7),
    ('{"category": "code", "category": "code", "confidence": -NaN}', "q", "rescued", "CODE_TECHNICAL", 0.7),
    ('{"category": "code", "category": "code", "confidence": 1NaN}', "q", "rescued", "CODE_TECHNICAL", 1.0),
    ('{"category": "code", "category": \'x\', "confidence": 0.5}', "q", "rescued", "CODE_TECHNICAL", 0.5),
    ('{"category": "code", "category": "a\nb", "confidence": 0.5}', "q", "rescued", "CODE_TECHNICAL", 0.5),
    ('{"category": "code", "category": "\\q", "confidence": 0.5}', "q", "rescued", "CODE_TECHNICAL", 0.5),
    ('{"category": "code", "category": "x",, "confidence": 0.5}', "q", "rescued", "CODE_TECHNICAL", 0.5),
    ("[NaN]", "lawsuit", "no_verdict", None, None),
    (" -Infinity ", "lawsuit", "no_verdict", None, None),
]


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(list(enumerate(rows)), "i int, raw string")


def test_classifier_verdicts(spark):
    rows = spark.createDataFrame(
        [(i, raw, query) for i, (raw, query, *_) in enumerate(CLASSIFIER)], "i int, raw string, query string")
    for r in verdicts.classifier_verdicts(rows).collect():
        expected = CLASSIFIER[r.i][2:]
        assert (r.parse_status, r.verdict_category, r.verdict_confidence) == expected, r.raw


def test_strict_verdicts(frame):
    full = '{"score": 4.0, "accuracy": "4", "completeness": 3, "clarity": 5, "is_correct": true, "justification": "j"}'
    cases = [(full, "ok"), (f"<think>a</think>x <think>b</think>{full} tail", "ok"), (full[:-1], "no_json"),
             (full + " }", "bad_json"), (full.replace('"j"', "'j'"), "bad_json"), ('{"score": 4}', "missing_keys"),
             ("", "no_json"), ("} {", "no_json"), (full[:-1] + ', "score": 4, "more": NaN}', "ok"),
             (full.replace("4.0", '9, "score": 4.0'), "ok"), (full + ', {"score": 1, "score": 2}', "bad_json")]
    for r in verdicts.judge_verdicts(frame([c for c, _ in cases])).collect():
        assert r.parse_status == cases[r.i][1], r.raw
        assert r.parse_status != "ok" or (r.score, r.accuracy, r.is_correct) == (4.0, 4.0, True)


def test_light_and_legacy_verdicts(frame):
    cases = [
        ('ok {"score": 2, "justification": "x"}', "ok", 2.0, None), ('{"score": 2}', "score_rescued", 2.0, True),
        ("[1]", "error", 3.0, True), ("7", "error", 3.0, True), ("prose", "default", 3.0, True),
        ('{"score":  5, ', "score_rescued", 5.0, True), ("null", "error", 3.0, True),
        ('{"score": 1, "score": 2, "justification": "x", "is_correct": false}', "ok", 2.0, False), ("[NaN, 1]", "error", 3.0, True),
        ("Infinity", "error", 3.0, True), ("Infinity 1", "default", 3.0, True), ('{"score": 1, "score": 2}', "score_rescued", 1.0, True)]
    rows = verdicts.light_verdicts(frame([c[0] for c in cases])).collect()
    for r in rows:
        assert (r.parse_status, r.score, r.is_correct) == cases[r.i][1:], r.raw
    assert rows[2].justification == "Error in judging: 'list' object has no attribute 'get'"
    assert rows[9].justification == "Error in judging: 'float' object has no attribute 'get'"
    legacy = verdicts.legacy_verdicts(frame(['{"score": 1}', 'x {"score": 1}'])).orderBy("i").collect()
    assert [(r.parse_status, r.score) for r in legacy] == [("ok", 1.0), ("default", 3.0)]


def test_clean_answers(frame):
    cases = [("<think>a</think> b <think>a</think>", "b"), ("<think>open", "open"), ("x Answer:  y\nz ", "y\nz"),
             (" plain ", "plain"), ("<think>t</think>\nAnswer: y", "Answer: y")]
    rows = frame([c for c, _ in cases]).select("i", verdicts.clean_answer(F.col("raw")).alias("a")).collect()
    assert all(r.a == cases[r.i][1] for r in rows)


def test_centroids_with_a_hot_label(spark):
    vectors = spark.range(3000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("label"),
        F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    means = centroids.label_centroids(vectors)
    got = {r.label: r.centroid for r in means.collect()}
    assert got["hot"][1] == 1.0 and got["cold"][0] == pytest.approx(sum(range(9, 3000, 10)) / 300)
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1500.0, 1.0])], "i int, v array<double>")
    rows = centroids.classify(queries, means, ["cold", "hot", "unseen"], ["v"]).orderBy("i").collect()
    assert rows[0].embedding_category is None and rows[1].embedding_confidence == pytest.approx(1.0)


def test_requests_out_responses_in(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "why?", "because")], "pair_id int, user_query string, LLM_answer string")
    asked = requests.evaluation_requests(pairs, "pair_id")
    chats.write_requests(asked, str(tmp_path / "requests"))
    back = spark.read.parquet(str(tmp_path / "requests"))
    assert {r.kind: r["count"] for r in back.groupBy("kind").count().collect()} == {
        "light_judge": 1, "full_judge": 1, "reference": 3}
    raw = '{"score": 5, "justification": "fine"}'
    back.where("kind = 'light_judge'").select("request_id", F.col("model").alias("model_id"), F.lit(raw).alias("raw")) \
        .write.parquet(str(tmp_path / "responses"))
    joined = chats.join_responses(back, chats.read_responses(spark, str(tmp_path / "responses")))
    assert joined.count() == 5 and joined.where("raw IS NOT NULL").count() == 1


def test_route_isolates_failures(spark):
    prompts = spark.createDataFrame(
        [(1, "debug my python code"), (2, None), (3, "hi")], "prompt_id int, text string")
    responses = spark.createDataFrame(
        [(1, "done", '{"score": 4, "justification": "ok"}'), (2, "x", None)], "prompt_id int, response string, judge_raw string")
    rows = {r.prompt_id: r for r in router.answer(router.route(router.classify(prompts)), responses).collect()}
    assert rows[1].success and rows[1].score == 4 and rows[1].judge_status == "ok"
    assert not rows[2].success and rows[2].error == "prompt text is missing"
    assert not rows[3].success and rows[3].error == "no recorded response" and rows[3].score is None
