"""Text metrics against brute force and hand-computed values."""

import json
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptweir.functions import porter, word_stems
from promptweir.operators import bleu, edit, meteor, requests, rouge, sampling, stems, token_match, verdicts
from promptweir.plans import evaluation as plan


def test_stems(spark):
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "feed": "feed",
        "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
        "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "skies": "sky",
        "relational": "relat", "conditional": "condit", "digitizer": "digit", "radically": "radic", "vilely": "vile",
        "vietnamization": "vietnam", "hopefulness": "hope", "formality": "formal", "sensibility": "sensibl",
        "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv",
        "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "activate": "activ",
        "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die",
        "died": "die", "spied": "spi", "enjoy": "enjoy", "by": "by", "geology": "geolog", "hopefully": "hope",
        "yyyyyed": "yyyi",
    }
    frame = spark.createDataFrame(list(known.items()), "word string, expected string")
    wrong = [tuple(r) for r in porter.with_stem(frame, "word").collect() if r.stem != r.expected]
    assert wrong == []


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_property():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert rouge._lcs(a, b) == brute_lcs(a, b) == rouge._lcs(b, a)


def brute_bleu(c, r):
    c, r = c.split(), r.split()
    logs, zeros, hits = [], 0, 0
    for n in range(1, 5):
        grams = lambda t: Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
        own, other = grams(c), grams(r)
        total = sum(own.values())
        if not total:
            break
        matched = sum(min(k, other[g]) for g, k in own.items())
        hits += matched
        zeros += matched == 0
        logs.append(math.log(matched / total if matched else 1 / 2 ** zeros / total))
    if not hits:
        return 0.0
    return (math.exp(1 - len(r) / len(c)) if len(c) < len(r) else 1) * math.exp(sum(logs) / len(logs))


def test_bleu_against_brute_force(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 12))),
              " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    frame = spark.createDataFrame(texts, "k int, c string, r string")
    cut = frame.select("k", "c", "r", bleu.tokens_13a(F.col("c")).alias("ct"), bleu.tokens_13a(F.col("r")).alias("rt"))
    scores = {r.k: r.bleu for r in bleu.sentence_bleu(cut, ["k"], "ct", "rt").collect()}
    assert len(scores) == 150
    for k, c, r in texts:
        assert scores[k] == pytest.approx(brute_bleu(c, r), abs=1e-9), (c, r)


def test_13a_tokens(spark):
    text = "It's 3,000.5 (approx.), e-mail 12-x &amp; \"q\" end-\nline.\n"
    row = spark.createDataFrame([(text,)], "t string").select(bleu.tokens_13a(F.col("t")).alias("x")).first()
    assert row.x == ["It's", "3,000.5", "(", "approx", ".", ")", ",", "e-mail", "12", "-", "x", "&", '"', "q", '"',
                     "endline", "."]


def test_13a_rules_have_no_ranges_and_cut_the_same_tokens(spark):
    """ranges in classes made most of the time of a pair."""
    spelled = [bleu.spelt(pattern) for pattern, _ in bleu.TOKEN_RULES]
    assert not any(re.search(r"[^\\]-[^)\]]", p) for p in spelled) and not any(" " in p for p in spelled)
    for (pattern, _), other in zip(bleu.TOKEN_RULES, spelled):
        for x in [a + b for a in map(chr, range(33, 260)) for b in ".,-5aé"]:
            assert bool(re.search(pattern, x)) == bool(re.search(other, x)), (pattern, x)
    rng = random.Random(7)
    texts = ["".join(rng.choice("a5.,,..--  \t!(é&~`{") for _ in range(rng.randint(0, 25))) + "z" for _ in range(3000)]

    def brute(text):
        line = f" {text} "
        for pattern, replacement in bleu.TOKEN_RULES:
            line = re.sub(pattern, replacement.replace("$", "\\"), line)
        return line.split()

    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = frame.select("k", bleu.tokens_13a(F.col("t")).alias("x")).collect()
    assert [(texts[r.k], r.x) for r in rows if r.x != brute(texts[r.k])] == []


def test_lcs_looks_only_at_what_differs():
    """an unhashable token in the common beginning or end is compared, and not looked up."""
    assert rouge._lcs([[0], 1, 2, [3]], [[0], 2, 1, [3]]) == 3
    assert rouge._lcs([[0]], [[0], 1]) == 1 and rouge._lcs([], [0]) == 0


def test_edit_similarity(spark):
    rows = [("é", "e", 0.0), ("", "", 0.0), ("kitten", "sitting", 1 - 3 / 7), ("x", "x", 1.0), ("", "ab", 0.0)]
    frame = spark.createDataFrame(rows, "a string, b string, e double")
    for r in frame.withColumn("s", edit.edit_similarity(F.col("a"), F.col("b"))).collect():
        assert r.s == pytest.approx(r.e)


def test_score_table_bounds_and_goldens(spark):
    same = "the cat sat on the mat"
    candidates = spark.createDataFrame(
        [(1, 1, same), (2, 2, ""), (3, 3, "jumping dogs")], "candidate_id int, question_id int, candidate string")
    references = spark.createDataFrame(
        [(1, "same", same), (1, "other", "zzz qqq"), (2, "same", ""), (2, "other", "x")],
        "question_id int, model_id string, ref_text string")
    extra = spark.createDataFrame([(3, "stem", "dog jumps")], "question_id int, model_id string, ref_text string")
    metrics = ("bleu", "rouge", "edit_sim", "meteor")
    table = plan.score_table(candidates, references.union(extra), metrics=metrics)
    got = {(r.candidate_id, r.model_id): r for r in table.collect()}
    assert len(got) == 5
    exact = got[1, "same"]
    assert exact.bleu == pytest.approx(1) and exact.rouge == 1 and exact.edit_sim == 1
    assert exact.meteor == pytest.approx(1 - 0.5 / 6 ** 3)
    for key in ((1, "other"), (2, "same"), (2, "other")):
        assert got[key].bleu == got[key].rouge == got[key].meteor == 0
    assert got[3, "stem"].rouge == pytest.approx(0.5)  # two stems match, in the other order
    assert got[3, "stem"].meteor == pytest.approx(0.5)  # all matched, two chunks
    none = spark.createDataFrame([(9, 9, "alone")], candidates.schema)
    means = {r.candidate_id: r for r in plan.averages(candidates.union(none), table, metrics).collect()}
    assert means[9].bleu == 0.0 and means[1].rouge == pytest.approx(0.5)


def test_stems_in_the_row_equal_those_of_columns(spark):
    rng = random.Random(6)
    endings = [*porter.PLURAL_RULES, *porter.STEP2_RULES, *porter.STEP3_RULES, *porter.STEP4_SUFFIXES, "", "ed", "ing", "eed", "ied", "y", "e", "ll"]
    words = {"".join(rng.choice("aeiouybctlszwxé9") for _ in range(rng.randint(0, 6))) + rng.choice(endings) + rng.choice(endings + [""] * 20)
             for _ in range(20_000)} | set(porter.IRREGULAR) | {"", "y", "yyyy", "a" * 50 + "ing", "b" * 50 + "s"}
    rows = porter.with_stem(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    assert [(r.word, r.stem, word_stems.stem(r.word)) for r in rows if r.stem != word_stems.stem(r.word)] == []


def test_stems_of_token_lists(spark):
    texts = spark.createDataFrame([(0, ["running", None, "cats", "x"]), (1, []), (2, None)], "k int, t array<string>").select(
        "k", F.filter("t", lambda w: w.isNotNull()).alias("t"))
    rows = texts.select("k", word_stems.stemmed("t", 1).alias("s"), word_stems.stemmed("t", 5).alias("long")).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(0, ["run", "cat", "x"], ["run", "cats", "x"]), (1, [], []), (2, None, None)]


def test_salted_and_plain_synonym_joins_agree(spark):
    texts = spark.createDataFrame([(i, ["hot"] * 50 + ["run", "x"]) for i in range(20)] + [(20, ["x"]), (21, [])], "k int, t array<string>")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("run", 2), ("cold", 1)], "word string, set_id int")
    rows = {salts: {r.k: {e.stem: sorted(e.sets) for e in r.sets} for r in stems.synonym_sets(
        texts, "k", F.col("t"), table, salts).collect()} for salts in (1, 7)}
    assert rows[1] == rows[7] == {i: {"hot": [1, 2], "run": [2]} for i in range(20)}


def test_token_match_blocks_agree(spark):
    rng = random.Random(2)
    rows = [(t, p, [rng.gauss(0, 1) for _ in range(6)]) for t, n in ((1, 17), (2, 9)) for p in range(n)]
    vectors = spark.createDataFrame(rows, "text_id int, pos int, embedding array<double>")
    pairs = spark.createDataFrame([(1, 2)], "a int, b int")
    one = token_match.token_match_f1(pairs, ["a", "b"], "a", "b", vectors, block=100).first()
    small = token_match.token_match_f1(pairs, ["a", "b"], "a", "b", vectors, block=4).first()
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / math.hypot(*x) / math.hypot(*y)
    left, right = [v for t, _, v in rows if t == 1], [v for t, _, v in rows if t == 2]
    precision = sum(max(cos(x, y) for y in right) for x in left) / len(left)
    assert one.precision == pytest.approx(precision) and small == pytest.approx(one)


def test_sample_is_repeatable(spark):
    frame = spark.range(1000)
    pick = lambda f, seed: sorted(r.id for r in sampling.sample_rows(f, 5, seed, ["id"]).collect())
    assert pick(frame, 23) == pick(frame.repartition(17), 23) != pick(frame, 24)
    assert len(pick(frame.limit(3), 23)) == 3


def test_vector_metrics_in_the_score_table(spark):
    candidates = spark.createDataFrame(
        [(1, 1, "a", 10)], "candidate_id int, question_id int, candidate string, candidate_text_id int")
    references = spark.createDataFrame(
        [(1, "m", "b", 20), (1, "n", "c", 30)], "question_id int, model_id string, ref_text string, ref_text_id int")
    sentences = spark.createDataFrame(
        [(10, [1.0, 0.0]), (20, [0.0, 2.0]), (30, [3.0, 3.0])], "text_id int, embedding array<double>")
    tokens = spark.createDataFrame(
        [(10, 0, [1.0, 0.0]), (10, 1, [0.0, 1.0]), (20, 0, [0.0, 5.0])], "text_id int, pos int, embedding array<double>")
    table = plan.score_table(candidates, references, sentences, tokens, metrics=("sbert", "bertscore", "edit_sim"))
    got = {r.model_id: r for r in table.collect()}
    assert got["m"].sbert == pytest.approx(0.0) and got["n"].sbert == pytest.approx(math.sqrt(0.5))
    assert got["m"].bertscore == pytest.approx(2 * 0.5 * 1 / 1.5) and got["n"].bertscore is None
    assert got["m"].edit_sim == 0.0
    bare = plan.score_table(candidates, references, metrics=("sbert", "bertscore")).collect()
    assert len(bare) == 2 and all(r.sbert is None and r.bertscore is None for r in bare)


def test_responses_are_scored_by_all_metrics(spark):
    """A blank answer keeps its row and reason, a missing response has none; vectors reach the others."""
    pairs = spark.createDataFrame(
        [(1, "q", "the cat sat", 10), (2, "q", "", 20), (3, "q", "x", 30)],
        "pair_id int, user_query string, LLM_answer string, candidate_text_id int")
    responses = spark.createDataFrame(
        [("reference:1:m", "<think>t</think> the cat sat", 20), ("reference:1:n", "a dog", 30), ("reference:2:m", "y", 10)],
        "request_id string, raw string, ref_text_id int")
    sentences = spark.createDataFrame(
        [(10, [1.0, 0.0]), (20, [0.0, 2.0]), (30, [3.0, 3.0])], "text_id int, embedding array<double>")
    tokens = spark.createDataFrame(
        [(10, 0, [1.0, 0.0]), (10, 1, [0.0, 1.0]), (20, 0, [0.0, 5.0])], "text_id int, pos int, embedding array<double>")
    done = plan.evaluate_responses(pairs, responses, "pair_id", reference_models=("m", "n"),
                                   sentence_vectors=sentences, token_vectors=tokens)
    assert done.columns == ["pair_id", "model_id", *plan.METRICS, "reject_reason"]
    got = {(r.pair_id, r.model_id): r for r in done.collect()}
    assert set(got) == {(1, "m"), (1, "n"), (2, None)}
    assert got[1, "m"].edit_sim == 1 and got[1, "m"].sbert == pytest.approx(0.0)
    assert got[1, "m"].bertscore == pytest.approx(2 * 0.5 * 1 / 1.5)
    assert got[1, "n"].sbert == pytest.approx(math.sqrt(0.5)) and got[1, "n"].bertscore is None
    assert got[2, None].reject_reason and got[2, None].sbert is None
    with pytest.raises(ValueError):
        plan.evaluate_responses(pairs, responses.drop("ref_text_id"), "pair_id", sentence_vectors=sentences)


def brute_meteor(own, other, sets):
    """Exact words, then words sharing a set, each from the end; all words here are their own stems."""
    own, other, found = list(enumerate(own)), list(enumerate(other)), []
    sizes = len(own), len(other)
    for same in (lambda a, b: a == b, lambda a, b: sets.get(a, set()) & sets.get(b, set())):
        for c in own[::-1]:
            r = next((r for r in other[::-1] if same(c[1], r[1])), None)
            if r:
                found.append((c[0], r[0]))
                own.remove(c)
                other.remove(r)
    if not found:
        return 0.0
    found.sort()
    chunks = 1 + sum((b[0] - a[0], b[1] - a[1]) != (1, 1) for a, b in zip(found, found[1:]))
    p, r = len(found) / sizes[0], len(found) / sizes[1]
    return (1 - 0.5 * (chunks / len(found)) ** 3) * p * r / (0.9 * p + 0.1 * r)


def test_many_alignments_equal_single_ones():
    """the pairs of a batch are aligned together, and only what two stages left is held as objects."""
    rng = random.Random(8)
    words = ["hot", "run", "warm", "x", "cold"]
    texts = [[[rng.choice(words) for _ in range(rng.choice((0, 1, 3, 9)))] for _ in range(2)] for _ in range(2 * meteor.ROWS + 9)]
    sets = {"hot": ["1"], "warm": ["1", "2"], "run": ["2"]}
    left, right = ([t[side] for t in texts] for side in (0, 1))
    said = lambda side: pa.array([json.dumps([{"stem": s, "sets": sets[s]} for s in {word_stems.stem(w) for w in x} & set(sets)]) if x else None
                                  for x in side], pa.string())
    lists = [pa.array(side, pa.list_(pa.string())) for side in (left, right)]
    assert not hasattr(meteor, "alignment") and len(meteor._alignments(lists[0][:0], lists[1][:0])) == 0
    for table, more in (({}, []), ({k: set(v) for k, v in sets.items()}, [(said(left), said(right))])):
        for (a, b), got in zip(texts, meteor._alignments(*lists, *more).to_pylist()):
            m, chunks = got["matched"], got["chunks"]
            p, r = (m / len(a), m / len(b)) if m else (0, 0)
            score = (1 - 0.5 * (chunks / m) ** 3) * p * r / (0.9 * p + 0.1 * r) if m else 0.0
            assert score == pytest.approx(brute_meteor(a, b, table)), (a, b)


def test_meteor_with_a_synonym_table(spark):
    rng = random.Random(4)
    sets = {"big": {1}, "grand": {1, 2}, "top": {2}, "cat": {3}, "tom": {3}, "dot": {4}}
    words = [*sets, "red", "sun"]
    texts = [(["a", "big", "cat"], ["a", "grand", "tom"]), (["red"], ["sun"])] + [
        tuple([rng.choice(words) for _ in range(rng.randint(1, 9))] for _ in "ab") for _ in range(40)]
    candidates = spark.createDataFrame(
        [(i, i, " ".join(a)) for i, (a, _) in enumerate(texts)], "candidate_id int, question_id int, candidate string")
    references = spark.createDataFrame(
        [(i, "m", " ".join(b)) for i, (_, b) in enumerate(texts)], "question_id int, model_id string, ref_text string")
    table = spark.createDataFrame([(w, s) for w, ids in sets.items() for s in ids], "word string, set_id int")
    scored = lambda **more: {r.candidate_id: r.meteor for r in plan.score_table(
        candidates, references, metrics=("meteor",), **more).collect()}
    with_table, without = scored(synonyms=table), scored()
    assert len(with_table) == len(texts) and with_table[0] == pytest.approx(1 - 0.5 / 27)  # one chunk of three
    for i, (a, b) in enumerate(texts):
        assert with_table[i] == pytest.approx(brute_meteor(a, b, sets)), texts[i]
        assert without[i] == pytest.approx(brute_meteor(a, b, {})), texts[i]


def test_a_metric_of_the_callers_runs_beside_the_others(spark):
    candidates = spark.createDataFrame([(1, 1, "cats run"), (2, 2, "x y")], "candidate_id int, question_id int, candidate string")
    references = spark.createDataFrame([(1, "m", "the cat runs"), (2, "m", "x")], "question_id int, model_id string, ref_text string")
    share = plan.Metric("stem_share", lambda: F.size(F.array_intersect("c_all_stems", "r_all_stems")) / F.size("r_all_stems"),
                        {"all": (meteor.tokens, 1)})
    seen = plan.Metric("known", attach=lambda pairs, options: pairs.join(options["known"], "candidate_id", "left"))
    known = spark.createDataFrame([(1, True)], "candidate_id int, known boolean")
    rows = {r.candidate_id: r for r in plan.score_table(candidates, references, metrics=("rouge", share, "meteor", seen), known=known).collect()}
    assert list(rows[1].asDict()) == ["candidate_id", "model_id", "rouge", "meteor", "stem_share", "known"]
    assert rows[1].stem_share == pytest.approx(2 / 3) and rows[2].stem_share == 1.0 and rows[1].known and rows[2].known is None
    for wrong in (("blue",), ("bleu", "bleu"), (plan.Metric("x"),), ("meteor", plan.Metric("y", lambda: F.lit(1), {"words": (rouge.tokens, 1)}))):
        with pytest.raises(ValueError):
            plan.score_table(candidates, references, metrics=wrong)


def test_keys_of_any_text_and_repeated_responses(spark):
    keys = ["a:1", "b", "a", ":", "reference:1:m"]
    pairs = spark.createDataFrame([(k, "q", f"answer {i}") for i, k in enumerate(keys)], "id string, user_query string, LLM_answer string")
    replies = [(f"reference:{k}:m", f"answer {i}", 2) for i, k in enumerate(keys)]
    replies += [("reference:a:1:m", "old", 1), ("reference:b:m", None, 9), ("reference:b:m", "answer 1", 2)]
    responses = spark.createDataFrame(replies, "request_id string, raw string, responded_at int")
    done = plan.evaluate_responses(pairs, responses, "id", reference_models=("m",), metrics=("edit_sim",)).collect()
    assert sorted((r.id, r.edit_sim) for r in done) == sorted((k, 1.0) for k in keys)


def test_a_second_run_asks_only_what_is_new(spark):
    rows = [("a:1", "q", "x"), ("a", "1:q", "x"), ("b", "q", "y")]
    pairs = spark.createDataFrame(rows, "id string, user_query string, LLM_answer string")
    first = requests.open_requests(requests.evaluation_requests(pairs, "id"), spark.createDataFrame([], "content_id string, raw string"))
    assert first.count() == first.select("content_id").distinct().count() == 15
    recorded = first.select("content_id", F.when(~F.col("request_id").startswith("full_judge:b"), "said").alias("raw"))
    again = lambda **more: requests.open_requests(requests.evaluation_requests(pairs.union(pairs), "id", **more), recorded).collect()
    assert [r.request_id.split(":")[:2] for r in again()] == [["full_judge", "b"]]
    assert len(again(judge_model="another/judge")) == 6  # both judges of every pair, and no reference anew
    changed = pairs.withColumn("LLM_answer", F.concat("LLM_answer", F.lit("!")))
    assert {r.kind for r in requests.open_requests(requests.evaluation_requests(changed, "id"), recorded).collect()} == {"light_judge", "full_judge"}


def test_another_judge_model_is_asked_and_read(spark):
    """Requests name it, and its recorded replies become verdicts under its name."""
    pairs = spark.createDataFrame([(1, "q", "x")], "id int, user_query string, LLM_answer string")
    asked = requests.evaluation_requests(pairs, "id", judge_model="another/judge", reference_models=("r",))
    assert {(r.kind, r.model) for r in asked.collect()} == {("light_judge", "another/judge"), ("full_judge", "another/judge"), ("reference", "r")}
    replies = asked.where("kind = 'full_judge'").select("request_id", F.col("model").alias("model_id"), F.lit(
        '{"score": 4, "accuracy": 4, "completeness": 4, "clarity": 4, "is_correct": true, "justification": "t"}').alias("raw"))
    done = verdicts.judge_verdicts(replies).first()
    assert done.model_id == "another/judge" and done.request_id == "full_judge:1:another/judge"


def test_distances_of_long_texts(spark):
    rng = random.Random(8)
    table = lambda a, b: [[0] * (len(b) + 1) for _ in range(len(a) + 1)]

    def by_table(a, b):
        d = table(a, b)
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                d[i][j] = max(i, j) if not i or not j else min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("abé漢") for _ in range(rng.randrange(40))) for _ in "ab")
        assert edit.distance(a, b) == by_table(a, b)
    long = " ".join(str(rng.randrange(500)) for _ in range(20_000))
    other = long[100:].replace("77", "éé", 50) + "xyz"
    row = spark.createDataFrame([(long, other), ("", ""), ("ab", "b"), (None, "b")], "a string, b string").select(
        edit.edit_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert row[0].s == pytest.approx(1 - 203 / len(long), abs=1e-4) and [r.s for r in row[1:]] == [0.0, 0.5, None]


def test_text_metrics_are_one_python_step(spark):
    """A worker per task for all of them: stems do not go back and forth between two."""
    candidates = spark.createDataFrame([(1, 1, "cats run"), (2, 2, None)], "candidate_id int, question_id int, candidate string")
    references = spark.createDataFrame([(1, "m", "the cat runs"), (2, "m", "x")], "question_id int, model_id string, ref_text string")
    table = plan.score_table(candidates, references, metrics=("bleu", "rouge", "edit_sim", "meteor"))
    steps = table._jdf.queryExecution().executedPlan().toString()
    assert steps.count("ArrowEvalPython") == 1
    rows = {r.candidate_id: r for r in table.collect()}
    assert rows[1].rouge == pytest.approx(0.8) and rows[1].meteor > 0
    assert (rows[2].bleu, rows[2].rouge, rows[2].edit_sim, rows[2].meteor) == (0.0, 0.0, None, 0.0)


def test_distances_of_many_pairs_at_a_time():
    rng = random.Random(9)
    letters = ("ab", "abé漢 ", "etaoin shrdlu😀")
    text = lambda n: "".join(rng.choice(rng.choice(letters)) for _ in range(n))
    left = [text(rng.choice([0, 1, 63, 64, 65, 128, 129, rng.randrange(400)])) for _ in range(200)]
    right = [text(rng.randrange(400)) if rng.random() < 0.6 else x[:len(x) // 2] + "q" + x[len(x) // 2 + 3:] for x in left]
    left += ["x" + "a" * k + "y" for k in range(1, 700, 7)] + [None, "a"]  # carries over many words
    right += ["b" + "a" * (k + 3) + "c" for k in range(1, 700, 7)] + ["a", None]
    assert edit.distances(left, right) == [None if a is None or b is None else edit.distance(a, b) for a, b in zip(left, right)]
