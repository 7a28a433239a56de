"""Golden values and properties of normalisation, features and rule classification."""

import random
import re

import pytest
from pyspark.sql import functions as F

from promptweir.operators import automata, ensemble, features, lexicon, rules
from promptweir.session import BATCH_BYTES
from promptweir.sources import lexicons
from promptweir.sources.lexicons import Lexicon

GOLDEN = "Write a JS function using ML algorithms"


def run(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "prompt_id int, text string")
    rows = rules.classify(features.preprocess(frame)).orderBy("prompt_id").collect()
    return rows


def test_lexicon_sizes(spark):
    assert len(lexicons.ABBREVIATIONS) == 78 and len(lexicons.PRESERVED_TERMS) == 110
    terms = Lexicon().terms
    assert len(terms) == 336 and sum(" " in t for t in terms) == 75
    built = lexicon.build_lexicon(lexicons.abbreviation_frame(spark), lexicons.term_frame(spark))
    assert sorted(r.term for r in built.collect()) == list(terms)
    assert lexicons.rule_frame(spark).count() == 102


def test_golden_prompt(spark):
    row = run(spark, [GOLDEN])[0]
    assert row.normalized_query == "write a javascript function using machine learning algorithms"
    assert row.key_terms == ["javascript", "algorithms", "machine learning"]
    assert row.action_verbs == ["write"]
    assert row.features.complexity.tech_density == pytest.approx(3 / 8)
    assert row.features.primary_tech_category == "programming"
    assert row.rule_category == "CODE_TECHNICAL" and row.rule_raw_score == 11
    assert row.rule_confidence == pytest.approx(0.453846, abs=1e-6)


def test_other_goldens(spark):
    rows = run(spark, [
        "If I want to file a lawsuit against a company, what steps should I take?",
        "What are the benefits of using renewable energy sources in modern economies?",
        "(js)", "create an API", "create APIs for us", "", None, "    ",
    ])
    assert (rows[0].rule_category, rows[0].rule_confidence) == ("CONVERSATIONAL_ADVICE", 0.05)
    assert rows[1].rule_category == "EDUCATIONAL_ACADEMIC"
    assert rows[1].rule_confidence == pytest.approx(0.238636, abs=1e-6)
    assert rows[2].normalized_query == "javascripts)"
    assert rows[3].rule_raw_score == 3 and rows[4].rule_raw_score == 5
    assert rows[5].normalized_query == "" and rows[5].features.complexity.word_count == 0
    assert rows[6].error and rows[6].normalized_query is None
    assert rows[7].normalized_query == ""


def brute_rules(text):
    """The weighted rules with plain regular expressions."""
    best = None
    for category, tiers in lexicons.RULES.items():
        raw = sum(3 for k in tiers["primary"] if re.search(rf"\b{re.escape(k)}\b", text))
        raw += sum(1 for k in tiers["secondary"] if re.search(rf"\b{re.escape(k)}\b", text))
        raw += sum(5 for p in tiers["phrases"] if re.search(p, text))
        top = 3 * len(tiers["primary"]) + len(tiers["secondary"]) + 5 * len(tiers["phrases"])
        if best is None or raw / top > best[0]:
            best = (raw / top, raw, category)
    return best


def test_rules_against_plain_regexes(spark):
    rng = random.Random(5)
    words = sorted({w for t in lexicons.RULES.values() for ps in t.values() for p in ps
                    for w in re.findall(r"[a-z]+", p)} - {"w"}) + ["the", "xwrite", "café", "of.", "(code)", "me!", "on"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "prompt_id int, normalized_query string")
    for row in rules.classify(frame).collect():
        share, raw, category = brute_rules(row.normalized_query)
        assert row.rule_raw_score == raw, row
        assert row.rule_category == (category if raw else "CONVERSATIONAL_ADVICE"), row


def test_join_forms_equal_literal_forms(spark):
    texts = [GOLDEN, "unit tests, xunit testing of neural networks", "py PY py go", "react native deep learning", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "prompt_id int, text string")
    literal = {r.prompt_id: r for r in features.preprocess(frame).collect()}
    joined = lexicon.expand_by_join(frame, lexicons.abbreviation_frame(spark))
    terms = lexicon.build_lexicon(lexicons.abbreviation_frame(spark), lexicons.term_frame(spark))
    for row in joined.collect():
        assert row.normalized_query == literal[row.prompt_id].normalized_query
    hits = {r.prompt_id: r.key_terms for r in lexicon.terms_by_join(joined, terms).collect()}
    for key, row in literal.items():
        assert hits[key] == row.key_terms


def test_terms_of_long_texts(spark):
    words = " ".join(["machine", "learning", "xmachine", "py", "graph"] * 4000)
    frame = spark.createDataFrame([(i, words) for i in range(8)] + [(9, "no hit here"), (10, None)], "prompt_id int, normalized_query string")
    terms = lexicon.build_lexicon(lexicons.abbreviation_frame(spark), lexicons.term_frame(spark))
    rows = {r.prompt_id: r.key_terms for r in lexicon.terms_by_join(frame, terms).collect()}
    assert len(rows) == 10 and rows[9] == rows[10] == []
    assert all("machine learning" in rows[i] for i in range(8))


def test_partitioning_does_not_matter(spark):
    texts = [GOLDEN, "fix the error", "teach me", "x"] * 20
    frame = spark.createDataFrame(list(enumerate(texts)), "prompt_id int, text string")
    one = rules.classify(features.preprocess(frame.coalesce(1))).orderBy("prompt_id").collect()
    many = rules.classify(features.preprocess(frame.repartition(13))).orderBy("prompt_id").collect()
    assert one == many


def test_ensemble_branches_are_total(spark):
    grid = spark.sql("""
      SELECT * FROM VALUES ('A', 0.05D), ('A', 0.6D), ('B', 0.79D), ('B', 0.8D), ('C', 1.0D) AS r(rule_category, rule_confidence),
        VALUES ('A', 0.1D), ('B', 0.6D), ('C', 0.95D), (NULL, NULL) AS e(embedding_category, embedding_confidence),
        VALUES ('A', 0.3D), ('B', 0.6D), ('C', 0.7D), ('A', 0.9D), (NULL, NULL) AS v(verdict_category, verdict_confidence)""")
    rows = ensemble.combine(grid.withColumn("secondary", F.lit(1))).collect()
    assert len(rows) == 100 and all(r.category and r.method and 0 <= r.confidence <= 1 for r in rows)
    assert len({r.method for r in rows}) == 8


def test_rule_tables_equal_literals_on_the_defaults(spark):
    texts = [GOLDEN, "fix the error", "teach me how to write code", "debugging a sql query.", "how does it work", "c++ and c#", "", None] * 3
    frame = spark.createDataFrame(list(enumerate(texts)), "prompt_id int, text string")
    prompts = features.preprocess(frame).withColumn("weight", F.lit("own")).withColumn("kind", F.lit("own"))
    columns = ["prompt_id", "rule_category", F.round("rule_confidence", 9), F.col("rule_raw_score").cast("double"), "weight"]
    table = lexicons.rule_frame(spark)
    literal = rules.classify(prompts).where("text IS NOT NULL").select(*columns).orderBy("prompt_id").collect()
    for frame in (table, table.drop("weight"), table.drop("is_regex")):
        by_table = rules.classify_by_table(prompts, frame)
        assert by_table.where("text IS NOT NULL").select(*columns).orderBy("prompt_id").collect() == literal
        assert {(r.rule_category, r.rule_raw_score) for r in by_table.where("text IS NULL").collect()} == {("CONVERSATIONAL_ADVICE", 0.0)}
    legacy = ["prompt_id", "legacy_category", F.round("legacy_confidence", 9)]
    assert (rules.classify_legacy_by_table(prompts, lexicons.keyword_frame(spark)).where("text IS NOT NULL").select(*legacy).orderBy("prompt_id").collect()
            == rules.classify_legacy(prompts).where("text IS NOT NULL").select(*legacy).orderBy("prompt_id").collect())


def test_rule_tables_of_many_blocks_and_own_weights(spark, monkeypatch):
    """50,000 patterns; a text scores what its patterns weigh in the table."""
    many = spark.range(50_000).select(
        F.concat(F.lit("c"), F.col("id") % 7).alias("category"), (F.col("id") % 7).cast("int").alias("cat_ord"),
        F.lit("primary").alias("tier"), (F.col("id") % 5 + 0.5).alias("weight"),
        F.concat(F.lit("term"), "id").alias("pattern"), F.lit(False).alias("is_regex"))
    odd = spark.createDataFrame([("c0", 0, "x", 99.0, r"(ab|cd)\d+", True), ("c0", 0, "x", 7.0, "one.*two", True)],
                                "category string, cat_ord int, tier string, weight double, pattern string, is_regex boolean")
    texts = ["term7 term70 term777x", "zz cd42", "anyone between two", "two one", "term3, term49999"]
    prompts = spark.createDataFrame(list(enumerate(texts)), "prompt_id int, normalized_query string")
    for block in (100_000, 9_000):
        monkeypatch.setattr(automata.write_blocks, "__defaults__", (block,))
        rows = {r.prompt_id: (r.rule_category, r.rule_raw_score) for r in rules.classify_by_table(prompts, many.union(odd)).collect()}
        assert rows == {0: ("c0", 2.5 + 0.5), 1: ("c0", 99.0), 2: ("c0", 7.0), 3: ("CONVERSATIONAL_ADVICE", 0.0), 4: ("c3", 3.5)} | {4: rows[4]}
        assert rows[4] in {("c3", 3.5), ("c5", 4.5)}


def test_a_rule_without_weight_or_tier_says_so(spark):
    odd = spark.createDataFrame([("c", 0, "unheard", "word")], "category string, cat_ord int, tier string, pattern string")
    prompts = spark.createDataFrame([(1, "word")], "prompt_id int, normalized_query string")
    with pytest.raises(Exception, match="no known tier: word"):
        rules.classify_by_table(prompts, odd).collect()


def test_a_hundred_thousand_terms_of_several_words(spark, monkeypatch):
    """All terms begin with the same word, and texts are full of it."""
    terms = spark.range(100_000).select(F.concat(F.lit("deep "), F.col("id"), F.lit(" net")).alias("term"), F.lit(3).alias("n_words"))
    terms = terms.union(spark.createDataFrame([("solo", 1), ("x", 1)], "term string, n_words int"))
    texts = [" ".join(["deep"] * 3000 + ["deep 7 net", "deep 99999 nets", "solo,", "solo"]), "deep 100000 net", None, "x. solo x"]
    frame = spark.createDataFrame([*enumerate(texts), (0, "x")], "prompt_id int, normalized_query string")
    for block in (200_000, 30_000):
        monkeypatch.setattr(automata.write_blocks, "__defaults__", (block,))
        got = {r.prompt_id: r.key_terms for r in lexicon.terms_by_join(frame, terms).collect()}
        assert got == {0: ["x", "solo", "deep 7 net", "deep 99999 net"], 1: [], 2: [], 3: ["x", "solo"]}


def test_blocks_of_patterns_hold_small_batches(spark):
    """A worker gets texts by bytes, not up to 64 MB of them."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    path, blocks = automata.write_blocks(spark.createDataFrame([("cat", 1)], "term string, n_words int"), "few", ["term"])
    texts = spark.createDataFrame([(1, "a cat"), (2, None)], "k int, x string")
    found = automata.with_found(texts, "x", "hits", automata.HIT, path, blocks, automata.term_finder)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
    assert {r.k: len(r.hits) for r in found.collect()} == {1: 1, 2: 0}
