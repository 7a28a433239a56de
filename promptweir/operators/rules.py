"""Rule-based classification against weighted and legacy keyword lexicons."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweir.functions import text as tx
from promptweir.operators import automata
from promptweir.sources.lexicons import FALLBACK_CATEGORY, LEGACY_KEYWORDS, RULES, TIER_WEIGHTS

_PLAIN_WORD = re.compile(r"\w+")
_PLAIN_PART = re.compile(r"[\w ]+")


# The hit tests are written as SQL text: a lexicon has a hundred and more of them.


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all(tests: list[str]) -> str:
    return "(" + " AND ".join(tests) + ")"


def _keyword_test(text: str, keyword: str) -> str:
    """Whole-word test: the words must be present before the text itself is searched."""
    words = keyword.split()
    if not all(_PLAIN_WORD.fullmatch(w) for w in words):
        return f"rlike({text}, {_text(rf'(?U)\b{re.escape(keyword)}\b')})"
    tests = [f"array_contains(_present, {_text(w)})" for w in words]
    if len(words) > 1:
        tests.append(f"rlike({text}, {_text(f'(^|{tx.NOT_WORD}){keyword}($|{tx.NOT_WORD})')})")
    return _all(tests)


def _phrase_test(text: str, pattern: str) -> str:
    """Search for a phrase pattern in text without line breaks.

    Parts joined by ``.*`` need no regex: each must follow the first occurrence of the one
    before it. Their words are first looked for in the vocabulary, which rules out
    nearly every text, and no text is scanned more than once per part.
    """
    parts = pattern.split(".*")
    plain = parts[:-1] if parts[-1] == r"\w+" and len(parts) > 1 else parts
    if not all(_PLAIN_PART.fullmatch(p) for p in plain):
        return f"rlike({text}, {_text('(?U)' + pattern)})"
    tests = [f"contains(_vocabulary, {_text(w)})" for w in dict.fromkeys(w for p in plain for w in p.split())]
    rest = text
    for part in plain:
        tests.append(f"contains({rest}, {_text(part)})")
        rest = f"substring({rest}, locate({_text(part)}, {rest}) + {len(part)})"
    if len(plain) < len(parts):
        tests.append(f"rlike({rest}, {_text(tx.WORD)})")
    return _all(tests)


def _rule_words(rules: dict) -> list[str]:
    return sorted({w for tiers in rules.values() for tier in ("primary", "secondary")
                   for k in tiers[tier] for w in k.split() if _PLAIN_WORD.fullmatch(w)})


def score_columns(prompts: DataFrame, rules: dict | None = None, text: str = "normalized_query") -> DataFrame:
    """Adds ``scores``: per category its order, raw score and share of the maximum.

    Keywords are looked up in the (few) lexicon words a text holds; the text itself is
    searched only for multi-word keywords and phrases whose words all occur.
    """
    rules = rules or RULES
    body = F.col(text)

    def score(order: int, category: str, tiers: dict) -> Column:
        raw = " + ".join(
            f"IF({(_phrase_test if tier == 'phrases' else _keyword_test)(text, p)}, {TIER_WEIGHTS[tier]}, 0)"
            for tier, patterns in tiers.items() for p in patterns)
        top = sum(TIER_WEIGHTS[tier] * len(patterns) for tier, patterns in tiers.items())
        return F.expr(f"named_struct('cat_ord', {order}, 'category', {_text(category)}, 'raw_score', {raw}, 'top', {top})")

    scores = F.array(*[score(i, c, tiers) for i, (c, tiers) in enumerate(rules.items())])
    present = F.filter(tx.word_set(F.col("_vocabulary")), lambda w: w.isin(_rule_words(rules)))
    return (
        prompts.withColumn("_vocabulary", tx.vocabulary(body))
        .withColumn("_present", F.array_distinct(present))
        .withColumn("scores", _with_share(scores)).drop("_present", "_vocabulary")
    )


def _with_share(scores: Column) -> Column:
    return F.transform(scores, lambda s: F.struct(
        s["cat_ord"].alias("cat_ord"), s["category"].alias("category"), s["raw_score"].alias("raw_score"),
        (s["raw_score"] / s["top"]).alias("normalized_score")))


def _best(scores: Column, value: str) -> Column:
    """Highest ``value``; among equals the category declared first."""
    return F.array_max(F.transform(scores, lambda s: F.struct(
        s[value].alias("v"), (-s["cat_ord"]).alias("r"), s["category"].alias("category"),
        s["raw_score"].alias("raw_score"))))


def _rule_rows(rules: DataFrame) -> DataFrame:
    """Patterns with kind, weight and the sum of weights of their category."""
    unknown = F.raise_error(F.concat(F.lit("no weight and no known tier: "), F.col("pattern")))
    usual = F.element_at(F.create_map(*[F.lit(x) for pair in TIER_WEIGHTS.items() for x in pair]), F.col("tier"))
    weight = F.coalesce(*([F.col("weight")] if "weight" in rules.columns else []), usual, unknown.cast("int"))
    regex = F.col("is_regex") if "is_regex" in rules.columns else F.col("tier") == "phrases"
    rows = rules.withColumn("weight", weight.cast("double")).withColumn(
        "kind", F.when(regex, automata.PHRASE).otherwise(automata.KEYWORD))
    return _with_top(rows.select("cat_ord", "category", "kind", "pattern", "weight").distinct())


def _with_top(rows: DataFrame) -> DataFrame:
    top = rows.groupBy("cat_ord", "category").agg(F.sum("weight").alias("top"))
    return rows.join(top, ["cat_ord", "category"])


def _found_scores(prompts: DataFrame, rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, like ``scores`` but of categories with hits only."""
    path, blocks = automata.write_blocks(rows, "patterns", ["category", "pattern"])
    found = automata.with_found(prompts, text, out, automata.SCORE, path, blocks, automata.rule_finder)
    if blocks > 1:  # a category may have hits in several blocks
        same = lambda s: F.filter(out, lambda x: (x["cat_ord"] == s["cat_ord"]) & (x["category"] == s["category"]))
        total = lambda s: F.aggregate(same(s), F.lit(0.0), lambda t, x: t + x["raw_score"])
        found = found.withColumn(out, F.array_distinct(F.transform(out, lambda s: s.withField("raw_score", total(s)))))
    return found


def classify_by_table(prompts: DataFrame, rules: DataFrame, text: str = "normalized_query") -> DataFrame:
    """``classify`` with a rule table of any size, like ``lexicons.rule_frame``.

    Weights are those of the table; where it has none, those of the tiers. Rows are kept with all their
    columns; a NULL text has no hits.
    """
    scored = _found_scores(prompts, _rule_rows(rules), text, "scores").withColumn("scores", _with_share(F.col("scores")))
    done = _classified(scored)
    return done.withColumn("rule_raw_score", F.coalesce("rule_raw_score", F.lit(0.0)))


def classify_legacy_by_table(prompts: DataFrame, keywords: DataFrame, text: str = "normalized_query") -> DataFrame:
    """``classify_legacy`` with a keyword table of any size, like ``lexicons.keyword_frame``."""
    rows = _with_top(keywords.select("cat_ord", "category", F.lit(automata.ANYWHERE).alias("kind"), F.col("keyword").alias("pattern"),
                                     F.lit(1.0).alias("weight")).distinct())
    return _legacy(_found_scores(prompts, rows, text, "_scores").withColumn("_scores", _with_share(F.col("_scores"))))


def classify(prompts: DataFrame, rules: dict | None = None, text: str = "normalized_query") -> DataFrame:
    """Adds ``rule_category``, ``rule_confidence`` and ``rule_raw_score``."""
    return _classified(score_columns(prompts, rules, text))


def _classified(scores: DataFrame) -> DataFrame:
    scored = scores.withColumn("_best", _best(F.col("scores"), "normalized_score"))
    base = F.least(F.col("_best.v") * 1.5, F.lit(1.0))
    boosted = F.when(F.col("_best.raw_score") >= 8, F.least(base + 0.2, F.lit(1.0))).otherwise(base)
    hit = F.col("_best.raw_score") > 0
    return (
        scored
        .withColumn("rule_category", F.when(hit, F.col("_best.category")).otherwise(FALLBACK_CATEGORY))
        .withColumn("rule_confidence", F.when(hit, boosted).otherwise(F.lit(0.05)))
        .withColumn("rule_raw_score", F.col("_best.raw_score"))
        .drop("scores", "_best")
    )


def rule_scores(prompts: DataFrame, key: str = "prompt_id", rules: dict | None = None, text: str = "normalized_query") -> DataFrame:
    """One row per prompt and category."""
    return score_columns(prompts, rules, text).select(key, F.inline_outer("scores"))


def classify_legacy(prompts: DataFrame, keywords: dict | None = None, text: str = "normalized_query") -> DataFrame:
    """Older rules: share of a category's keywords found anywhere in the text."""
    keywords = keywords or LEGACY_KEYWORDS

    def score(order: int, category: str, words: tuple[str, ...]) -> Column:
        raw = " + ".join(f"int(contains({text}, {_text(w)}))" for w in words)
        return F.expr(
            f"named_struct('cat_ord', {order}, 'category', {_text(category)}, 'raw_score', {raw}, 'top', {len(words)})")

    scores = _with_share(F.array(*[score(i, c, w) for i, (c, w) in enumerate(keywords.items())]))
    return _legacy(prompts.withColumn("_scores", scores))


def _legacy(scores: DataFrame) -> DataFrame:
    scored = scores.withColumn("_best", _best(F.col("_scores"), "normalized_score"))
    hit = F.col("_best.v") > 0
    return (
        scored
        .withColumn("legacy_category", F.when(hit, F.col("_best.category")).otherwise(FALLBACK_CATEGORY))
        .withColumn("legacy_confidence", F.when(hit, F.least(F.col("_best.v") * 2, F.lit(1.0))).otherwise(F.lit(0.3)))
        .drop("_scores", "_best")
    )
