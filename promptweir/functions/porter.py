"""Porter stemming (with the usual published extensions) as column expressions.

A word ``_w`` travels with its spelling ``_cv`` in ``c`` and ``v`` for consonant and vowel. No rule changes the class of a letter it keeps, so ``cv`` is computed once
and cut or extended together with the word. Meant for dictionaries of distinct words;
``functions.word_stems`` has the same rules for the words of a text inside its row.

The rule tables are fixed values of the algorithm; the longest suffix that fits
decides, whether or not its condition holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: irregular forms ---------------------------------------------------
IRREGULAR: dict[str, str] = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# --- fixed values: suffix rules ------------------------------------------------------
PLURAL_RULES = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP2_RULES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful", "logi": "log",
}
STEP3_RULES = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4_SUFFIXES = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _cv_of(suffix: str) -> str:
    return "".join("v" if ch in "aeiou" else "c" for ch in suffix)


def spelling(word: Column) -> Column:
    """``word`` spelt in c and v; y is a vowel exactly after a consonant."""
    marks = F.regexp_replace(F.regexp_replace(word, "[^aeiouy]", "c"), "[aeiou]", "v")
    # Runs of y alternate. Pairs first, each starting where the last one ended; what is
    # left is at most one y per run.
    marks = F.regexp_replace(marks, r"(?:(?<=^|v)|\G(?!^))yy", "cv")
    marks = F.regexp_replace(marks, r"(?<=^|v)y", "c")
    marks = F.regexp_replace(marks, r"(?:(?<=c)|\G(?!^))yy", "vc")
    return F.regexp_replace(marks, "y", "v")


def _w(n: int = 0) -> Column:
    return F.left("_w", F.char_length("_w") - n) if n else F.col("_w")


def _cv(n: int = 0) -> Column:
    return F.left("_cv", F.char_length("_cv") - n) if n else F.col("_cv")


def _above(cv: Column, m: int) -> Column:
    """Measure greater than ``m`` (0 or 1)."""
    return cv.like("%vc" * (m + 1) + "%")


def _ends_cvc(n: int = 0) -> Column:
    """Ends consonant-vowel-consonant (last not w, x, y), after dropping ``n`` letters."""
    last = F.right(_w(n), F.lit(1))
    return (_cv(n).like("%cvc") & ~last.isin("w", "x", "y")) | (_cv(n) == "vc")


def _ends(suffix: str) -> Column:
    return F.endswith("_w", F.lit(suffix))


def _rewrite(df: DataFrame, cut: Column, add: Column | None = None) -> DataFrame:
    """Drop ``cut`` letters and append ``add`` (no y), keeping the spelling in step."""
    df = df.withColumns({"_n": F.char_length("_w") - cut, "_add": F.lit("") if add is None else add})
    return df.withColumns({
        "_w": F.concat(F.left("_w", F.col("_n")), F.col("_add")),
        "_cv": F.concat(F.left("_cv", F.col("_n")), F.translate("_add", "aeioubcdfghlmnrstz", "vvvvv" + "c" * 13)),
    })


def _suffix_step(df: DataFrame, rules: dict[str, str], allowed) -> DataFrame:
    """Rewrite by the longest suffix of ``rules``, if ``allowed(measured part)`` holds."""
    pattern = "(" + "|".join(sorted(rules, key=lambda r: (-len(r), r))) + ")$"
    table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    df = df.withColumn("_suffix", F.regexp_extract("_w", pattern, 1))
    measured = F.left("_cv", F.char_length("_w") - F.char_length("_suffix"))
    fits = (F.col("_suffix") != "") & allowed(measured)
    return _rewrite(
        df, F.when(fits, F.char_length("_suffix")).otherwise(0),
        F.when(fits, F.element_at(table, F.col("_suffix"))).otherwise(""))


def _minus_ed_ing(df: DataFrame) -> DataFrame:
    """-ed and -ing come off a stem with a vowel, which is then tidied."""
    length = F.char_length("_w")
    eed = _ends("eed")
    fixed = eed | _ends("ied")
    gone = ~fixed & ((_ends("ed") & _cv(2).like("%v%")) | (_ends("ing") & _cv(3).like("%v%")))
    cut = (
        F.when(_ends("ied"), F.when(length == 4, 1).otherwise(2))
        .when(eed, F.when(_above(_cv(3), 0), 1).otherwise(0))
        .when(gone, F.when(_ends("ed"), 2).otherwise(3))
        .otherwise(0))
    df = _rewrite(df.withColumn("_gone", gone), cut)
    last = F.right("_w", F.lit(1))
    grows = F.col("_w").rlike("(at|bl|iz)$")
    twin = _cv().like("_%c") & (F.right("_w", F.lit(2)) == F.concat(last, last))
    short = _above(_cv(), 0) & ~_above(_cv(), 1) & _ends_cvc()
    return _rewrite(
        df, F.when(F.col("_gone") & ~grows & twin & ~last.isin("l", "s", "z"), 1).otherwise(0),
        F.when(F.col("_gone") & (grows | (~twin & short)), "e").otherwise(""))


def with_stem(df: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """Adds the stem of a lower-case ``word`` column."""
    df = df.withColumns({"_w": F.col(word), "_cv": spelling(F.col(word))})
    four = _ends("ies") & (F.char_length("_w") == 4)
    df = _rewrite(df.withColumn("_four", four), four.cast("int"))
    df = _suffix_step(df, PLURAL_RULES, lambda cv: ~F.col("_four"))
    df = _minus_ed_ing(df)
    y_ending = _ends("y") & (F.char_length("_w") > 2) & _cv(1).like("%c")
    df = _rewrite(df, y_ending.cast("int"), F.when(y_ending, "i").otherwise(""))
    df = _rewrite(df, F.when(_ends("alli") & _above(_cv(4), 0), 2).otherwise(0))
    # logi is measured with its l.
    df = _suffix_step(df, STEP2_RULES, lambda cv: _above(
        F.when(F.col("_suffix") == "logi", _cv(3)).otherwise(cv), 0))
    df = _suffix_step(df, STEP3_RULES, lambda cv: _above(cv, 0))
    df = _suffix_step(df, {suffix: "" for suffix in STEP4_SUFFIXES}, lambda cv: _above(cv, 1) & (
        (F.col("_suffix") != "ion") | _ends("sion") | _ends("tion")))
    drop_e = _ends("e") & (_above(_cv(1), 1) | (_above(_cv(1), 0) & ~_ends_cvc(1)))
    df = _rewrite(df, drop_e.cast("int"))
    df = _rewrite(df, (_ends("ll") & _above(_cv(1), 1)).cast("int"))
    table = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    stem = (
        F.when(F.col(word).isin(list(IRREGULAR)), F.element_at(table, F.col(word)))
        .when(F.char_length(word) <= 2, F.col(word)).otherwise(F.col("_w")))
    return df.withColumn(out, stem).drop("_w", "_cv", "_n", "_add", "_suffix", "_gone", "_four")
