"""The stemmer of ``functions.porter`` for token lists: a text is stemmed inside its row, nothing is shuffled.

A distinct word is looked up once a batch. A Python worker remembers the stems of the words it met last, a bounded
number of bounded length, so a frequent word is worked out about once per worker.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.functions import token_lists
from promptweir.functions.porter import IRREGULAR, PLURAL_RULES, STEP2_RULES, STEP3_RULES, STEP4_SUFFIXES

REMEMBERED, LONGEST = 1 << 17, 40
_STEP4_RULES = {suffix: "" for suffix in STEP4_SUFFIXES}


def spelling(word: str) -> str:
    """The word spelt in c and v; y is a vowel exactly after a consonant."""
    out = []
    before = "v"
    for letter in word:
        before = "v" if letter in "aeiou" or (letter == "y" and before == "c") else "c"
        out.append(before)
    return "".join(out)


def _ends_cvc(word: str, cv: str) -> bool:
    return (cv.endswith("cvc") and word[-1] not in "wxy") or cv == "vc"


def _cut(word: str, cv: str, n: int, add: str = "") -> tuple[str, str]:
    end = len(word) - n
    return word[:end] + add, cv[:end] + "".join("v" if a in "aeiou" else "c" for a in add)


def _suffix(word: str, rules: dict[str, str]) -> str:
    """The longest suffix of the word that is in the rules."""
    for n in range(min(len(word), 7), 0, -1):
        if word[-n:] in rules:
            return word[-n:]
    return ""


def _past(word: str, cv: str) -> tuple[str, str]:
    if word.endswith("ied"):
        return _cut(word, cv, 1 if len(word) == 4 else 2)
    if word.endswith("eed"):
        return _cut(word, cv, 1) if "vc" in cv[:-3] else (word, cv)
    n = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
    if not n or "v" not in cv[:-n]:
        return word, cv
    word, cv = _cut(word, cv, n)
    if word.endswith(("at", "bl", "iz")):
        return _cut(word, cv, 0, "e")
    if len(word) > 1 and cv[-1] == "c" and word[-1] == word[-2]:
        return (word, cv) if word[-1] in "lsz" else _cut(word, cv, 1)
    return _cut(word, cv, 0, "e") if cv.count("vc") == 1 and _ends_cvc(word, cv) else (word, cv)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    cv = spelling(word)
    if word.endswith("ies") and len(word) == 4:
        word, cv = _cut(word, cv, 1)
    elif suffix := _suffix(word, PLURAL_RULES):
        word, cv = _cut(word, cv, len(suffix), PLURAL_RULES[suffix])
    word, cv = _past(word, cv)
    if word.endswith("y") and len(word) > 2 and cv[-2] == "c":
        word, cv = _cut(word, cv, 1, "i")
    if word.endswith("alli") and "vc" in cv[:-4]:
        word, cv = _cut(word, cv, 2)
    for rules, least in ((STEP2_RULES, 1), (STEP3_RULES, 1), (_STEP4_RULES, 2)):
        suffix = _suffix(word, rules)
        measured = cv[:len(word) - (3 if suffix == "logi" else len(suffix))]
        if suffix and measured.count("vc") >= least and (suffix != "ion" or word.endswith(("sion", "tion"))):
            word, cv = _cut(word, cv, len(suffix), rules[suffix])
    if word.endswith("e"):
        m = cv[:-1].count("vc")
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1], cv[:-1])):
            word, cv = _cut(word, cv, 1)
    if word.endswith("ll") and cv[:-1].count("vc") > 1:
        word, cv = _cut(word, cv, 1)
    return word


@lru_cache(REMEMBERED)
def _remembered(word: str) -> str:
    return stem(word)


def stem_from(word: str, least: int) -> str:
    """The stem of a word of at least ``least`` code points, any other as it is."""
    return word if len(word) < least else _remembered(word) if len(word) <= LONGEST else stem(word)


def _stemmed(least: int):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stem_lists(lists: pa.Array) -> pa.Array:
        return token_lists.mapped(lists, lambda w: stem_from(w, least))
    return stem_lists


def stemmed(tokens: Column | str, least: int) -> Column:
    """The tokens of a list with their stems in place of those of at least ``least`` code points."""
    return _stemmed(least)(tokens)
