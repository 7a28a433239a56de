"""BLEU as n-gram counting jobs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.functions import text as tx
from promptweir.functions import token_lists

MAX_ORDER = 4

# --- fixed values: the 13a tokenisation, applied in this order ------------------------
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
TOKEN_RULES = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)


def spelt(pattern: str) -> str:
    """The pattern with the characters of its classes one by one and without the blank: Java finds single characters
    in a table, but asks the ranges of a class one after the other, which took most of the time of a pair.

    The first rule would only make more blanks of one. That changes no token: the other rules look at two neighbours,
    and a blank is part of one match at most.
    """
    def members(found: re.Match) -> str:
        kept = [chr(c) for c in range(128) if chr(c) != " " and re.fullmatch(f"[{found[2]}]", chr(c))]
        return f"[{found[1]}{''.join(map(re.escape, kept))}]"
    return re.sub(r"\[(\^?)((?:\\.|[^\]])+)\]", members, pattern)


_SPELT_RULES = tuple((spelt(pattern), replacement) for pattern, replacement in TOKEN_RULES)


def tokens_13a(text: Column) -> Column:
    # Trailing white space goes first; it cannot become a token, but it decides
    # whether a final hyphen joins a line break.
    line = F.rtrim(text, F.lit(tx.SPACE_CHARS))
    line = F.replace(line, F.lit("<skipped>"), F.lit(""))
    line = F.replace(F.replace(line, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, char in ENTITIES:
        line = F.replace(line, F.lit(entity), F.lit(char))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, replacement in _SPELT_RULES:
        line = F.regexp_replace(line, pattern, replacement)
    return tx.tokens(line)


COUNTS = [f"{x}{n}" for x in "mt" for n in range(1, MAX_ORDER + 1)] + ["ref_len"]


def _counts(own: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray, words: int) -> list[np.ndarray]:
    """``COUNTS`` of many pairs: clipped matches by order, candidate n-grams by order, tokens of the reference.

    An n-gram of a row is numbered by its first n - 1 tokens, which are numbered before, and its last one. Only those
    that both sides of the row hold go on to the next order, as others are no part of a match.
    """
    rows = len(sizes)
    row = np.concatenate([np.repeat(np.arange(rows), sizes), np.repeat(np.arange(rows), other_sizes)])
    tokens = np.concatenate([own, other]).astype(np.int64)
    ends = np.concatenate([np.cumsum(sizes), len(own) + np.cumsum(other_sizes)])
    ends = np.concatenate([np.repeat(ends[:rows], sizes), np.repeat(ends[rows:], other_sizes)])
    at, before, matched = np.arange(len(tokens)), row, []
    for n in range(1, MAX_ORDER + 1):
        keys, grams = np.unique(before * max(words, 1) + tokens[at + n - 1], return_inverse=True)
        mine = at < len(own)
        both = np.minimum(np.bincount(grams[mine], minlength=len(keys)), np.bincount(grams[~mine], minlength=len(keys)))
        where = np.zeros(len(keys), np.int64)
        where[grams] = row[at]
        matched.append(np.bincount(where, weights=both, minlength=rows).astype(np.int64))
        on = (both[grams] > 0) & (at + n < ends[at])
        at, before = at[on], grams[on]
    return [*matched, *[np.maximum(sizes - n, 0) for n in range(MAX_ORDER)], other_sizes]


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def ngram_matches(candidate: pa.Array, reference: pa.Array) -> pa.Array:
    """The counts of a pair of token arrays; pairs stay rows and n-grams never leave one."""
    tokens = token_lists.Numbered(candidate, reference)
    columns = _counts(*tokens.own(), *tokens.other(), len(tokens.words))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


def ngram_counts(pairs: DataFrame, keys: list[str], candidate: str, reference: str) -> DataFrame:
    """Per pair: clipped matches ``m1..m4``, candidate totals ``t1..t4``, ``ref_len``."""
    return pairs.select(*keys, ngram_matches(candidate, reference).alias("_c")).select(*keys, "_c.*")


def _score(effective_order: bool, at=F.col) -> Column:
    """BLEU in [0, 1] from the counts, with exponential smoothing of empty orders."""
    m = [at(f"m{n}") for n in range(1, MAX_ORDER + 1)]
    t = [at(f"t{n}") for n in range(1, MAX_ORDER + 1)]
    ref_len = at("ref_len")
    logs, zeros = F.lit(0.0), F.lit(0)
    for matches, total in zip(m, t):
        zeros = zeros + F.when(matches == 0, 1).otherwise(0)
        share = F.when(matches == 0, 1.0 / F.pow(F.lit(2.0), zeros)).otherwise(matches.cast("double")) / total
        logs = logs + F.when(total > 0, F.log(share)).otherwise(0.0)
    orders = sum((F.when(total > 0, 1).otherwise(0) for total in t[1:]), F.when(t[0] > 0, 1).otherwise(0))
    brevity = F.when(t[0] < ref_len, F.exp(1 - ref_len / t[0])).otherwise(1.0)
    none = (m[0] + m[1] + m[2] + m[3]) == 0
    if not effective_order:
        none = none | (t[-1] == 0)
    return F.when(none, 0.0).otherwise(brevity * F.exp(logs / orders))


def bleu_of(candidate: str, reference: str) -> Column:
    """Sentence BLEU of two token arrays."""
    counts = ngram_matches(candidate, reference)
    return _score(True, lambda name: counts[name])


def sentence_bleu(pairs: DataFrame, keys: list[str], candidate: str, reference: str) -> DataFrame:
    return ngram_counts(pairs, keys, candidate, reference).select(*keys, _score(True).alias("bleu"))


def corpus_bleu(counts: DataFrame, group: list[str]) -> DataFrame:
    """One score per group from summed counts; an order without n-grams gives 0."""
    sums = counts.groupBy(*group).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return sums.select(*group, _score(False).alias("bleu"))
