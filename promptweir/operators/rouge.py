"""ROUGE-L on stemmed tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.functions import token_lists, word_stems
from promptweir.operators.edit import differing

STEM_FROM_LENGTH = 4  # shorter tokens are compared as they are


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _lcs(a, b) -> int:
    """Longest common subsequence length, one machine-word operation per 64 cells of what differs."""
    common = min(len(a), len(b))
    a, b = differing(a, b)
    common -= len(a)
    bits: dict = {}
    for i, token in enumerate(a):
        bits[token] = bits.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & bits.get(token, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return common + len(a) - row.bit_count()


@F.arrow_udf(T.IntegerType())
def lcs_length(left: pa.Array, right: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of the stems of two token arrays."""
    tokens = token_lists.Numbered(left, right)
    stems, _ = tokens.numbers_of(lambda w: word_stems.stem_from(w, STEM_FROM_LENGTH))
    return pa.array([_lcs(a, b) for a, b in tokens.pairs(stems)], pa.int32())


def rouge_of(candidate: str, reference: str) -> Column:
    """F1 of the longest common subsequence of the stems of two token arrays."""
    common = lcs_length(candidate, reference)
    precision, recall = common / F.size(candidate), common / F.size(reference)
    return F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
