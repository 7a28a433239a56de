"""METEOR with the exact, stem and synonym stages; a pair of texts stays one row."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.functions import text as tx
from promptweir.functions import token_lists, word_stems

# --- fixed values: metric parameters ---------------------------------------------------
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5

STEM_FROM_LENGTH = 1
#: Pairs whose tokens are aligned at a time.
ROWS = 256

_FOUND = T.StructType([T.StructField("matched", T.IntegerType()), T.StructField("chunks", T.IntegerType())])


def tokens(text: Column) -> Column:
    """Lower-case white-space tokens."""
    return F.transform(tx.tokens(text), F.lower)


def _last(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with equal keys, from the end: the last place of a key on one side with the last on the other."""
    orders = [np.argsort(keys, kind="stable") for keys in (own, other)]
    known = [np.unique(keys[order], return_counts=True) for keys, order in zip((own, other), orders)]
    _, *common = np.intersect1d(*[keys for keys, _ in known], assume_unique=True, return_indices=True)
    least = np.minimum(*[counts[at] for (_, counts), at in zip(known, common)])
    nth = np.arange(least.sum()) - np.repeat(np.cumsum(least), least)  # -1 is a key's last place, -2 the one before
    return tuple(order[np.repeat(np.cumsum(counts)[at], least) + nth] for order, (_, counts), at in zip(orders, known, common))


def _synonyms(own: dict, other: dict, sets: dict, found: dict[int, int]) -> None:
    """From the end, each free form takes the last free form of the other text that shares a set with it."""
    places = defaultdict(list)
    for at, form in other.items():
        for one in sets.get(form, ()):
            places[one].append(at)
    taken: set[int] = set()
    for at in reversed(own):
        best = -1
        for one in sets.get(own[at], ()):
            free = places[one]
            while free and free[-1] in taken:
                free.pop()
            if free:
                best = max(best, free[-1])
        if best >= 0:
            taken.add(best)
            found[at] = best


def _by_row(places: np.ndarray, rows: np.ndarray, forms: np.ndarray, n: int) -> list[dict]:
    """The forms at some places, in order, as a dictionary for each of ``n`` rows."""
    ends = np.searchsorted(rows[places], np.arange(n + 1)).tolist()
    at, said = places.tolist(), forms[places].tolist()
    return [dict(zip(at[i:j], said[i:j])) for i, j in zip(ends, ends[1:])]


def alignments(words, sizes, other_words, other_sizes, forms: np.ndarray, sets: Callable[[int], dict] | None = None) -> list[np.ndarray]:
    """Matched tokens of many pairs and the chunks they form.

    words, other_words: the words of all pairs one after the other, as numbers; sizes: how many each pair has;
    forms: the stem of each word, as a number; sets: the synonym sets of the stems of a pair.
    """
    n = len(sizes)
    numbers = (words.astype(np.int64), other_words.astype(np.int64))
    rows = [np.repeat(np.arange(n), s) for s in (sizes, other_sizes)]
    stems = [forms[x] for x in numbers]
    keys = lambda side, x: rows[side] * (len(forms) + 1) + x[side]
    free, found = [np.arange(len(x)) for x in numbers], [[], []]
    for said in (numbers, stems):
        pairs = _last(*[keys(side, said)[free[side]] for side in (0, 1)])
        for side in (0, 1):
            found[side].append(free[side][pairs[side]])
            free[side] = np.delete(free[side], pairs[side])
    if sets:
        for i, (own, other) in enumerate(zip(*[_by_row(free[side], rows[side], stems[side], n) for side in (0, 1)])):
            more: dict[int, int] = {}
            if own and other:
                _synonyms(own, other, sets(i), more)
            found[0].append(np.array(list(more), np.int64))
            found[1].append(np.array(list(more.values()), np.int64))
    own, other = map(np.concatenate, found)
    order = np.argsort(own)
    own, other, row = own[order], other[order], rows[0][own[order]]
    starts = np.ones(len(own), bool)
    starts[1:] = (np.diff(own) != 1) | (np.diff(other) != 1) | (np.diff(row) != 0)
    return [np.bincount(row, minlength=n), np.bincount(row[starts], minlength=n)]


def _alignments(left: pa.Array, right: pa.Array, sets: tuple[pa.Array, pa.Array] | None = None) -> pa.Array:
    tokens = token_lists.Numbered(left, right)
    forms, stems = tokens.numbers_of(lambda w: word_stems.stem_from(w, STEM_FROM_LENGTH))
    place = {stem: i for i, stem in enumerate(stems)} if sets else {}
    known = lambda i: {place[e["stem"]]: set(e["sets"]) for side in sets if side[i].is_valid for e in json.loads(side[i].as_py())}
    (own, sizes), (other, other_sizes) = tokens.own(), tokens.other()
    ends, other_ends = (np.concatenate([[0], np.cumsum(s)]) for s in (sizes, other_sizes))
    done = [alignments(own[ends[i]:ends[j]], sizes[i:j], other[other_ends[i]:other_ends[j]], other_sizes[i:j], forms,
                       (lambda k, i=i: known(i + k)) if sets else None)
            for i in range(0, len(sizes), ROWS) for j in [min(i + ROWS, len(sizes))]]
    columns = [np.concatenate([d[k] for d in done] or [[]]) for k in (0, 1)]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], ["matched", "chunks"])


@F.arrow_udf(_FOUND)
def _aligned(left: pa.Array, right: pa.Array) -> pa.Array:
    return _alignments(left, right)


@F.arrow_udf(_FOUND)
def _aligned_with_sets(left: pa.Array, right: pa.Array, sets: pa.Array, other_sets: pa.Array) -> pa.Array:
    return _alignments(left, right, (sets, other_sets))


def meteor(candidate: str, reference: str, sets: tuple[str, str] | None = None) -> Column:
    """METEOR of two token arrays, stemmed inside the row.

    A stage pairs equal forms from the end of both texts: the k-th last occurrence on one
    side with the k-th last on the other. The stem stage sees what the exact stage left.

    sets: columns of the two texts with array<struct<stem, sets>>, the synonym sets of their stems;
    without them there is no synonym stage. As in the reference, it looks up the stems that the stem
    stage left: from the end, each takes the last free stem of the other text that shares a set with it.
    """
    # As JSON, so that only the row at work is held as objects.
    found = _aligned_with_sets(candidate, reference, *[F.to_json(s) for s in sets]) if sets else _aligned(candidate, reference)
    m, chunks = found["matched"], found["chunks"]
    precision, recall = m / F.size(candidate), m / F.size(reference)
    mean = precision * recall / (ALPHA * precision + (1 - ALPHA) * recall)
    penalty = GAMMA * F.pow(chunks / m, F.lit(BETA))
    return F.when(m > 0, (1 - penalty) * mean).otherwise(0.0)
