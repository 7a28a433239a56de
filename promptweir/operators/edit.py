"""Edit similarity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs, machine words and cells of a table that are worked on at a time.
PAIRS, WORDS, CELLS = 1024, 1 << 13, 1 << 21
#: Pairs from which working on all at a time is quicker than one after the other.
FEW = 16


def differing(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """What is left of two texts or lists without their common beginning and end, the shorter first."""
    if len(a) > len(b):
        a, b = b, a
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[start:len(a) - end], b[start:len(b) - end]


def distance(a: str, b: str) -> int:
    """Edit distance in code points, by bit vectors: one row of the table is two long integers that say
    where it steps up and where down, and a character of the longer text costs a few operations on them."""
    a, b = differing(a, b)
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    for x in b:
        equal = places.get(x, 0)
        same = ((((equal & up) + up) ^ up) | equal | down) & full
        more = (down | full ^ (same | up)) << 1 | 1
        up, down = ((same & up) << 1 | ~(more | same)) & full, more & same
    return len(b) + up.bit_count() - down.bit_count()


def _codes(texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]


def _carried(bits: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The vectors moved up by one bit, from word to word of the same pair."""
    top = bits >> np.uint64(63)
    bits <<= np.uint64(1)
    bits[1:] |= top[:-1] & inner[1:]
    return bits


def _together(pairs: list[tuple[str, str]]) -> list[int]:
    """``distance`` of many pairs, that with the longest second text first: the bit vectors of all pairs lie one after
    the other in an array of machine words, and a step reads the next character of every second text that has one."""
    own, other = _codes([a for a, _ in pairs]), _codes([b for _, b in pairs])
    symbols, lengths = np.unique(np.concatenate(own)), np.array([len(b) for b in other])
    sizes = np.array([-(-len(a) // 64) for a in own])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    n = int(ends[-1])
    if len(pairs) < FEW:
        return [distance(a, b) for a, b in pairs]
    if len(pairs) > PAIRS or max(n, (len(symbols) + 1) * n // (CELLS // WORDS), len(pairs) * int(lengths[0]) // (CELLS // WORDS)) > WORDS:
        half = len(pairs) // 2
        return _together(pairs[:half]) + _together(pairs[half:])
    number = np.full(int(symbols[-1]) + 2, len(symbols), np.int64)  # the last symbol stands for all others
    number[symbols] = np.arange(len(symbols))
    at = np.concatenate([np.arange(len(a)) for a in own])
    places = np.zeros((len(symbols) + 1) * n, np.uint64)
    word = np.repeat(ends[:-1], [len(a) for a in own]) + (at >> 6)
    np.bitwise_or.at(places, number[np.concatenate(own)] * n + word, np.uint64(1) << (at & 63).astype(np.uint64))
    said = np.zeros((int(lengths[0]), len(pairs)), np.int64)
    for k, b in enumerate(other):
        said[:len(b), k] = number[np.minimum(b, symbols[-1] + 1)] * n
    owner, words = np.repeat(np.arange(len(pairs)), sizes), np.arange(n)
    first = np.zeros(n, np.uint64)
    first[ends[:-1]] = 1
    inner, follows = np.where(first == 1, 0, ~np.uint64(0)).astype(np.uint64), first == 0
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    for j, k in enumerate(active.tolist()):
        m = int(ends[k])
        u, d = up[:m], down[:m]
        equal = places.take(said[j].take(owner[:m]) + words[:m])
        both = equal & u
        total = both + u
        carry = (total < both)[:-1] & follows[1:m]
        while carry.any():
            total[1:] += carry
            wrapped = carry & (total[1:] == 0)
            carry[0] = False
            np.logical_and(wrapped[:-1], follows[2:m], out=carry[1:])
        same = (total ^ u) | equal | d
        more = _carried(d | ~(same | u), inner[:m]) | first[:m]
        less = _carried(same & u, inner[:m])
        np.bitwise_and(more, same, out=d)
        np.bitwise_or(less, ~(more | same), out=u)
    last = ends[1:] - 1
    rest = np.array([len(a) for a in own]) - 64 * (sizes - 1)
    mask = ~np.uint64(0) >> (64 - rest).astype(np.uint64)
    up[last] &= mask
    down[last] &= mask
    steps = np.bitwise_count(up).astype(np.int64) - np.bitwise_count(down)
    return (lengths + np.add.reduceat(steps, ends[:-1])).tolist()


def distances(left: list[str | None], right: list[str | None]) -> list[int | None]:
    """The edit distances of many pairs."""
    found: list[int | None] = [None] * len(left)
    open_pairs = []
    for i, (a, b) in enumerate(zip(left, right)):
        if a is not None and b is not None:
            a, b = differing(a, b)
            found[i] = len(b)
            if a:
                open_pairs.append((i, a, b))
    open_pairs.sort(key=lambda p: -len(p[2]))
    # A few long texts would keep all others' array waiting for them.
    alone = open_pairs[:FEW] if len(open_pairs) > FEW and len(open_pairs[0][2]) > 2 * len(open_pairs[FEW][2]) else []
    for i, a, b in alone:
        found[i] = distance(a, b)
    rest = open_pairs[len(alone):]
    if rest:
        for (i, _, _), x in zip(rest, _together([p[1:] for p in rest])):
            found[i] = x
    return found


@F.arrow_udf(T.IntegerType())
def edit_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(distances(left.to_pylist(), right.to_pylist()), pa.int32())


def edit_similarity(left: Column, right: Column) -> Column:
    """One minus the edit distance over the longer length; 0.0 for two empty texts."""
    sizes = [F.char_length(left), F.char_length(right)]
    return F.when(F.greatest(*sizes) > 0, 1 - edit_distance(left, right) / F.greatest(*sizes)).otherwise(0.0)
