"""Word shingles of whole texts as 64-bit hashes, computed for many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[32, 9, 10, 11, 12, 13]] = False
#: Texts are handled in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 19
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for i, base in enumerate((_BASE, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and each text's first word (len + 1)."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    last = np.cumsum([len(x) + 1 for x in raw])
    return hashes, np.concatenate(([0], np.searchsorted(starts, last)))


def sets(texts: Iterable[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text, in order.

    A text with fewer words than the width has its whole sequence as one shingle; without words
    the set is empty, as it is for NULL.
    """
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= GROUP_BYTES:
            yield from _sets(group, width)
            group, size = [], 0
    if group:
        yield from _sets(group, width)


def _sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    hashes, first = word_hashes(texts)
    n = max(0, len(hashes) - width + 1)
    rolled = hashes[:n].copy()
    for j in range(1, width):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[j:n + j]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            one = np.sort(rolled[a:b - width + 1])
            yield one[np.concatenate(([True], one[1:] != one[:-1]))]
        elif b > a:
            short = np.array([b - a], np.uint64)
            for at in range(a, b):
                short = mix(short * np.uint64(0xA0761D6478BD642F) + hashes[at:at + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)
