"""Columns of token lists inside Arrow functions: tokens become numbers, and a distinct one is worked on once a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a column, and where each list ends among them; NULL is as an empty list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def mapped(lists: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """The lists with ``one`` of every token."""
    tokens, ends = _flat(lists)
    coded = tokens.dictionary_encode()
    made = pa.array([w if w is None else one(w) for w in coded.dictionary.to_pylist()], tokens.type).take(coded.indices)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, mask=lists.is_null())


class Numbered:
    """Two columns of token lists as numbers that are equal where the tokens are."""

    def __init__(self, left: pa.Array, right: pa.Array):
        (own, self._own), (other, self._other) = _flat(left), _flat(right)
        coded = pa.concat_arrays([own, other]).dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        self._numbers = coded.indices.to_numpy(zero_copy_only=False)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the left column one row after the other, and how many each row has."""
        return self._numbers[:self._own[-1]], np.diff(self._own)

    def other(self) -> tuple[np.ndarray, np.ndarray]:
        return self._numbers[self._own[-1]:], np.diff(self._other)

    def pairs(self, numbers: np.ndarray | None = None) -> Iterator[tuple[list[int], list[int]]]:
        """Both lists of every row; ``numbers``: what stands for each of ``words``, else their places."""
        all_of = self._numbers if numbers is None else numbers[self._numbers]
        own, other = self._own.tolist(), (self._other + self._own[-1]).tolist()
        for i in range(len(own) - 1):
            yield all_of[own[i]:own[i + 1]].tolist(), all_of[other[i]:other[i + 1]].tolist()

    def numbers_of(self, one: Callable[[str], str]) -> tuple[np.ndarray, list[str]]:
        """A number for each of ``words``, equal where ``one`` of them is, and what the numbers stand for."""
        forms: dict[str, int] = {}
        numbers = [forms.setdefault(one(w), len(forms)) for w in self.words]
        return np.array(numbers, np.int64), list(forms)
