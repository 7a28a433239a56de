"""Periodic stretches of words within a text, and texts with their repetitions collapsed.

A suffix automaton reads a text word by word. Its suffix links form a tree in which every state
carries the end of its last occurrence; a link-cut tree keeps states with equal ends on one path.
Appending word i recolours the path of the new prefix: a segment that carried end e, its deepest
state of length L, says that the last L words also ended at e. With d = i - e <= L the last L + d
words are a square of period d, and no smaller period: the smaller one would have coloured the
segment later. It reaches as far left as it can, as L is the longest common suffix, and is a whole
run once the next word differs from the word d before it.

Texts are independent rows, so the work is a map over the table. A worker holds one text and the
automaton of a part of it. Before the automaton starts, words are left out that no run of the
wanted length can hold: a run of `least` words and `times` periods is covered by word sequences
that recur within a `times`-th of its length (see `stretches`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.llm.common import small_batches

Run = tuple[int, int, int]  # (start, length, period), in words

LEAST, TIMES = 24, 3
#: Bytes of collapsed texts sent to Spark at a time, and rows of a batch handled at a time.
FLUSH_BYTES, SLICE = 1 << 23, 256


class LastEnds:
    """Suffix automaton whose link tree is a link-cut tree; paths are splay trees by depth.

    State 0 is none, state 1 the empty word. `up` is the parent in a splay tree, or at its root
    the state above the path; `shallow` and `deep` are its children; `end` counts at a root only.
    """

    def __init__(self):
        self.length, self.link, self.steps = [0, 0], [0, 0], [{}, {}]
        self.up, self.shallow, self.deep, self.end = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last = 1

    def _state(self, length: int, link: int, steps: dict) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.steps, steps), (self.up, 0),
                              (self.shallow, 0), (self.deep, 0), (self.end, -1)):
            column.append(value)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Makes x the root of its path's tree."""
        up, shallow, deep = self.up, self.shallow, self.deep

        def rotate(x: int, p: int) -> None:
            g = up[p]
            if shallow[p] == x:
                moved = shallow[p] = deep[x]
                deep[x] = p
            else:
                moved = deep[p] = shallow[x]
                shallow[x] = p
            if moved:
                up[moved] = p
            up[p], up[x] = x, g
            if g:
                if shallow[g] == p:
                    shallow[g] = x
                elif deep[g] == p:
                    deep[g] = x

        top = x
        while (p := up[top]) and (shallow[p] == top or deep[p] == top):
            top = p
        if top == x:
            return
        end = self.end[top]
        while (p := up[x]) and (shallow[p] == x or deep[p] == x):
            g = up[p]
            if g and (shallow[g] == p or deep[g] == p):
                straight = (shallow[g] == p) == (shallow[p] == x)
                rotate(p, g) if straight else rotate(x, p)
                rotate(x, up[x])
            else:
                rotate(x, p)
        self.end[x] = end

    def _copy(self, q: int, length: int) -> int:
        """A state between q and its link, with q's steps; it has ended where q has."""
        c = self._state(length, self.link[q], dict(self.steps[q]))
        self._splay(q)
        above = self.shallow[q]
        self.shallow[c], self.shallow[q] = above, c
        if above:
            self.up[above] = c
        self.up[c], self.link[q] = q, c
        return c

    def append(self, word: int, i: int) -> list[tuple[int, int]]:
        """Reads word i; returns (e, L) of the segments it recolours, with L above 0."""
        length, link, steps = self.length, self.link, self.steps
        p, new = self.last, self._state(i + 1, 1, {})
        while p and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if p:
            q = steps[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                c = self._copy(q, length[p] + 1)
                while p and steps[p].get(word) == q:
                    steps[p][word] = c
                    p = link[p]
                link[new] = c
        self.last = new
        return self._access(new, i)

    def _access(self, new: int, i: int) -> list[tuple[int, int]]:
        up, deep, end, length = self.up, self.deep, self.end, self.length
        found, below, x = [], new, self.link[new]
        while x:
            self._splay(x)
            if length[x]:
                found.append((end[x], length[x]))
            cut = deep[x]
            if cut:  # keeps its end and hangs below x as a path of its own
                end[cut] = end[x]
            deep[x], up[below] = below, x
            below, x = x, up[x]
        end[below] = i
        return found


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of at least `least` words and `times` periods (2 or more), by start and period."""
    tree, n, runs = LastEnds(), len(words), []
    for i, word in enumerate(words):
        for e, common in tree.append(word, i):
            d = i - e
            if common >= (times - 1) * d and common + d >= least and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                runs.append((i - d - common + 1, common + d, d))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Disjoint (first, after) between which lie all runs of `least` words and `times` periods.

    In a run of three periods q or more, every sequence of `least // 3` words recurs q words
    before or after it inside the run (in a run of two, every word), and q is at most a
    `times`-th of the run. So of a stretch of words only those sequences are kept that recur within
    a `times`-th of it, until nothing falls away.
    """
    width, n = max(1, least // 3 if times > 2 else 1), len(ids)
    if n < least:
        return []
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    grams = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + spread[j:j + len(grams)]
    order = np.argsort(grams, kind="stable")
    equal = np.flatnonzero(grams[order][1:] == grams[order][:-1])
    if not len(equal):
        return []
    near = np.full(len(grams), n, np.int64)  # to the nearest equal sequence
    a, b = order[equal], order[equal + 1]
    near[a] = b - a
    near[b] = np.minimum(near[b], b - a)
    done, open_ = [], [(0, n)]
    while open_:
        first, after = open_.pop()
        if after - first < least:
            continue
        kept = near[first:after - width + 1] * times <= after - first
        edge = np.flatnonzero(np.diff(kept, prepend=False, append=False))
        parts = [(first + int(x), first + int(y) + width - 1) for x, y in zip(edge[0::2], edge[1::2])]
        if parts == [(first, after)]:
            done.append(parts[0])
        else:
            open_ += parts
    return sorted(done)


def text_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(ids) < least or len(numbers) == len(ids):
        return []
    found = {(a + start, length, period) for a, b in stretches(np.array(ids, np.int64), least, times)
             for start, length, period in runs_of(ids[a:b], least, times)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType()),
])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES,
                  edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: key, n_words, runs (array of start, length, period in words, by start and
    period) and the collapsed text: words kept, joined by one space.

    Words are longest runs of anything but ASCII white space. `edit` may replace the words of a
    document, given its key, before they are read. A NULL or empty text has no words, no runs and
    an empty collapsed text; NULL and repeated keys are rows like any other; other columns of
    `docs` are left behind.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                rows, size = [], 0
                for doc, body in zip(some.column(0).to_pylist(), some.column(1)):
                    words = (body.as_py() or b"").split()
                    words = edit(doc, words) if edit else words
                    runs = text_runs(words, least, times)
                    rows.append((doc, len(words), runs, b" ".join(collapsed(words, runs))))
                    size += len(rows[-1][3])
                    if size > FLUSH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").cast("binary").alias("body"))
    schema = T.StructType([T.StructField(key, T.LongType()), *FOUND.fields])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        doc, n, runs, texts = zip(*rows)
        flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
        of = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), of),
             pa.array(texts, pa.binary()).cast(pa.string())], [key, "n_words", "runs", "collapsed"])

    return narrow.mapInArrow(find, schema)
