"""A generalised additive model with pairwise interactions that scores the quality of texts.

Every feature has a lookup table over its bins, every chosen pair of features a table over coarse
bins. Boosting goes round the features in cycles; each turn fits one shallow tree to the current
gradient and adds it to the table. A score is a sum of looked-up values, done for whole batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from promptweir.llm.common import remainder, small_batches

#: Labelled documents the model learns from, at most; taken in order of a hash of their id.
TRAINING_ROWS = 20_000
THRESHOLD = 0.7

# --- features -----------------------------------------------------------------------------------

BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t", "stop": b".,;:?", "bang": b"!", "sign": b"#$%&*", "bar": b"|", "mark": b"@_~^`+='\"",
    "bracket": b"<>{}[]()/\\",
}
_CLASSES = np.zeros((256, len(BYTE_CLASSES)), np.float64)
for _i, _chars in enumerate(BYTE_CLASSES.values()):
    _CLASSES[list(_chars), _i] = 1
NAMES = (*BYTE_CLASSES, "words", "word_bytes", "distinct_words", "short_words", "lines", "distinct_lines",
         "line_words", "ended_lines", "longest_word")
_ENDS = (".", "!", "?", ":", ";", '"')


def features(texts) -> np.ndarray:
    """One row of NAMES per text, over the whole text; a NULL text counts as empty."""
    counts = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), len(NAMES) - len(BYTE_CLASSES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = text.split(), [x for x in text.split("\n") if x]
        n, m = max(len(words), 1), max(len(lines), 1)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        rest[i] = (math.log1p(len(words)), sizes.mean(), len(set(words)) / n ** 0.9, (sizes <= 3).mean(),
                   math.log1p(len(lines)), len(set(lines)) / m, math.log1p(n / m),
                   sum(x.endswith(_ENDS) for x in lines) / m, math.log1p(sizes.max()))
    size = np.maximum(counts.sum(1, keepdims=True), 1)
    return np.hstack([counts @ _CLASSES / size, rest])


# --- the model ----------------------------------------------------------------------------------

@dataclass
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], x[:, i], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"),
                           np.searchsorted(self.coarse[j], x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _cut(g: np.ndarray, h: np.ndarray, a: int, b: int, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins a..b-1."""
    if b - a < 2:
        return 0.0, a
    left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
    all_g, all_h = g[a:b].sum(), h[a:b].sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    best = int(np.argmax(gain))
    return float(gain[best]), a + best + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins, grown by the best cut."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        (gain, at), span = max(((_cut(g, h, *s, ridge), s) for s in spans), key=lambda x: x[0][0])
        if gain <= 1e-12:
            break
        spans.remove(span)
        spans += [(span[0], at), (at, span[1])]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts the rows once and each side's columns once."""
    best, value = 0.0, np.zeros_like(g)
    for at in range(1, len(g)):
        gain, leaf = 0.0, np.zeros_like(g)
        for rows in (slice(0, at), slice(at, len(g))):
            side_g, side_h = g[rows].sum(0), h[rows].sum(0)
            more, cut = _cut(side_g, side_h, 0, len(side_g), ridge)
            gain += more + side_g.sum() ** 2 / (side_h.sum() + ridge)
            for columns in (slice(0, cut), slice(cut, len(side_g))):
                leaf[rows, columns] = side_g[columns].sum() / (side_h[columns].sum() + ridge)
        gain -= g.sum() ** 2 / (h.sum() + ridge)
        if gain > best:
            best, value = gain, leaf
    return best, value


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, cycles: int = 120, rate: float = 0.15, leaves: int = 3,
        pairs: int = 8, pair_bins: int = 8, pair_cycles: int = 40, ridge: float = 2.0) -> Model:
    """Without rows, or with one class alone, only the prior is learnt: unknown text is likely good."""
    good = float(y.sum())
    prior = (good + 9) / (len(y) + 10)
    model = Model([_edges(x[:, i], bins) for i in range(x.shape[1])],
                  [_edges(x[:, i], pair_bins) for i in range(x.shape[1])], math.log(prior / (1 - prior)),
                  [np.zeros(0)] * x.shape[1])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if good in (0, len(y)):
        return model
    fine = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.coarse)]
    margin = np.full(len(y), model.intercept)
    for _ in range(cycles):
        for i, at in enumerate(fine):
            p = 1 / (1 + np.exp(-margin))
            size = len(model.tables[i])
            step = rate * _tree(np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size), leaves, ridge)
            model.tables[i] += step
            margin += step[at]
    for i, at in enumerate(fine):  # tables are centred, the means go to the intercept
        mean = float(model.tables[i][at].mean())
        model.tables[i] -= mean
        model.intercept += mean

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        return coarse[i] * shape[1] + coarse[j], shape

    def sums(at: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        n = shape[0] * shape[1]
        return np.bincount(at, y - p, n).reshape(shape), np.bincount(at, p * (1 - p), n).reshape(shape)

    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            at, shape = grid(i, j)
            if min(shape) > 1:
                gains.append((-_pair_tree(*sums(at, shape), ridge)[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains)[:pairs]]
    model.pair_tables = [np.zeros(grid(i, j)[1]) for i, j in model.pairs]
    for _ in range(pair_cycles):
        for k, (i, j) in enumerate(model.pairs):
            at, shape = grid(i, j)
            step = rate * _pair_tree(*sums(at, shape), ridge)[1]
            model.pair_tables[k] += step
            margin += step.ravel()[at]
    return model


# --- Spark --------------------------------------------------------------------------------------

@F.pandas_udf(ArrayType(DoubleType()))
def text_features(text: pd.Series) -> pd.Series:
    return pd.Series(list(features(text.tolist())))


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
          label: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    """Fits the model on at most `rows` labelled documents for which `learn` (a condition on the
    key) holds. Only their feature rows reach the driver."""
    small_batches(docs.sparkSession)
    picked = labels.where(learn & F.col(label).isin(0, 1)).select(
        F.col(key).alias("picked"), F.col(label).cast("double").alias("label")).orderBy(
        F.xxhash64("picked"), "picked", "label").limit(rows)
    narrow = docs.select(F.col(key).alias("doc_key"), F.col(text).cast("string").alias("doc_text"))
    found = narrow.join(F.broadcast(picked), F.col("doc_key") == F.col("picked")).select(  # at most `rows` rows
        F.xxhash64("picked").alias("h"), "label", text_features("doc_text").alias("x"))
    got = found.orderBy("h", "label").limit(rows).toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(NAMES))
    return fit(x, got["label"].to_numpy(float))


def scores(model: Model, text: Column | str) -> Column:
    """Score between 0 and 1 of a text column, higher for better text; defined for any text."""
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(features(batch.tolist())))
    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, DoubleType())(text)


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """All columns of `docs` with quality_held_out, quality_score and quality_ok.

    Documents whose crc32(key) modulo `folds` is `held_out` are never learnt from. NULL and empty
    texts get the score of a text without bytes; a NULL key is not learnt from and not held out;
    repeated rows get equal scores; without labels every text gets the prior. A column of `docs` that
    has one of the three names gives way.
    """
    fold = remainder(F.col(key), folds)
    model = train(docs, labels, fold != held_out, key, text)
    scored = docs.withColumns({
        "quality_held_out": F.coalesce(fold == held_out, F.lit(False)),
        "quality_score": scores(model, F.col(text).cast("string"))})
    return scored.withColumn("quality_ok", (F.col("quality_score") >= THRESHOLD).cast("int"))
