"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word forwards and backwards and gives every byte a distribution
over languages; a document's probabilities are the means over all its bytes. Training is
backpropagation through time in numpy. States start anew at white space, so a worker evaluates
a word once and looks it up where it occurs again; every byte of a text still counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from promptweir.llm.common import remainder, small_batches

#: Documents the network learns from, at most, in order of a hash of their id, and words of each,
#: at even distances over the whole text.
TRAINING_DOCS, TRAINING_WORDS = 4_000, 32
HIDDEN, SEGMENT = 12, 24
UNKNOWN = "und"
#: Segments whose pooled probabilities a worker remembers.
REMEMBERED = 150_000
#: Characters of text whose new segments are evaluated together.
PORTION = 1_500_000


def segments(text: str) -> list[bytes]:
    """The words of a text as bytes; longer ones are cut."""
    words = text.encode("utf-8", "surrogatepass").split()
    if any(len(x) > SEGMENT for x in words):
        words = [x[i:i + SEGMENT] for x in words for i in range(0, len(x), SEGMENT)]
    return words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Direction:
    """A gated recurrent layer; `inputs` holds update, reset and candidate terms for each byte."""

    inputs: np.ndarray
    recurrent: np.ndarray

    def run(self, codes: np.ndarray, keep: bool = False):
        """States of shape (time, batch, hidden) for codes of shape (time, batch)."""
        hidden = self.recurrent.shape[0]
        h = np.zeros((codes.shape[1], hidden), np.float32)
        states, trail = np.empty((*codes.shape, hidden), np.float32), []
        for t, code in enumerate(codes):
            x, u = self.inputs[code], h @ self.recurrent
            gates = _sigmoid(x[:, :2 * hidden] + u[:, :2 * hidden])
            z, r, a = gates[:, :hidden], gates[:, hidden:], u[:, 2 * hidden:]
            c = np.tanh(x[:, 2 * hidden:] + r * a)
            if keep:
                trail.append((h, z, r, a, c))
            h = c + z * (h - c)
            states[t] = h
        return (states, trail) if keep else states

    def back(self, codes: np.ndarray, trail: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of inputs and recurrent weights from those of the states."""
        hidden = self.recurrent.shape[0]
        d_inputs, d_recurrent = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        dh = np.zeros_like(grad[0])
        for t in range(len(codes) - 1, -1, -1):
            h, z, r, a, c = trail[t]
            dh = dh + grad[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * a * r * (1 - r)
            through = np.concatenate([dz, dr, dc * r], 1)
            d_recurrent += h.T @ through
            np.add.at(d_inputs, codes[t], np.concatenate([dz, dr, dc], 1))
            dh = dh * z + through @ self.recurrent.T
        return d_inputs, d_recurrent


@dataclass
class Model:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.forward.inputs, self.forward.recurrent, self.backward.inputs, self.backward.recurrent,
                self.out, self.bias]

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (time, batch, language) of equally long segments, codes (time, batch)."""
        both = np.concatenate([self.forward.run(codes), self.backward.run(codes[::-1])[::-1]], 2)
        logits = both @ self.out + self.bias
        e = np.exp(logits - logits.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """Summed position probabilities per segment, float32 (segments, languages)."""
        result = np.zeros((len(words), len(self.languages)), np.float32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for at in range(0, len(rows), 2048):
                some = rows[at:at + 2048]
                codes = np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(-1, size).T
                result[some] = self.positions(codes).sum(0)
        return result

    def labels(self, text: str) -> list[str]:
        """The language of every byte position of the segments of a text."""
        found = []
        for word in segments(text):
            best = self.positions(np.frombuffer(word, np.uint8).reshape(-1, 1))[:, 0].argmax(1)
            found += [self.languages[i] for i in best]
        return found


def _new(languages: list[str], hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    direction = lambda: Direction(draw(256, 3 * hidden), draw(hidden, 3 * hidden))
    return Model(languages, direction(), direction(), draw(2 * hidden, len(languages)),
                 np.zeros(len(languages), np.float32))


def gradients(model: Model, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions and its gradients, by backpropagation through time."""
    hidden = model.forward.recurrent.shape[0]
    ahead, trail = model.forward.run(codes, keep=True)
    behind, back_trail = model.backward.run(codes[::-1], keep=True)
    both = np.concatenate([ahead, behind[::-1]], 2)
    logits = both @ model.out + model.bias
    e = np.exp(logits - logits.max(2, keepdims=True))
    p = e / e.sum(2, keepdims=True)
    columns = np.arange(codes.shape[1])
    loss = float(-np.log(np.maximum(p[:, columns, target], 1e-12)).mean())
    p[:, columns, target] -= 1
    p /= codes.size
    d_out = np.einsum("tbh,tbl->hl", both, p)
    d_both = p @ model.out.T
    d_ahead = model.forward.back(codes, trail, d_both[..., :hidden])
    d_behind = model.backward.back(codes[::-1], back_trail, d_both[::-1, :, hidden:])
    return loss, [*d_ahead, *d_behind, d_out, p.sum((0, 1))]


def fit(words: list[bytes], names: list[str], hidden: int = HIDDEN, batches: int = 900, batch: int = 256,
        rate: float = 0.02, seed: int = 7) -> Model | None:
    """Trains with Adam on batches of equally long segments, languages drawn evenly.

    Without words there is no model.
    """
    if not words:
        return None
    languages = sorted(set(names))
    label = np.searchsorted(languages, names)
    model, rng = _new(languages, hidden, seed), np.random.default_rng(seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    even = 1 / np.bincount(label, minlength=len(languages))[label]
    groups = {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes) if s}
    share = np.array([even[g].sum() * s for s, g in groups.items()])
    odds = {s: even[g] / even[g].sum() for s, g in groups.items()}
    weights = model.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    order = rng.choice(list(groups), size=batches, p=share / share.sum())
    for step, size in enumerate(order.tolist(), 1):
        rows = rng.choice(groups[size], size=batch, p=odds[size])
        codes = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(-1, size).T
        _, grads = gradients(model, codes, label[rows])
        pace = rate * min(1.0, 2 * (1 - step / (batches + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (pace * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# --- Spark --------------------------------------------------------------------------------------

@F.pandas_udf(ArrayType(BinaryType()))
def sampled_words(text: pd.Series) -> pd.Series:
    def some(x: str) -> list[bytes]:
        words = segments(x)
        return [words[i] for i in np.unique(np.linspace(0, len(words) - 1, TRAINING_WORDS).astype(int))] if words else []
    return text.map(lambda x: some(x or ""))


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
          rows: int = TRAINING_DOCS) -> Model | None:
    """Learns from at most `rows` documents with a language for which `learn` holds. Only sampled
    words reach the driver, at most TRAINING_WORDS of SEGMENT bytes a document."""
    small_batches(docs.sparkSession)
    known = docs.where(learn & F.col(lang).isNotNull()).select(
        F.col(key).alias("doc_key"), F.col(text).cast("string").alias("doc_text"), F.col(lang).cast("string").alias("name"))
    picked = known.select(F.col("doc_key").alias("picked")).orderBy(F.xxhash64("picked"), "picked").limit(rows).distinct()
    got = known.join(F.broadcast(picked), F.col("doc_key") == F.col("picked")).select(  # at most `rows` rows
        F.xxhash64("picked").alias("h"), "name", sampled_words("doc_text").alias("words")).orderBy(
        "h", "name").limit(rows).toPandas()
    words = [bytes(w) for row in got["words"] for w in row]
    return fit(words, [n for n, row in zip(got["name"], got["words"]) for _ in row])


class Memory:
    """Summed position probabilities of segments that a worker has met; new ones are evaluated
    together for many documents, so the network runs on large batches."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def learn(self, documents: list[list[bytes]]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        new = list(set().union(*documents).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.table = np.concatenate([self.table, self.model.pooled(new)])

    def pooled(self, words: list[bytes]) -> np.ndarray:
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.table[rows].sum(0, dtype=np.float64)


def _portions(texts: pd.Series) -> Iterator[list]:
    some, size = [], 0
    for x in texts:
        some.append(x)
        size += len(x or "")
        if size > PORTION:
            yield some
            some, size = [], 0
    if some:
        yield some


def predictions(model: Model | None, text: Column | str) -> Column:
    """Struct (lang_pred, score): the most likely language and its mean probability over all bytes.

    `und` with score 0 for NULL texts, texts without a letter, and when there is no model.
    """
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory = Memory(model) if model else None
        for batch in batches:
            names, scores = [], []
            for texts in _portions(batch):
                words = [segments(x) if model and x and any(map(str.isalpha, x)) else [] for x in texts]
                if memory:
                    memory.learn(words)
                for own in words:
                    total = memory.pooled(own) if own else None
                    best = int(total.argmax()) if own else 0
                    names.append(model.languages[best] if own else UNKNOWN)
                    scores.append(min(1.0, float(total[best] / total.sum())) if own else 0.0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})
    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(predict, "lang_pred string, score double")(text)


def identify(docs: DataFrame, held_out: int = 0, folds: int = 5, key: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """All columns of `docs` with lang_held_out and the struct `language` (lang_pred, score).

    Documents whose crc32(key) modulo `folds` is `held_out` are never learnt from, nor are those
    with a NULL key; these are not held out. Repeated rows get equal predictions. A column of `docs`
    that has one of the two names gives way.
    """
    fold = remainder(F.col(key), folds)
    model = train(docs, fold != held_out, key, text, lang)
    return docs.withColumns({
        "lang_held_out": F.coalesce(fold == held_out, F.lit(False)),
        "language": predictions(model, F.col(text).cast("string"))})
