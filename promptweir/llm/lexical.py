"""The best documents for each query text, by scanning the documents with an automaton of all terms.

Queries are a stated set; they are taken in blocks of a fixed number. The distinct terms of a block
become an Aho-Corasick automaton in which every term stands between two blanks, and so does every
term of a text once all other characters are blanks: a match is a whole term, however terms
overlap. A first scan of the documents gives the document frequency of every term and the
corpus figures. A second one counts terms again, scores a portion of documents against all queries of
the block, and each task keeps the best of every query only. No index of documents is made.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptweir.llm.common import parts, small_batches

#: Byte table: A-Z lower-cased; ASCII other than letters and digits is a blank, all else stands.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Queries of a block; documents and bytes of text scored at a time; candidates held until the best are picked.
BLOCK, DOCUMENTS, PORTION, HELD = 256, 256, 1 << 22, 1 << 18
LAST_ID = (1 << 63) - 1


def plain(text: bytes) -> bytes:
    """The text with terms between blanks."""
    return text.translate(TERMS)


class Scanner:
    """Counts given terms in texts."""

    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term.decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def counts(self, text: bytes) -> Counter:
        """Times by number of the term; `text` is plain."""
        return Counter(map(itemgetter(1), self.automaton.iter(f" {text.decode('latin-1')} ")))


def _bodies(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    return (plain(x.as_py() or b"") for x in batch.column(column))


def frequencies(docs: DataFrame, terms: list[bytes], text: str = "text") -> tuple[np.ndarray, int, int]:
    """Documents holding each term, documents with any term (N), and all their terms (L)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, found = Scanner(terms), np.zeros(len(terms) + 2, np.int64)
        for batch in batches:
            for body in _bodies(batch, 0):
                n = len(body.split())
                if n:
                    found[list(scanner.counts(body))] += 1
                    found[-2:] += 1, n
        there = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(found[there])], ["term", "n"])

    rows = docs.select(F.col(text).cast("string").cast("binary").alias("body")).mapInArrow(scan, "term long, n long")
    out = np.zeros(len(terms) + 2, np.int64)
    for row in rows.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per term of the block
        out[row["term"]] = row["n"]
    return out[:-2], int(out[-2]), int(out[-1])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The k best (score, smallest document) of every query seen so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.ones(queries, np.int64)
        self.rows, self.new = [np.zeros(0, np.int64)] * 3, []

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        doc, query = np.nonzero(scores >= self.floor)
        self.new.append((query, scores[doc, query].astype(np.int64), docs[doc]))
        if sum(len(x[0]) for x in self.new) > HELD:
            self.pick()

    def pick(self) -> list[np.ndarray]:
        query, score, doc = (np.concatenate([old, *more]) for old, *more in zip(self.rows, *self.new))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        full = rank == self.k - 1
        self.floor[query[full]] = score[full]
        self.rows, self.new = [query[kept], score[kept], doc[kept]], []
        return self.rows


def _block(docs: DataFrame, queries: list[tuple[object, list[bytes]]], k: int, key: str, text: str) -> DataFrame:
    """(query, doc, score) of a block, at least the k best of every query, `query` being its place."""
    terms = sorted({t for _, own in queries for t in own})
    number = {t: i for i, t in enumerate(terms)}
    df, n_docs, n_terms = frequencies(docs, terms, text)
    weight = weights(df, n_docs)
    pairs = sorted((number[t], q) for q, (_, own) in enumerate(queries) for t in set(own))
    holders = np.array([q for _, q in pairs], np.int64)
    first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(terms) + 1))
    # Below 2**53 sums of whole numbers are exact in doubles, whose products are fast.
    most = max((sum(int(weight[number[t]]) for t in set(own)) for _, own in queries), default=0) * 10 ** 6
    kind = np.float64 if most < 1 << 53 else np.int64

    def scores(found: list[tuple[int, Counter]]) -> np.ndarray:
        """Documents x queries."""
        sizes = [len(c) for _, c in found]
        term = np.fromiter((t for _, c in found for t in c), np.int64, sum(sizes))
        tf = np.fromiter((x for _, c in found for x in c.values()), np.int64, sum(sizes))
        m = 50 + (50 * np.array([n for n, _ in found], np.int64) * n_docs) // n_terms
        doc = np.repeat(np.arange(len(found)), sizes)
        part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        there, column = np.unique(term, return_inverse=True)
        own = np.zeros((len(found), len(there)), kind)
        own[doc, column] = part
        n = first[there + 1] - first[there]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[there], n)
        holds = np.zeros((len(there), len(queries)), kind)
        holds[np.repeat(np.arange(len(there)), n), holders[at]] = 1
        return own @ holds

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, best = Scanner(terms), Best(len(queries), k)
        found, ids, size = [], [], 0
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), _bodies(batch, 1)):
                if there := scanner.counts(body):
                    found.append((len(body.split()), there))
                    ids.append(LAST_ID if doc is None else doc)
                    size += len(body)
                if len(found) == DOCUMENTS or size > PORTION:
                    best.add(scores(found), np.array(ids, np.int64))
                    found, ids, size = [], [], 0
        if found:
            best.add(scores(found), np.array(ids, np.int64))
        query, score, doc = best.pick()
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(doc, mask=doc == LAST_ID), pa.array(score)], ["query", "doc", "score"])

    narrow = docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary"))
    return narrow.mapInArrow(scan, "query long, doc long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, query_key: str = "item_id", query_text: str = "text",
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """query key, rank from 1, document key and score of the `k` best documents of every query.

    Terms are longest runs of ASCII letters, ASCII digits and characters beyond ASCII, A-Z
    lower-cased. Rows of one query id are one query with the terms of all; a query without a term, or
    whose terms no document holds, has no rows. Every row of `docs` is a document of its own; a NULL
    text has no terms, and NULL ids come last among equal scores. Scores are whole numbers:
    see `weights` and `_block`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = queries.select(F.col(query_key).cast("long").alias("id"), F.col(query_text).cast("string").cast("binary").alias("body"))
    blocks = parts(named.select(F.count_distinct(F.coalesce("id", F.lit(LAST_ID)))).first()[0], BLOCK)
    found = []
    for b in range(blocks):
        own: dict[int | None, set[bytes]] = {}
        block = named.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else named
        for row in block.collect():  # about BLOCK queries, a fixed number
            own.setdefault(row["id"], set()).update(plain(bytes(row["body"] or b"")).split())
        wanted = sorted(((q, sorted(t)) for q, t in own.items() if t), key=lambda x: (x[0] is None, x[0] or 0))
        if wanted:
            names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(wanted)], f"query long, {query_key} long")
            found.append(_block(docs, wanted, k, key, text).join(F.broadcast(names), "query"))  # BLOCK rows
    if not found:
        return spark.createDataFrame([], f"{query_key} long, rank int, {key} long, score long")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        query_key, "rank", F.col("doc").alias(key), "score")
