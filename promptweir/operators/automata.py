"""Patterns of tables of any size found in texts by Aho-Corasick automata.

A table of patterns is written to the shared folder in blocks of bounded size, and every block is a
pass over the texts: rows keep their place and their columns, a worker builds the automaton of the one
block it is given, and no text is shuffled. Neither patterns nor texts visit the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.session import shared_dir, small_batches

#: Patterns of a block, on average.
BLOCK = 100_000
#: Tokens whose cleaned form a worker remembers.
REMEMBERED = 100_000

_NOT_WORD = re.compile(r"[^\w]")
_PLAIN_PART = re.compile(r"[\w ]+")


def write_blocks(patterns: DataFrame, purpose: str, by: list[str], block: int = BLOCK) -> tuple[str, int]:
    """Folder and number of blocks of a pattern table, dealt by a hash of the columns ``by``."""
    blocks = max(1, -(-patterns.count() // block))
    path = shared_dir(patterns.sparkSession, purpose)
    patterns.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(blocks))).repartition(blocks, "block").write.partitionBy(
        "block").parquet(path)
    return path, blocks


def read_block(path: str, block: int) -> list[dict]:
    """Rows of a block, for a worker: the shared folder is one that all machines reach."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, folder = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(f"{folder}/block={block}", allow_not_found=True))
    return [row for f in found if f.path.endswith(".parquet")
            for row in pq.ParquetFile(files.open_input_file(f.path)).read().to_pylist()]


def automaton(words: dict[str, list]):
    """An automaton whose matches give the lists of ``words``; None without words."""
    import ahocorasick

    if not words:
        return None
    made = ahocorasick.Automaton()
    for word, values in words.items():
        made.add_word(word, values)
    made.make_automaton()
    return made


Finder = Callable[[str], list]


def with_found(frame: DataFrame, text: str, out: str, kind: T.DataType, path: str, blocks: int,
               build: Callable[[list[dict]], Finder]) -> DataFrame:
    """All rows and columns with the array ``out`` of what the finder of every block finds in ``text``.

    A NULL text holds nothing; a column that is named like ``out`` gives way. A worker holds a small batch at a time,
    and of its texts the one at work.
    """
    small_batches(frame.sparkSession)
    frame = frame.drop(out)
    schema = T.StructType([*frame.schema.fields, T.StructField(out, T.ArrayType(kind))])
    for block in range(blocks):
        def scan(batches: Iterator[pa.RecordBatch], block: int = block) -> Iterator[pa.RecordBatch]:
            find = build(read_block(path, block))
            for batch in batches:
                found = [find(x.as_py()) if x.is_valid else [] for x in batch.column(text)]
                if out in batch.schema.names:
                    found = [a + b for a, b in zip(batch.column(out).to_pylist(), found)]
                    batch = batch.select([c for c in batch.schema.names if c != out])
                field = pa.array(found, pa.list_(_arrow(kind)))
                yield pa.RecordBatch.from_arrays([*batch.columns, field], [*batch.schema.names, out])
        frame = frame.mapInArrow(scan, schema)
    return frame


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# --- terms --------------------------------------------------------------------------------------

HIT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("term", T.StringType())])


def term_finder(rows: list[dict]) -> Finder:
    """(0, place of first use, term) for terms of one word that are a cleaned token, (1, 0, term) for terms of
    several words found anywhere. Rows: term, n_words."""
    singles = {r["term"] for r in rows if r["n_words"] == 1}
    several = automaton({r["term"]: r["term"] for r in rows if r["n_words"] > 1})
    known: dict[str, str | None] = {}

    def single(token: str) -> str | None:
        clean = _NOT_WORD.sub("", token)
        return clean if clean in singles else None

    def find(text: str) -> list:
        if len(known) > REMEMBERED:
            known.clear()
        found: dict[str, int] = {}
        tokens = text.split(" ")
        for token in set(tokens).difference(known):
            known[token] = single(token)
        if any(map(known.__getitem__, set(tokens))):
            for i, token in enumerate(tokens):
                term = known[token]
                if term is not None and term not in found:
                    found[term] = i
        hits = [(0, i, term) for term, i in found.items()]
        if several is not None:
            hits += [(1, 0, term) for term in {term for _, term in several.iter(text)}]
        return [dict(zip(("part", "i", "term"), h)) for h in hits]
    return find


EXPANSION = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("chars", T.IntegerType()),
                          T.StructField("expansion", T.StringType())])


def expansion_finder(rows: list[dict]) -> Finder:
    """(place, length of the cleaned token, expansion) of the tokens whose cleaned form is a term of the block.
    Rows: term, expansion."""
    expansions = {r["term"]: r["expansion"] for r in rows}
    known: dict[str, tuple | None] = {}

    def look_up(token: str) -> tuple | None:
        clean = _NOT_WORD.sub("", token)
        return (len(clean), expansions[clean]) if clean in expansions else None

    def find(text: str) -> list:
        if len(known) > REMEMBERED:
            known.clear()
        tokens = text.split(" ")
        distinct = set(tokens)
        for token in distinct.difference(known):
            known[token] = look_up(token)
        if not any(map(known.__getitem__, distinct)):
            return []
        return [{"i": i, "chars": hit[0], "expansion": hit[1]} for i, token in enumerate(tokens) if (hit := known[token])]
    return find


# --- rules --------------------------------------------------------------------------------------

SCORE = T.StructType([T.StructField("cat_ord", T.IntegerType()), T.StructField("category", T.StringType()),
                      T.StructField("raw_score", T.DoubleType()), T.StructField("top", T.DoubleType())])
KEYWORD, PHRASE, ANYWHERE = "keyword", "phrase", "anywhere"


def required(kind: str, pattern: str) -> str:
    """A text without which a pattern cannot be found, the longest there is; empty if none is known."""
    if kind != PHRASE:
        return pattern
    parts = pattern.split(".*")
    plain = parts[:-1] if parts[-1] == r"\w+" and len(parts) > 1 else parts
    return max(plain, key=len) if all(_PLAIN_PART.fullmatch(p) for p in plain) else ""


def rule_finder(rows: list[dict]) -> Finder:
    """(cat_ord, category, raw_score, top) of the categories a text has hits in.

    A pattern is looked for only in texts that hold its required text. Patterns without one, which are
    expressions of other forms than plain parts joined by ``.*``, are tried on every text. Rows: kind,
    pattern, weight, cat_ord, category, top.
    """
    tests: dict[int, re.Pattern] = {}

    def holds(n: int, text: str) -> bool:
        kind, pattern = rows[n]["kind"], rows[n]["pattern"]
        if kind == ANYWHERE:
            return True
        if n not in tests:
            tests[n] = re.compile(pattern if kind == PHRASE else rf"\b{re.escape(pattern)}\b")
        return tests[n].search(text) is not None

    words: dict[str, list[int]] = {}
    for n, r in enumerate(rows):
        words.setdefault(required(r["kind"], r["pattern"]), []).append(n)
    always = words.pop("", [])
    index = automaton(words)

    def find(text: str) -> list:
        likely = {n for numbers in {id(x): x for _, x in index.iter(text)}.values() for n in numbers} if index is not None else set()
        raw: dict[tuple, float] = {}
        for n in [*sorted(likely), *always]:
            if holds(n, text):
                r = rows[n]
                place = (r["cat_ord"], r["category"], r["top"])
                raw[place] = raw.get(place, 0.0) + r["weight"]
        return [{"cat_ord": o, "category": c, "raw_score": s, "top": t} for (o, c, t), s in sorted(raw.items(), key=lambda x: x[0][0])]
    return find
