"""Records of large files that may hold their own separator, read by many tasks.

Spark reads a file in byte ranges and cuts it at every separator: line feeds for quoted CSV, closing
braces for an array of objects. Whether a separator ends a record depends on what stands before
the range. So every range is first followed from each state it may begin in, which gives a small
summary; the summaries of a file, in order, say in which state each range does begin; and a second
reading cuts the records. A record that reaches over ranges leaves a part in each, and only such parts
are put together by key. Parsing stays with Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Protocol
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweir.session import written

Place = tuple[str, int]  # file and first byte of a range
Part = tuple[int, bool, bool, bytes]  # record number, begins here, ends here, text
FLUSH_BYTES = 1 << 22


class Machine(Protocol):
    """How records of a format lie between separators."""

    separator: str

    def summary(self, pieces: Iterable[bytes]) -> list[int]:
        """What a range does, whatever it begins in."""

    def starts(self, summaries: list[list[int]]) -> list[tuple]:
        """For the ranges of a file in order, what each begins in."""

    def parts(self, pieces: Iterable[bytes], start: tuple | None) -> Iterator[Part]:
        """The records of a range; None: it begins the file."""


class QuotedLines:
    """CSV records: a line feed ends one unless a quote is open. A doubled quote opens and closes, so
    the number of quotes alone decides."""

    separator = "\n"

    def __init__(self, quote: str = '"'):
        self.quote = quote.encode()

    def summary(self, pieces):
        """Quotes, and the line feeds that end a record from outside and from inside quotes."""
        quotes, ends = 0, [0, 0]
        for piece in pieces:
            quotes += piece.count(self.quote)
            ends[quotes % 2] += 1
        return [quotes % 2, *ends]

    def starts(self, summaries):
        found, inside, records = [], 0, 0
        for odd, *ends in summaries:
            found.append((inside, records))
            inside, records = inside ^ odd, records + ends[inside]
        return found

    def parts(self, pieces, start):
        inside, record = start or (0, 0)
        held, begins = [], not inside
        for piece in pieces:
            held.append(piece)
            inside = (inside + piece.count(self.quote)) % 2
            if not inside:
                yield record, begins, True, b"\n".join(held)
                held, begins, record = [], True, record + 1
        if held:
            yield record, begins, False, b"\n".join(held) + b"\n"


class ObjectsOfArray:
    """Objects of one JSON array, or objects on their own: a closing brace outside strings ends a record
    if it brings the depth back to where the record began."""

    separator = "}"
    _strings = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.DOTALL)
    _rest = re.compile(rb'(?:[^"\\]|\\.)*+"', re.DOTALL)

    def _step(self, piece: bytes, inside: bool) -> tuple[bool, int]:
        """Whether the brace after a piece stands in a string, and by how much the piece and it change the depth."""
        if inside:
            rest = self._rest.match(piece)
            if not rest:
                return True, 0
            piece = piece[rest.end():]
        bare = self._strings.sub(b"", piece) if b'"' in piece else piece
        open_at = bare.find(b'"')
        if open_at >= 0:
            bare = bare[:open_at]
        change = bare.count(b"{") + bare.count(b"[") - bare.count(b"]")
        return open_at >= 0, change - (open_at < 0)

    def summary(self, pieces):
        """Whether the first character opens an array; and for a start outside and inside a string the end,
        the change of depth, and how often a brace left each depth."""
        ends, depths, left = [False, True], [0, 0], [{}, {}]
        array = None
        for piece in pieces:
            if array is None and piece.strip():
                array = piece.lstrip()[:1] == b"["
            for i in (0, 1):
                ends[i], change = self._step(piece, ends[i])
                depths[i] += change
                if not ends[i]:
                    left[i][depths[i]] = left[i].get(depths[i], 0) + 1
        flat = [[int(ends[i]), depths[i], len(left[i]), *[x for pair in sorted(left[i].items()) for x in pair]] for i in (0, 1)]
        return [int(bool(array)), *flat[0], *flat[1]]

    def starts(self, summaries):
        found, inside, depth, records, base = [], 0, 0, 0, summaries[0][0] if summaries else 0
        for summary in summaries:
            found.append((inside, depth, records, base))
            at = 1 + inside * (4 + 2 * summary[3] - 1)
            end, change, n = summary[at:at + 3]
            left = dict(zip(summary[at + 3:at + 3 + 2 * n:2], summary[at + 4:at + 3 + 2 * n:2]))
            records += left.get(base - depth, 0)
            inside, depth = end, depth + change
        return found

    def parts(self, pieces, start):
        inside, depth, record, base = start or (0, 0, 0, None)
        held: list[bytes] = []
        begins = not inside and (base is None or depth <= base)
        for piece in pieces:
            if base is None and piece.strip():
                base = int(piece.lstrip()[:1] == b"[")
            if not held and begins:
                at = piece.find(b"{")
                if at >= 0:
                    held.append(piece[at:])
            else:
                held.append(piece)
            inside, change = self._step(piece, inside)
            depth += change
            if not inside and depth == base and held:
                yield record, begins, True, b"}".join(held) + b"}"
                held, begins, record = [], True, record + 1
        if held:
            yield record, begins, False, b"}".join(held) + b"}"


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("bytes"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("piece"))


def _named(file: str) -> str:
    """A file's name however Spark writes it."""
    return re.sub("^([a-z0-9]+):/+", r"\1:/", unquote(file))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Place, Iterator[bytes]]]:
    def rows():
        for batch in batches:
            places = zip(batch.column("file").to_pylist(), batch.column("block").to_pylist())
            yield from zip(places, batch.column("piece"))

    for place, own in groupby(rows(), key=itemgetter(0)):
        yield place, (piece.as_py() for _, piece in own)


def records(spark: SparkSession, path: str, machine: Machine) -> DataFrame:
    """(file, record, body) of the files of a path: the number of a file in order of names, the number of a
    record in its file, and its text.

    Two passes over files of several ranges, one over the others, however often the records are used: what is cut
    is written. Of a range only its summary, a few numbers, reaches the driver, which plans the ranges anyway.
    """
    pieces = _pieces(spark, path, machine.separator)
    numbers = {f: i for i, f in enumerate(sorted(map(_named, pieces.inputFiles())))}

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _by_range(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([machine.summary(own)], pa.list_(pa.int64()))],
                ["file", "block", "summary"])

    cut = pieces.where("bytes < size").select("file", "block", "piece")
    told = sorted(map(tuple, cut.mapInArrow(summarise, "file string, block long, summary array<long>").collect()))
    starts: dict[Place, tuple] = {}
    for _, own in groupby(told, key=itemgetter(0)):
        own = list(own)
        starts.update(zip([(f, b) for f, b, _ in own], machine.starts([s for _, _, s in own])))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _by_range(batches):
            rows, size = [], 0
            for record, begins, ends, body in machine.parts(own, starts.get((file, block))):
                rows.append((numbers[_named(file)], record, block, begins and ends, body))
                size += len(body)
                if size > FLUSH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    found = written(pieces.select("file", "block", "piece").mapInArrow(
        parts, "file long, record long, block long, whole boolean, body string"), "records")
    broken = found.where("NOT whole").groupBy("file", "record").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "body"))), lambda p: p["body"]), "").alias("body"))
    return found.where("whole").select("file", "record", "body").unionByName(broken)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, record, block, whole, body = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.int64()), pa.array(record, pa.int64()), pa.array(block, pa.int64()), pa.array(whole), pa.array(body, pa.binary()).cast(pa.string())],
        ["file", "record", "block", "whole", "body"])
