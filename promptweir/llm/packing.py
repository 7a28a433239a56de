"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are whole numbers below the capacity, so a packing is decided on their histogram, whose
size depends on the capacity alone: documents above a third of the capacity are matched greedily,
the longest with the longest partner that still fits, so that at most two of them share a
sequence; shorter ones then go, longest first, into the smallest gap that takes them. The result
is a list of runs (length, first rank, documents, sequence, offset), and every document finds its
run by its rank among the documents of its length. Rows only travel once, without their tokens.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptweir.llm.common import small_batches
from promptweir.session import written

CAPACITY = 2048
END = 0
#: Chunks of text whose ids a worker remembers.
REMEMBERED = 100_000
#: Texts turned into strings at a time, and ids sent to Spark at a time.
SLICE, FLUSH_IDS = 128, 300_000


# --- tokens -------------------------------------------------------------------------------------

class Encoder:
    """Ids of the byte-level BPE vocabulary, with a memory for chunks between single spaces.

    The vocabulary splits a text before a space that stands between two other characters, whatever
    follows or precedes, so such chunks are encoded on their own, all new ones of a text in one
    call. Texts with other white space beside a space are encoded whole. The end marker inside a
    text becomes its own id, as the tokenizer file declares it.
    """

    #: A carriage return between chunks is a token of its own.
    SEPARATOR = "\r"

    def __init__(self, ranks_path: str, marker: str = "<|endoftext|>", marker_id: int = 50256):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
        self.model = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marker, self.marker_id = marker, np.array([marker_id], "<u4").tobytes()
        self.separator_id = self.model.encode_ordinary(self.SEPARATOR)[0]
        self.chunks: dict[str, bytes] = {}

    def _array(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_ordinary(text), "<u4")

    def _learn(self, new: list[str]) -> bool:
        """Remembers new chunks; False if one of them cannot be encoded on its own."""
        if "" in new or any(x[0].isspace() or x[-1].isspace() for x in new):
            return False
        ids = self._array(self.SEPARATOR.join([" " + x for x in new]))
        ends = np.flatnonzero(ids == self.separator_id).tolist()
        raw, start = ids.tobytes(), 0
        for x, end in zip(new, [*ends, len(ids)]):
            self.chunks[x] = raw[4 * start:4 * end]
            start = end + 1
        return True

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace() or self.SEPARATOR in text:
            return self._array(text).tobytes()
        if len(self.chunks) >= REMEMBERED:
            self.chunks.clear()
        new = list(set(rest).difference(self.chunks))
        if new and not self._learn(new):
            return self._array(text).tobytes()
        return self._array(first).tobytes() + b"".join(map(self.chunks.__getitem__, rest))

    def ids(self, text: str | None) -> np.ndarray:
        pieces = (text or "").split(self.marker)
        return np.frombuffer(self.marker_id.join(map(self._plain, pieces)), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but the first, which may be shorter."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


PIECES = "doc_id long, piece int, start long, length int, task int, place long"


def pieces(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, key: str = "doc_id",
           text: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of every document with ids_crc32 and their ids, written to the shared folder.

    Where only the layout is wanted, `with_ids=False` leaves the ids out.

    A document is its ids and one end id; a NULL or empty text is the end id alone. Documents
    longer than the capacity are cut. `place` numbers the pieces of one length within a `task`.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = _encoder(ranks_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<i4")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows, parts, size = [], [], 0
                some = batch.slice(at, SLICE)
                for doc, body in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = encoder.ids(body).view("<i4")
                    for piece, (start, length) in enumerate(cuts(len(ids) + 1, capacity)):
                        rows.append((doc, piece, start, length, task, int(seen[length])))
                        seen[length] += 1
                    parts += [ids, end]
                    size += len(ids) + 1
                    if size > FLUSH_IDS:
                        yield _batch(rows, parts, with_ids)
                        rows, parts, size = [], [], 0
                if rows:
                    yield _batch(rows, parts, with_ids)

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return written(narrow.mapInArrow(cut, f"{PIECES}, ids_crc32 long" + ", ids array<int>" * with_ids), "pieces")


def _batch(rows: list[tuple], parts: list[np.ndarray], with_ids: bool) -> pa.RecordBatch:
    """Pieces of whole documents in order: their ids lie one after the other. The checksum is that
    of the ids as unsigned little-endian 32-bit numbers."""
    doc, piece, start, length, task, place = zip(*rows)
    flat = np.concatenate(parts)
    raw, ends = memoryview(flat).cast("B"), (4 * np.cumsum(length)).tolist()
    checks = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends)]
    arrays = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
              "length": pa.array(length, pa.int32()), "task": pa.array(task, pa.int32()), "place": pa.array(place, pa.int64()),
              "ids_crc32": pa.array(checks, pa.int64())}
    if with_ids:
        offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
        arrays["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


# --- the plan on the histogram ------------------------------------------------------------------

def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, rank0, n, repeat, sequence0, offset) and the number of sequences.

    A run puts the n documents of one length that start at rank0 into sequences from sequence0
    on, `repeat` to a sequence, one after the other from `offset`. `counts` has lengths below or at
    the capacity; the number of runs depends on the capacity, not on the number of documents.
    """
    left = {k: int(n) for k, n in counts.items() if n > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), by gap
    sequences = 0

    def put(length: int, n: int, repeat: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, repeat, sequence, offset))
        used[length] += n
        left[length] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in large:
        while left[length]:
            partner = next((k for k in large if k <= capacity - length and left[k] - (k == length) > 0), None)
            if partner is None:
                n = left[length]
                put(length, n, 1, sequences, 0)
            else:
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
                put(length, n, 1, sequences, 0)
                put(partner, n, 1, sequences, length)
            gap = capacity - length - (partner or 0)
            if gap:
                insort(gaps, (gap, sequences, n))
            sequences += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g[0] >= length), len(gaps))
        changed: list[tuple[int, int, int]] = []
        while left[length]:
            if at < len(gaps):
                gap, first, n = gaps.pop(at)
            else:
                gap, first, n = capacity, sequences, -(-left[length] // (capacity // length))
                sequences += n
            repeat = gap // length
            full = min(n, left[length] // repeat)
            if full:
                put(length, full * repeat, repeat, first, capacity - gap)
                if gap - repeat * length:
                    changed.append((gap - repeat * length, first, full))
            if full < n:
                rest = left[length]
                if rest:
                    put(length, rest, rest, first + full, capacity - gap)
                    changed.append((gap - rest * length, first + full, 1))
                if n - full - bool(rest):
                    changed.append((gap, first + full + bool(rest), n - full - bool(rest)))
        for gap in changed:
            insort(gaps, gap)
    return np.array(runs or np.zeros((0, 6)), np.int64).reshape(-1, 6), sequences


# --- the layout ---------------------------------------------------------------------------------

def pack(pieces_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and offset; other columns of the table are kept, but for
    those that have one of these two names.

    Full pieces are a sequence of their own. Pieces of one length are interchangeable, so a
    piece's rank among them decides: places within its task after the pieces of the tasks before.
    """
    pieces_table = pieces_table.drop("sequence_id", "offset")
    full = pieces_table.where(F.col("length") >= capacity)
    short = pieces_table.where(F.col("length") < capacity)
    by_task = written(short.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # < capacity rows
    runs, sequences = plan(counts, capacity)
    before = by_task.select(F.col("length").alias("b_length"), F.col("task").alias("b_task"), F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    by_length = {k: runs[runs[:, 0] == k] for k in counts}

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for k in np.unique(lengths):
            rows, own = np.nonzero(lengths == k)[0], by_length[k]
            run = own[np.searchsorted(own[:, 1], ranks[rows], "right") - 1]
            place = ranks[rows] - run[:, 1]
            out[rows, 0] = run[:, 4] + place // run[:, 3]
            out[rows, 1] = run[:, 5] + place % run[:, 3] * k
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = short.join(before, F.expr("length = b_length AND task = b_task")).withColumn(
        "found", find(F.col("length"), F.col("before") + F.col("place")))
    own = [c for c in pieces_table.columns]
    alone = F.lit(sequences) + F.shiftleft(F.col("task").cast("long"), 36) + F.col("place")
    return placed.select(*own, "found.sequence_id", "found.offset").union(
        full.select(*own, alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
