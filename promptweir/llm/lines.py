"""Common lines removed from documents, by arrays that documents look their lines up in.

Lines are counted once by key. The keys found in enough documents are dealt by hash into shards of
bounded size, and each shard becomes one row of flat arrays: a minimal perfect hash (levels of
bits: a key takes the first level in which it is alone at its place, and its number is the count
of bits before it), a fingerprint that tells strangers apart, the number of documents, and the
largest document. Documents are then read a second time; a worker hashes the lines of a portion
of them, sorts them by shard and looks them up, one shard after the other, in vectors. No line and
no text is shuffled or joined; shards are read from the shared folder, held up to a fixed size.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptweir.llm.common import parts, small_batches
from promptweir.llm.shingles import mix
from promptweir.session import shared_dir, written

BLANKS = b" \t\n\v\f\r"
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Keys of a shard, on average; bytes of shards that a worker holds; bytes of text looked up at a time.
SHARD_KEYS, HELD_BYTES, PORTION = 1 << 16, 1 << 27, 1 << 23
#: The document that rows without a doc_id form together; smaller than any.
NO_ID = -(1 << 63)


def key_of(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The line without ASCII white space at its ends, A-Z lower-cased; None if it is too short."""
    if len(line) < least_chars:
        return None
    key = line.strip(BLANKS).lower()
    if len(key) < least_chars or (len(key) < 4 * least_chars and len(key.decode("utf-8", "replace")) < least_chars):
        return None
    return key


def _halves(digests: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each 128-bit digest."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


# --- the index ----------------------------------------------------------------------------------

def counts(docs: DataFrame, least_chars: int = LEAST_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, print, docs, keeper) of every distinct key: its two hashes, the number of documents
    that hold it and the largest of them."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, sizes = [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {xxhash.xxh3_128_digest(k) for x in (body.as_py() or b"").split(b"\n")
                       if (k := key_of(x, least_chars)) is not None}
                if own:
                    ids.append(doc)
                    sizes.append(len(own))
                    found += own
            if found:
                both = _halves(found).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.repeat(np.array(ids, np.int64), sizes))],
                    ["place", "print", "doc"])

    one = narrow(docs, key, text).mapInArrow(scan, "place long, print long, doc long")
    return one.groupBy("place", "print").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("keeper"))


def narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.col(text).cast("string").cast("binary").alias("body"))


def _bits(place: np.ndarray, mark: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)
    return (mix(place ^ mix(mark + salt)) % np.uint64(size)).astype(np.int64)


class Shard:
    """Minimal perfect hash over distinct (place, print), with an array each of prints, counts and keepers."""

    def __init__(self, sizes: list[int], taken: np.ndarray, marks: np.ndarray, docs: np.ndarray, keepers: np.ndarray):
        self.sizes, self.taken, self.marks, self.docs, self.keepers = sizes, taken, marks, docs, keepers
        self.number = np.cumsum(taken, dtype=np.int32) - 1
        self.bytes = sum(x.nbytes for x in (taken, marks, docs, keepers, self.number))

    @classmethod
    def build(cls, place: np.ndarray, mark: np.ndarray, docs: np.ndarray, keepers: np.ndarray) -> Shard:
        sizes, levels, order, left = [], [], [], np.arange(len(place))
        while len(left):
            size = max(64, 3 * len(left) // 2)
            at = _bits(place[left], mark[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            placed = alone[at]
            order.append(left[placed][np.argsort(at[placed])])
            levels.append(alone)
            sizes.append(size)
            left = left[~placed]
        order = np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int64)
        taken = np.concatenate([*levels, np.zeros(0, bool)]).astype(bool)
        return cls(sizes, taken, mark[order], docs[order], keepers[order])

    def find(self, place: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (0 for a key that is not indexed) and keeper of every key."""
        slot, left, start = np.full(len(place), -1, np.int64), np.arange(len(place)), 0
        for level, size in enumerate(self.sizes):
            at = start + _bits(place[left], mark[left], level, size)
            there = self.taken[at]
            slot[left[there]] = self.number[at[there]]
            left, start = left[~there], start + size
        known = slot >= 0
        known[known] = self.marks[slot[known]] == mark[known]
        docs, keepers = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        docs[known], keepers[known] = self.docs[slot[known]], self.keepers[slot[known]]
        return docs, keepers


SHARD = "shard long, sizes array<int>, taken binary, marks binary, docs binary, keepers binary"


def index(counted: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[str, int]:
    """Folder and number of the shards over the keys in at least `least_docs` documents.

    Counts above 2**32 - 1 are kept as that number.
    """
    common = written(counted.where(F.col("docs") >= least_docs), "common_lines")
    shards = parts(common.count(), SHARD_KEYS)

    def build(table: pa.Table) -> pa.Table:
        place, mark, docs, keepers = (table.column(c).to_numpy() for c in ("place", "print", "docs", "keeper"))
        made = Shard.build(place.astype(np.int64).view(np.uint64), mark.astype(np.int64).view(np.uint64),
                           np.minimum(docs, (1 << 32) - 1).astype("<u4"), keepers.astype("<i8"))
        row = {"shard": table.column("shard")[0].as_py(), "sizes": made.sizes, "taken": np.packbits(made.taken).tobytes(),
               "marks": made.marks.astype("<u8").tobytes(), "docs": made.docs.tobytes(), "keepers": made.keepers.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([
            ("shard", pa.int64()), ("sizes", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("taken", "marks", "docs", "keepers")]]))

    path = shared_dir(counted.sparkSession, "line_shards")
    common.withColumn("shard", F.pmod("place", F.lit(shards))).groupBy("shard").applyInArrow(build, SHARD).write.partitionBy(
        "shard").parquet(path)
    return path, shards


class Shards:
    """Shards read from the shared folder when they are needed; the ones used last are held."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path)
        self.held: OrderedDict[int, Shard | None] = OrderedDict()

    def __getitem__(self, k: int) -> Shard | None:
        if k not in self.held:
            self.held[k] = self._read(k)
            while len(self.held) > 1 and sum(s.bytes for s in self.held.values() if s) > HELD_BYTES:
                self.held.popitem(last=False)
        self.held.move_to_end(k)
        return self.held[k]

    def _read(self, k: int) -> Shard | None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(f"{self.path}/shard={k}", allow_not_found=True))
        names = [f.path for f in found if f.path.endswith(".parquet")]
        if not names:
            return None
        (row,) = [r for name in names for r in pq.ParquetFile(self.files.open_input_file(name)).read().to_pylist()]
        taken = np.unpackbits(np.frombuffer(row["taken"], np.uint8), count=sum(row["sizes"])).astype(bool)
        return Shard(row["sizes"], taken, *(np.frombuffer(row[c], t) for c, t in (("marks", "<u8"), ("docs", "<u4"), ("keepers", "<i8"))))


# --- the documents ------------------------------------------------------------------------------

def _dropped(shards: Shards, n: int, owners: np.ndarray, digests: list[bytes], least_docs: int) -> np.ndarray:
    """Which of the long lines, given by their document and digest, go."""
    both = _halves(digests).astype(np.uint64)
    place, mark = both[:, 0], both[:, 1]
    shard = np.mod(place.view(np.int64), n)
    order, gone = np.argsort(shard, kind="stable"), np.zeros(len(shard), bool)
    for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if (own := shards[int(shard[rows[0]])]) is not None:
            docs, keepers = own.find(place[rows], mark[rows])
            gone[rows] = (docs >= least_docs) & (keepers != owners[rows])
    return gone


def without_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_lines, n_dropped and kept, the text of the lines that stay.

    Lines end at a line feed; a NULL or empty text is one empty line. A key (see `key_of`) found in
    at least `least_docs` documents loses its lines in all of them but the largest. Rows of one id
    are one document when counted; those without id are one as well, smaller than any other.
    Other columns of `docs` are left behind.
    """
    small_batches(docs.sparkSession)
    path, n = index(counts(docs, least_chars, key, text), least_docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(path)
        for batch in batches:
            some, size = [], 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                some.append((doc, body.as_py() or b""))
                size += len(some[-1][1])
                if size > PORTION:
                    yield cleaned(shards, some)
                    some, size = [], 0
            if some:
                yield cleaned(shards, some)

    def cleaned(shards: Shards, some: list[tuple[int, bytes]]) -> pa.RecordBatch:
        split = [body.split(b"\n") for _, body in some]
        long = [(row, i, k) for row, lines in enumerate(split) for i, x in enumerate(lines)
                if (k := key_of(x, least_chars)) is not None]
        gone: list[set[int]] = [set() for _ in some]
        if long:
            owners = np.array([some[row][0] for row, _, _ in long], np.int64)
            for at in np.flatnonzero(_dropped(shards, n, owners, [xxhash.xxh3_128_digest(k) for _, _, k in long], least_docs)):
                gone[long[at][0]].add(long[at][1])
        kept = [b"\n".join(x for i, x in enumerate(lines) if i not in out) if out else body
                for (_, body), lines, out in zip(some, split, gone)]
        ids = [None if doc == NO_ID else doc for doc, _ in some]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(list(map(len, split)), pa.int64()), pa.array(list(map(len, gone)), pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], [key, "n_lines", "n_dropped", "kept"])

    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    return narrow(docs, key, text).mapInArrow(keep, schema)
