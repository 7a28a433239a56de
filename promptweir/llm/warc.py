"""WARC archives compressed record by record with a Zstandard dictionary.

Every archive begins with a skippable frame that holds the dictionary its records were compressed
with, trained on the first records of the archive; each record is a frame of its own. A record
whose payload already stands in another record is written as a revisit.

Spark writes the archives: a task's rows are the dictionary frame and the record frames in order,
and the text writer's line separator is an empty skippable frame, which every reader passes over.
So archives reach any file system that Spark reaches, under its commit protocol.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic number of the skippable frame for dictionaries, and an empty skippable frame of another.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\0\0\0\0"
#: Records of an archive, and bytes of its first records that train its dictionary.
ARCHIVE_RECORDS, TRAINING_BYTES, DICTIONARY_BYTES = 1_000, 2_000_000, 32_768
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"


def record(page: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool) -> bytes:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", name(original))]
    block = http if revisit else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]):
    """Trained on the samples; where these are too few to train, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The frames of one archive, dictionary first."""
    import zstandard

    samples, size = [], 0
    for one in records:
        samples.append(one[:TRAINING_BYTES - size])
        size += len(samples[-1])
        if size >= TRAINING_BYTES:
            break
    words = dictionary(samples)
    raw = words.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True).compress
    for one in records:
        yield compress(one)


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[bytes] = []
    for batch in batches:
        out: list[bytes] = []
        for page, url, html, first, is_first in zip(*(batch[c] for c in ("page_id", "url", "html", "first", "is_first"))):
            payload = (html or "").encode("utf-8", "surrogatepass")
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            number = lambda x: None if pd.isna(x) else int(x)
            held.append(record(number(page), url, payload, digest, number(first), not is_first))
            if len(held) == ARCHIVE_RECORDS:
                out += archive(held)
                held = []
        if out:
            yield pd.DataFrame({"frame": out})
    if held:
        yield pd.DataFrame({"frame": list(archive(held))})


def write(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id", url: str = "url",
          html: str = "html") -> None:
    """Archives a record per row under `path`.

    Of rows with equal payloads of at least `least_bytes` bytes the one with the smallest key is a
    response (among rows with that key, one); the others are revisits of it. A NULL html is an empty
    payload; NULL keys come last and a revisit of such a row refers to nothing.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    payload: Column = F.sha2(F.col("html").cast("binary"), 256)
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = rows.groupBy(payload.alias("payload")).agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"),
        F.min(F.octet_length("html")).alias("bytes")).where(f"n > 1 AND bytes >= {least_bytes}")
    # The row number only tells rows of one key apart, so a key that occurs once never depends on it.
    told = firsts.select("payload", "first")
    same_key = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    dealt = rows.withColumn("payload", payload).join(told, "payload", "left").select(
        "page_id", "url", "html", F.col("first.page_id").alias("first"),
        (F.col("first").isNull() | (same_key & (F.col("row") == F.col("first.row")))).alias("is_first"))
    dealt.mapInPandas(_frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", ARCHIVE_RECORDS + 1).text(path)


COLUMNS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "payload binary")


def parse(blob: bytes) -> Iterator[tuple]:
    """The records of one archive, decompressed with the dictionary of its first frame."""
    import zstandard

    magic, size = struct.unpack_from("<II", blob)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    raw = blob[8:8 + size]
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(blob, read_across_frames=True), 1 << 18)
    number = lambda x: int(x[len("<urn:page:"):-1]) if x and x != "<urn:page:>" else None
    while reader.readline():
        head = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            head[name] = value
        http, _, payload = reader.read(int(head["Content-Length"])).partition(b"\r\n\r\n")
        reader.read(4)
        if head["WARC-Type"] == "response":
            length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if head["WARC-Payload-Digest"] != f"sha1:{digest}":
                raise ValueError("payload and digest differ")
        else:
            length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
            digest, payload = head["WARC-Payload-Digest"][5:], None
        yield (number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"],
               number(head.get("WARC-Refers-To")), length, digest, payload)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under `path`; revisits have no payload of their own. An archive
    holds a bounded number of records and is read whole by one task."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["content"]:
                if not blob:
                    continue
                frame = pd.DataFrame(list(parse(bytes(blob))), columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                yield frame if payloads else frame.drop(columns="payload")

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(records, COLUMNS if payloads else COLUMNS.removesuffix(", payload binary"))
