"""WARC archives: one gzip member per record, written by tasks and read back one after the other.

A record's block is an HTTP response; equal payloads of at least MIN_REVISIT bytes are stored once, in the row with
the largest id, and the others are revisit records that keep the HTTP header and refer to it.

Edge cases: a null payload is empty; a null id never wins against another one and alone makes a response; rows that
repeat the largest id of their payload are responses too; a null url leaves the target out; an empty table writes no
archive and reads as no rows; only the three named columns are written, others are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import Store

MIN_REVISIT = 1000
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 1 << 28
CHUNK = 1 << 16
LEVEL = 4
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2020-01-01T00:00:00Z"

RECORD_COLUMNS = (
    "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, "
    "refers_to string, payload binary"
)


def digest(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <%s>" % record_id.encode(),
        b"WARC-Date: " + DATE,
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: " + digest(payload),
        b"WARC-Block-Digest: " + digest(block),
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + " ".join(url.split()).encode("utf-8", "surrogatepass"))
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <%s>" % refers_to.encode()]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def payload_bytes(self) -> int:
        return int(self.http["content-length"]) if self.headers["warc-type"] == "revisit" else len(self.payload)


class _Member:
    """Bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, file, rest: bytes):
        self.file, self.z, self.rest, self.ready = file, zlib.decompressobj(31), rest, bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.rest or self.file.read(CHUNK)
        self.rest = b""
        if not data:
            raise ValueError("the archive ends inside a record")
        self.ready += self.z.decompress(data, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark) + 1)
            if not self._more():
                raise ValueError("a record without the end of its header")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._more():
                raise ValueError("a record shorter than its Content-Length")
            out = bytes(self.ready[:n])
            del self.ready[:n]
            n -= len(out)
            if out:
                yield out

    def end(self) -> bytes:
        """What the file had after the member; nothing but the two closing line ends may be left in it."""
        while self._more():
            pass
        if bytes(self.ready) != b"\r\n\r\n":
            raise ValueError("a record longer than its Content-Length")
        return self.z.unused_data


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read(file) -> Iterator[Record]:
    """Records in order; memory holds one payload.  Wrong lengths and digests raise ValueError."""
    rest = b""
    while rest or (rest := file.read(CHUNK)):
        member = _Member(file, rest)
        first, headers = _fields(member.until(b"\r\n\r\n"))
        if first.encode() != VERSION:
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        whole, payload, http = hashlib.sha1(), [], None
        head = b""
        for part in member.take(int(headers["content-length"])):
            whole.update(part)
            if http is None:
                head += part
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, part = _fields(head[:at])[1], head[at + 4 :]
            payload.append(part)
        rest = member.end()
        data = b"".join(payload)
        if headers["warc-block-digest"] != f"sha1:{base64.b32encode(whole.digest()).decode()}":
            raise ValueError(f"block digest of {headers['warc-record-id']}")
        if headers["warc-type"] == "response" and headers["warc-payload-digest"].encode() != digest(data):
            raise ValueError(f"payload digest of {headers['warc-record-id']}")
        yield Record(headers, http or {}, data)


def with_originals(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """pages with __original: the largest key of an equal large payload, null where the row itself is stored.

    Only keys and digests are shuffled to find it; payloads move once, by key and digest, so no group of copies
    lands in one task."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    marked = pages.withColumns(
        {"__digest": F.sha2(data, 256), "__large": F.octet_length(data) >= MIN_REVISIT}
    )
    slim = marked.filter("__large").select(F.col(key).alias("__key"), "__digest")
    first = slim.groupBy("__digest").agg(F.max("__key").alias("__original"), F.count("*").alias("__n")).filter("__n > 1")
    refer = (
        slim.join(first, "__digest")
        .filter(F.col("__original").isNotNull() & (F.col("__key").isNull() | (F.col("__key") < F.col("__original"))))
        .select("__key", F.col("__digest").alias("__of"), "__original")
        .distinct()
    )
    return marked.join(refer, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__digest") == F.col("__of")), "left").drop(
        "__key", "__of", "__digest", "__large"
    )


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write archives to the folder, one or more per task; a row per archive: name, records, bytes.

    The frame writes when it is evaluated.  Names are fixed by the partition and files appear by renaming, so
    a repeated task replaces its own files."""
    rows = with_originals(pages.select(key, url, payload), key, payload).select(
        F.col(key).cast("string").alias("k"),
        F.col(url).alias("u"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("d"),
        F.col("__original").cast("string").alias("o"),
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, part, made = Store(folder), TaskContext.get().partitionId(), []
        source = (r for b in batches for r in b.itertuples(index=False))
        row = next(source, None)
        while row is not None:
            size = [0, 0]

            def members():
                nonlocal row
                while row is not None and size[1] < ARCHIVE_BYTES:
                    to = None if row.o is None else f"urn:page:{row.o}"
                    m = record(f"urn:page:{'' if row.k is None else row.k}", row.u, bytes(row.d), to)
                    size[0] += 1
                    size[1] += len(m)
                    yield m
                    row = next(source, None)

            name = f"part-{part:06d}-{len(made):04d}.warc.gz"
            store.write(name, members())
            made.append((name, *size))
        yield pd.DataFrame(made, columns=["name", "records", "bytes"])

    return rows.mapInPandas(task, "name string, records long, bytes long")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the folder's archives as Spark lists them."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"))
    )


def read_archives(names: DataFrame, folder: str, tasks: int, payloads: bool = True) -> DataFrame:
    """Records of the named archives, read in `tasks` tasks; payload is null unless asked for."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(folder)
        for name in (n for b in batches for n in b["name"]):
            with store.open(name) as file:
                rows, held = [], 0
                for r in read(file):
                    h = r.headers
                    hexed = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    refers = h.get("warc-refers-to")
                    rows.append(
                        (h["warc-record-id"].strip("<>"), h["warc-type"], h.get("warc-target-uri"), r.payload_bytes,
                         hexed, refers and refers.strip("<>"), r.payload if payloads else None)
                    )
                    held += len(r.payload) if payloads else 1
                    if len(rows) >= 5000 or held > 1 << 24:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=_NAMES)

    return names.select("name").repartition(max(1, tasks)).mapInPandas(task, RECORD_COLUMNS)


_NAMES = [c.split()[0] for c in RECORD_COLUMNS.split(", ")]
