"""Token ids of documents in compressed binary files, written by tasks in document order and read back.

A file: MAGIC, a header (ids, documents, blocks, bytes and crc32 of the table), the table of document ids and lengths,
and the blocks of `mixing_coder`.  Files are named so that their order is the documents' order.

Edge cases: null and empty texts are the end id alone; null document ids come first; repeated ids keep all their rows,
ordered by a hash of the text; an empty table writes no file and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import mixing_coder
from fieldspark.llm.common import Store
from fieldspark.llm.tokens import Encoder

MAGIC = b"FSTOKEN1"
_HEADER = struct.Struct("<QIIII")
_BLOCK = struct.Struct("<III")
#: A file is closed once it has so many ids.
FILE_IDS = mixing_coder.BLOCK * mixing_coder.LANES
COLUMNS = "name string, place long, doc_id string, before long, n_tokens long, ids_crc32 long, ids binary"


def pack_file(doc_ids: list[str | None], ids: list[bytes]) -> Iterator[bytes]:
    """The parts of one file; ids: each document's, as little-endian unsigned 32-bit integers."""
    table = "\n".join(f"{'' if d is None else d} {len(i) // 4}" for d, i in zip(doc_ids, ids, strict=True))
    table = zlib.compress(table.encode(), 6)
    flat = np.frombuffer(b"".join(ids), "<u4")
    blocks = mixing_coder.encode(flat)
    yield MAGIC + _HEADER.pack(len(flat), len(ids), len(blocks), len(table), zlib.crc32(table)) + table
    yield from blocks


def read_file(file) -> Iterator[tuple[str | None, bytes]]:
    """Document id and ids of each document; anything that doesn't fit a checksum raises ValueError."""

    def exactly(n):
        data = file.read(n)
        if len(data) != n:
            raise ValueError("the file ends too early")
        return data

    if exactly(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    n_ids, n_docs, n_blocks, size, crc = _HEADER.unpack(exactly(_HEADER.size))
    table = exactly(size)
    if zlib.crc32(table) != crc:
        raise ValueError("checksum of the table")
    blocks = []
    for _ in range(n_blocks):
        n, length, crc = _BLOCK.unpack(exactly(_BLOCK.size))
        blocks.append((n, crc, exactly(length)))
    decoded = mixing_coder.decode(blocks)
    flat = np.concatenate(decoded) if decoded else np.zeros(0, "<u4")
    docs = [line.split(" ") for line in zlib.decompress(table).decode().split("\n")] if n_docs else []
    if len(flat) != n_ids or len(docs) != n_docs or sum(int(n) for _, n in docs) != n_ids:
        raise ValueError("the table doesn't fit the ids")
    at = 0
    for d, n in docs:
        yield d or None, flat[at : at + int(n)].tobytes()
        at += int(n)


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, files: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write token files to the folder, `files` of them at least; a row per file: name, n_ids, n_docs, n_bytes.

    The frame writes when it is evaluated.  Names are fixed by the range partition, and files appear by renaming, so
    a repeated task replaces its own files."""
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    rows = rows.repartitionByRange(max(1, files), "d").sortWithinPartitions("d", F.xxhash64("t"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, part, made = Store(folder), TaskContext.get().partitionId(), []
        encoder = Encoder.of(tokenizer)
        held_docs, held, size = [], [], 0

        def close():
            n, written = sum(map(len, held)) // 4, 0
            name = f"tokens-{part:06d}-{len(made):04d}.bin"

            def counted():
                nonlocal written
                for c in pack_file(held_docs, held):
                    written += len(c)
                    yield c

            store.write(name, counted())
            made.append((name, n, len(held), written))
            held_docs.clear()
            held.clear()

        for b in batches:
            for d, ids in zip(b["d"], encoder.encode_all(b["t"]), strict=True):
                held_docs.append(d)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= FILE_IDS:
                    close()
                    size = 0
        if held:
            close()
        yield pd.DataFrame(made, columns=["name", "n_ids", "n_docs", "n_bytes"])

    slim = rows.select(F.col("d").cast("string"), "t")
    return slim.mapInPandas(task, "name string, n_ids long, n_docs long, n_bytes long")


def with_start(made: DataFrame) -> list[tuple[str, int]]:
    """Each file's name and the ids of all files before it, from the written files' rows (one per file)."""
    out, before = [], 0
    for r in sorted(made.select("name", "n_ids").collect()):
        out.append((r.name, before))
        before += r.n_ids
    return out


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]], ids: bool = True) -> DataFrame:
    """A row per document of the files: where it lies, its crc32, and its ids (null unless asked for)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(folder)
        for name, start in ((n, s) for b in batches for n, s in zip(b["name"], b["start"], strict=True)):
            with store.open(name) as file:
                rows, held, before = [], 0, start
                for k, (d, own) in enumerate(read_file(file)):
                    rows.append((name, k, d, before, len(own) // 4, zlib.crc32(own), own if ids else None))
                    before += len(own) // 4
                    held += len(own) if ids else 1
                    if len(rows) >= 10_000 or held > 1 << 24:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    listed = spark.createDataFrame(files, "name string, start long").repartition(max(1, len(files)))
    return listed.mapInPandas(task, COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))
