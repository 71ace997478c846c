"""Files read by byte ranges: many tasks for one large text, appended lines as a stream, the ends of images.

A line belongs to the range that holds its line feed, so any cutting of a file gives each line once: a reader looks back
from its first byte for the beginning of the line it is in.  Files are opened in tasks through Python, by plain paths,
file: URIs or the stores that pyarrow knows.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from fnmatch import fnmatch
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range, bytes read at a time, and lines of a batch.
RANGE, CHUNK, BATCH = 32 << 20, 1 << 16, 8192


def _store(uri: str):
    """(file system, path) of a URI; None for the local file system."""
    if re.match(r"^(file:|/|[^:/]+(/|$))", uri):
        return None, re.sub(r"^file:(//)?(?=/)", "", uri)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_file(uri: str) -> BinaryIO:
    """A file to read from any place in it."""
    store, path = _store(uri)
    return open(path, "rb") if store is None else store.open_input_file(path)


def create_file(uri: str, content: bytes) -> None:
    """A file in a shared folder: written under another name first, so a repeated or lost attempt leaves no half file."""
    store, path = _store(uri)
    folder, _, name = path.rpartition("/")
    attempt = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if store is None:
        os.makedirs(folder, exist_ok=True)
        with open(attempt, "wb") as f:
            f.write(content)
        os.replace(attempt, path)
        return
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(attempt) as f:
        f.write(content)
    store.move(attempt, path)


def sizes(uri: str, pattern: str = "*") -> dict[str, int]:
    """Sizes of the files below a folder, or of one file; names that begin with . or _ are left out."""
    store, path = _store(uri)
    found = {}
    if store is None:
        if os.path.isfile(path):
            return {path: os.path.getsize(path)}
        for folder, inner, names in os.walk(path):
            inner[:] = [n for n in inner if n[0] not in "._"]
            for n in names:
                if n[0] not in "._" and fnmatch(n, pattern):
                    try:
                        found[os.path.join(folder, n)] = os.path.getsize(os.path.join(folder, n))
                    except FileNotFoundError:
                        continue
        return dict(sorted(found.items()))
    from pyarrow import fs

    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    info = store.get_file_info(path)
    listed = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    for i in listed:
        hidden = any(p[:1] in "._" for p in i.path[len(path) :].split("/") if p)
        if i.is_file and not hidden and (info.is_file or fnmatch(i.base_name, pattern)):
            found[prefix + i.path] = i.size
    return dict(sorted(found.items()))


def line_start(f: BinaryIO, at: int) -> int:
    """Where the line begins that byte `at` is part of."""
    while at > 0:
        size = min(CHUNK, at)
        f.seek(at - size)
        found = f.read(size).rfind(b"\n")
        if found >= 0:
            return at - size + found + 1
        at -= size
    return 0


def lines_ending_in(f: BinaryIO, start: int, stop: int, unfinished: bool = False) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of lines whose line feed is at start <= place < stop.

    unfinished: also the rest before stop that has no line feed, if there is any."""
    at = line_start(f, start)
    f.seek(at)
    # Pieces of the open line; a list, so that a line of many chunks is put together once.
    held, left = [], stop - at
    while left > 0 and (chunk := f.read(min(CHUNK, left))):
        left -= len(chunk)
        *whole, rest = chunk.split(b"\n")
        for piece in whole:
            line = b"".join([*held, piece])
            held = []
            yield at, line
            at += len(line) + 1
        if rest:
            held.append(rest)
    if unfinished and held:
        yield at, b"".join(held)


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def _cut(size: int, start: int = 0, most: int | None = None) -> Iterator[tuple[int, int]]:
    most = most or RANGE
    for a in range(start, size, most):
        yield a, min(a + most, size)


def read_lines(
    spark: SparkSession, path: str, pattern: str = "*", most: int | None = None, match: str | None = None, head: int | None = None
) -> DataFrame:
    """file_path, file_name, start (of the range), number (of the line in its range), matched, value: files in many tasks.

    matched: the place among those lines of the range in which the pattern `match` is found, null for others.
    head: only so many bytes of each file.  Empty files have no lines; blank lines are lines."""
    most, wanted = most or RANGE, re.compile(match or "")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    length = F.col("length") if head is None else F.least("length", F.lit(head).cast("long"))
    files = reader.load(path).select(F.col("path").alias("file_path"), length.alias("length")).filter("length > 0")
    parts = files.agg(F.sum(F.ceil(F.col("length") / most))).first()[0] or 1
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(most).cast("long"))
    ranges = files.select("file_path", "length", F.explode(starts).alias("start")).repartition(int(parts), "file_path", "start")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                stop = min(r["start"] + most, r["length"])
                number, matched, held = 0, 0, []
                with open_file(r["file_path"]) as f:
                    for _, line in lines_ending_in(f, r["start"], stop, stop == r["length"]):
                        text = _text(line)
                        found = wanted.search(text) is not None
                        held.append((number, matched if found else None, text))
                        number, matched = number + 1, matched + found
                        if len(held) == BATCH:
                            yield batch(r, held)
                            held = []
                if held:
                    yield batch(r, held)

    def batch(r: dict, held: list[tuple]) -> pa.RecordBatch:
        n = len(held)
        number, matched, lines = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([r["file_path"]] * n, pa.string()), pa.array([r["start"]] * n, pa.int64()), pa.array(number, pa.int64()),
             pa.array(matched, pa.int64()), pa.array(lines, pa.string())],
            names=["file_path", "start", "number", "matched", "value"],
        )

    rows = ranges.mapInArrow(task, "file_path string, start long, number long, matched long, value string")
    return rows.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))


class _Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class AppendedLines(DataSource):
    """Stream format `appended_lines`: lines as they are appended to the files below option `path`.

    An offset is the size of every file.  A batch reads what lies between two offsets, in ranges of many tasks; a last
    line without its line feed waits for a later batch; a file that has become shorter is read from its beginning again;
    one that is gone is forgotten.  A file replaced by a longer one between two batches is not noticed.  Options:
    `pattern` of file names, `rangeBytes`."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "value string, file_path string, file_name string, line_start long"

    def streamReader(self, schema) -> AppendedReader:  # noqa: N802
        return AppendedReader(self.options)


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.most = int(options.get("rangeBytes", RANGE))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sizes": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"sizes": sizes(self.path, self.pattern)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        before, parts = start["sizes"], []
        for file, size in end["sizes"].items():
            known = before.get(file, 0)
            parts += [_Range(file, a, b) for a, b in _cut(size, known if known <= size else 0, self.most)]
        return parts

    def read(self, partition: _Range) -> Iterable[pa.RecordBatch]:
        try:
            f = open_file(partition.file)
        except FileNotFoundError:
            # Removed after it was listed: its lines are lost to every reader.
            return
        with f:
            held, places = [], []
            for at, line in lines_ending_in(f, partition.start, partition.stop):
                held.append(_text(line))
                places.append(at)
                if len(held) == BATCH:
                    yield self._batch(partition.file, held, places)
                    held, places = [], []
            if held:
                yield self._batch(partition.file, held, places)

    @staticmethod
    def _batch(file: str, lines: list[str], places: list[int]) -> pa.RecordBatch:
        n = len(lines)
        columns = [pa.array(lines, pa.string()), pa.array([file] * n, pa.string()),
                   pa.array([file.rsplit("/", 1)[-1]] * n, pa.string()), pa.array(places, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["value", "file_path", "file_name", "line_start"])


def appended_lines(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int | None = None) -> DataFrame:
    """The stream of lines appended to the files of a folder."""
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream.format("appended_lines").option("pattern", pattern)
    return reader.option("rangeBytes", range_bytes or RANGE).load(path)


def find_block(f: BinaryIO, size: int, first: bytes, last: bytes, tail: int = 1 << 16) -> bytes | None:
    """Bytes from the first mark to the next last mark: in the file's tail, else from the front, a chunk at a time.

    The front is read only up to the end of the block, and a chunk at a time only until its beginning is found."""
    read = min(size, tail)
    f.seek(size - read)
    end = f.read(read)
    a = end.find(first)
    b = end.find(last, a) if a >= 0 else -1
    if b >= 0:
        return end[a : b + len(last)]
    f.seek(0)
    held, found = b"", False
    while chunk := f.read(CHUNK):
        searched = max(0, len(held) - len(last) + 1) if found else 0
        held += chunk
        if not found:
            a = held.find(first)
            # A mark may lie across two chunks.
            held, found = (held[a:], True) if a >= 0 else (held[-len(first) + 1 :], False)
            searched = 0
        if found and (b := held.find(last, searched)) >= 0:
            return held[: b + len(last)]
    return None
