"""Byte ranges: every line once however files are cut, appended lines, blocks at the ends of files."""

import io
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.sources import files, ranges
from fieldspark.sources.logs import parse_logs
from fieldspark.streaming import logs as live


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n", b"\n\n\n", b"one\ntwo two\n\nthree", "é\n日本\r\nx\n".encode(), b"x" * 300 + b"\nend\n"])
@pytest.mark.parametrize("most", [1, 2, 3, 7, 1000])
def test_lines_of_ranges(text, most, monkeypatch):
    monkeypatch.setattr(ranges, "CHUNK", 4)
    f, got = io.BytesIO(text), []
    for a, b in ranges._cut(len(text), 0, most):
        got += ranges.lines_ending_in(f, a, b, b == len(text))
    want, at = [], 0
    for line in text.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    if want[-1][1] == b"":
        want.pop()
    assert got == want


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_blocks(monkeypatch):
    block = b"<a>" + b"x" * 50 + b"</a>"
    for before, after in ((10**6, 10), (0, 10**6), (5 * 10**5, 5 * 10**5), (65_536 - 2, 10**5), (0, 0), (65_536 - 30, 200_000), (3, 65_000)):
        f = Counted(b"\xff" * before + block + b"\x00" * after)
        assert ranges.find_block(f, len(f.getvalue()), b"<a>", b"</a>") == block, (before, after)
        if after < 1000:
            assert f.taken <= 1 << 16
    monkeypatch.setattr(ranges, "CHUNK", 5)
    for text in (b"....<a>..</a", b"</a>...<a>", b"", b"<a", b"no"):
        assert ranges.find_block(io.BytesIO(text), len(text), b"<a>", b"</a>", 4) is None
    assert ranges.find_block(io.BytesIO(b"..<a>.<a>..</a>....." * 2), 40, b"<a>", b"</a>", 4) == b"<a>.<a>..</a>"


def test_xmp_at_either_end(spark, tmp_path):
    body = b'<x:xmpmeta><rdf:Description drone-dji:RtkFlag="%d"></rdf:Description></x:xmpmeta>'
    big = bytes(400_000)
    (tmp_path / "end.JPG").write_bytes(big + body % 50 + b"\x00" * 100)
    (tmp_path / "front.jpg").write_bytes(b"\xff\xd8" + body % 16 + big)
    (tmp_path / "none.jpg").write_bytes(big)
    got = {r.File: r.attributes for r in files.read_xmp(spark, str(tmp_path)).collect()}
    assert got == {"end.JPG": {"RtkFlag": "50"}, "front.jpg": {"RtkFlag": "16"}, "none.jpg": {}}


@pytest.mark.parametrize("range_bytes", [None, 50, 700])
def test_grid_in_ranges(spark, tmp_path, range_bytes):
    rnd = random.Random(4)
    want, header = {}, "ncols 9\nnrows 40\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n"
    for name in ("a", "b"):
        rows = [[rnd.randint(-50, 9999) / 4 for _ in range(9)] for _ in range(40)]
        lines = [" ".join(map(str, r)) for r in rows]
        (tmp_path / f"{name}.asc").write_text(header + "\n".join(lines[:20]) + "\r\n\n" + "\n".join(lines[20:]) + ("\n" if name == "a" else ""))
        want |= {(name, i, j): v for i, r in enumerate(rows) for j, v in enumerate(r)}
    px, grids = files.read_ascii_grid(spark, str(tmp_path), range_bytes)
    assert {(r.raster_id, r.row, r.col): r.value for r in px.collect()} == want
    assert sorted((r.raster_id, r.x0, r.y0, r.ncols, r.nrows, r.nodata) for r in grids.collect()) == [
        ("a", 10.0, 100.0, 9, 40, -9999.0), ("b", 10.0, 100.0, 9, 40, -9999.0),
    ]
    if range_bytes:
        assert px.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def event(k, text="m"):
    return f'{{"ts":"2024-01-01T00:00:{k % 60:02d}","level":"INFO","tool":"t","msg":"{text}{k}"}}\n'


def test_appended_lines(spark, tmp_path):
    """Batches together are what one read of everything written gives."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    (src / "deep").mkdir(parents=True)
    written = []

    def poll():
        # Each poll is a new query from the checkpoint: nothing is remembered but the offsets.
        stream = live.stream_logs(spark, str(src), "*.log", range_bytes=64).select("msg", "file_name", "line_start")
        live.start(stream, out, str(tmp_path / "cp")).awaitTermination(60)
        return sorted(r.msg for r in spark.read.parquet(out).collect())

    def add(name, text, mode="a"):
        with open(src / name, mode, newline="") as f:
            f.write(text)

    def expect(*events):
        written.extend(events)
        assert poll() == sorted(written)

    add("a.log", event(1) + event(2))
    add("deep/b.log", event(3) + "broken {\n\n")
    add("_hidden.log", event(99))
    add("notes.txt", event(98))
    expect("m1", "m2", "m3")
    # Nothing new, then lines appended to known files and a new file.
    expect()
    add("a.log", "".join(event(k) for k in range(4, 14)))
    add("deep/b.log", event(14))
    add("c.log", event(15))
    expect(*[f"m{k}" for k in range(4, 16)])
    # Half a line, then the rest of it with another line.
    half = event(16, "é" * 40)
    add("a.log", half[:60])
    expect()
    add("a.log", half[60:] + event(17))
    expect("é" * 40 + "16", "m17")
    # Cut short and written again: read from the beginning.
    add("a.log", event(18), "w")
    expect("m18")
    add("a.log", event(19))
    expect("m19")
    # Removed, and back under the same name.
    (src / "c.log").unlink()
    expect()
    add("c.log", event(20))
    expect("m20")
    final = parse_logs(spark.read.text([str(src / n) for n in ("a.log", "deep/b.log", "c.log")]))
    assert {r.msg for r in final.collect()} <= set(written)


def test_stream_equals_one_read(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in range(5):
        (src / f"{n}.log").write_text("".join(event(k, f"f{n}-") for k in range(200)))
    stream = live.stream_logs(spark, str(src), range_bytes=1000)
    live.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    columns = ["ts", "level", "tool", "msg", "file_name", "raw_json"]
    lines = spark.read.text(str(src)).select("value", F.col("_metadata.file_name").alias("file_name"))
    want = parse_logs(lines).select(*columns).collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())) == sorted(map(tuple, want))
