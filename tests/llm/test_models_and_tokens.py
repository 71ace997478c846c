"""Classifiers on held-out rows; tokens, coder, files and packing by exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import AWKWARD
from fieldspark.llm import compression_quality, labelled, mixing_coder, packing, queries, token_files, tokens, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b\n\n c\t\td", "it's  I'LL we've", "<|endoftext|> x", "naïve É!!! ÀÇ 12345 1a2b", "\n\nx \n y", "日本語 text", "x\x1cy",
       "a\xa0b", "é", "''s 's' 't", "  ", "\r\n a \r b", "ß ÿ Ÿ ŉ İ ı", "", "a" * 5000, "soft\xadhyphen"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder(path, texts, monkeypatch):
    library = Tokenizer.from_file(path)
    rows = [*texts[0].values(), *ODD]
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    for kept in (tokens.KEPT_PIECES, 2000):
        monkeypatch.setattr(tokens, "KEPT_PIECES", kept)
        monkeypatch.setattr(tokens, "BATCH_CHARS", 50_000)
        got = [np.frombuffer(b, "<u4").tolist() for b in tokens.Encoder(path).encode_all(rows)]
        assert got == want
    assert list(tokens.Encoder(path).encode_all([None, ""])) == [b"", b""]


def unpacked(blocks):
    out = []
    for b in blocks:
        n, size, crc = mixing_coder._HEAD.unpack(b[:12])
        assert len(b) == 12 + size
        out.append((n, crc, b[12:]))
    return out


@pytest.mark.parametrize("lanes", [mixing_coder.LANES, 3])
def test_coder(lanes, monkeypatch):
    monkeypatch.setattr(mixing_coder, "LANES", lanes)
    r = np.random.default_rng(2)
    runs = [np.zeros(0, int), np.array([5]), r.integers(0, 65536, 9000), np.zeros(5000, int), np.tile([1, 2, 3, 65535], 3000),
            r.geometric(0.01, 20_000), np.repeat(r.integers(0, 300, 500), 7)]
    for ids in runs:
        got = mixing_coder.decode(unpacked(mixing_coder.encode(ids)))
        assert np.array_equal(np.concatenate([np.zeros(0, int), *got]), ids)
    assert sum(map(len, mixing_coder.encode(runs[4]))) < 2000
    with pytest.raises(ValueError):
        mixing_coder.encode(np.array([65536]))
    blocks = unpacked(mixing_coder.encode(runs[2]))
    damaged = bytearray(blocks[1][2])
    damaged[40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        mixing_coder.decode([(blocks[1][0], blocks[1][1], bytes(damaged))])


def test_token_files(spark, sf, texts):
    library, at = Tokenizer.from_file(BYTES), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_files(spark, sf).collect()}
    assert len(got) == len(texts[0])
    for i in sorted(texts[0]):
        ids = np.array([*library.encode(texts[0][i], add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_edges(spark, awkward, empty):
    from fieldspark.llm.common import shared_folder, written

    for docs, n in ((awkward, len(AWKWARD)), (empty, 0)):
        folder = shared_folder(spark, "tokens-test")
        made = written(token_files.write(docs, folder, BYTES, 2, 3), "made")
        rows = sorted(token_files.read(spark, folder, token_files.with_start(made)).collect(), key=lambda r: r.before)
        assert len(rows) == n
        assert [r.doc_id for r in rows] == sorted((i for i, _ in AWKWARD), key=lambda i: -1 if i is None else i)[:n]
        end = 0
        for r in rows:
            assert r.before == end and zlib.crc32(bytes(r.ids)) == r.ids_crc32
            end += r.n_tokens
        if n:
            assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 8)] == [1, 1, 1]


def checked(plan, histogram, capacity):
    """Number of sequences of a plan that places every piece once without gaps."""
    placed, sequences = defaultdict(set), defaultdict(list)
    for r in plan.itertuples(index=False):
        for k in range(r.count):
            placed[r.length].add(r.first + k)
            sequences[r.base + k // r.copies].append((r.offset + k % r.copies * r.length, r.length))
    assert {n: len(s) for n, s in placed.items()} == histogram
    assert all(s == set(range(histogram[n])) for n, s in placed.items())
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_plan():
    for seed in range(120):
        r = np.random.default_rng(seed)
        capacity = int(r.choice([7, 20, 100, 2048]))
        drawn = r.integers(1, capacity + 1, 300) if seed % 2 else np.minimum(capacity, r.geometric(4 / capacity, 300))
        lengths, counts = np.unique(drawn, return_counts=True)
        histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        n = checked(packing.plan(histogram, capacity), histogram, capacity)
        tokens_in = int((lengths * counts).sum())
        assert -(-tokens_in // capacity) <= n <= 1.25 * tokens_in / capacity + int((2 * drawn > capacity).sum()) / 2 + 2
    assert len(packing.plan({})) == 0
    assert checked(packing.plan({5: 1}, 10), {5: 1}, 10) == 1
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_plan_of_two_to_a_bin():
    """Large pieces alone: as few sequences as an exact two-to-a-bin matching needs."""
    for seed in range(60):
        r = np.random.default_rng(seed)
        drawn = sorted(r.integers(34, 101, 80).tolist())
        lengths, counts = np.unique(drawn, return_counts=True)
        histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        need, left = 0, list(drawn)
        while left:
            a = left.pop()
            fit = [i for i, b in enumerate(left) if a + b <= 100]
            if fit:
                left.pop(fit[-1])
            need += 1
        assert checked(packing.plan(histogram, 100), histogram, 100) == need


def test_packing(spark, sf, texts, awkward, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 3)
    library = Tokenizer.from_file(WORDS)
    got, sequences = {}, defaultdict(list)
    for r in queries.op8_packing(spark, sf).collect():
        got[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        sequences[r.sequence_id].append((r.offset, r.length))
    want, total = {}, 0
    for i, t in texts[0].items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k in range(-(-len(ids) // 2048)):
            own = ids[k * 2048 : (k + 1) * 2048]
            want[i, k] = (k * 2048, len(own), zlib.crc32(own.tobytes()))
    assert got == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.02 * total / 2048 + 1
    rows = packing.pack_documents(awkward, WORDS).collect()
    assert sum(r.piece == 0 for r in rows) == len(AWKWARD) and {r.doc_id for r in rows} == {i for i, _ in AWKWARD}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_documents(empty, WORDS).count() == 0


def labelled_rows(n, word, seed):
    r = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}" for a in "ba de fo gu hi ka lo mu ne pi".split() for b in "ra se ti vo xu".split()]
    rows = []
    for i in range(n):
        w = r.choice(vocabulary, r.integers(60, 300)).tolist()
        if i % 2:
            for at in r.integers(0, len(w), 4):
                w[at] = word
        rows.append((" ".join(w), i % 2))
    return rows


def test_toxicity_learns(spark, awkward, empty):
    net = toxicity.fit(labelled_rows(160, "badword", 1))
    best, count = toxicity.Reader(net).log_odds([t for t, _ in labelled_rows(200, "badword,", 2)])
    y = np.array([y for _, y in labelled_rows(200, "badword,", 2)])
    assert ((best > np.median(best)) == (y == 1)).mean() > 0.95
    rows = toxicity.score(awkward, net).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.n_windows for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert toxicity.score(empty, net).count() == 0
    assert toxicity.fit(labelled_rows(6, "x", 1)) is None
    assert {r.score for r in toxicity.score(awkward, None).collect()} == {0.5}


def test_windows_cover_all():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 500):
        starts = toxicity.window_starts(n)
        assert {p for s in starts for p in range(s, s + toxicity.WINDOW)} >= set(range(n))
        assert (np.diff(starts) <= toxicity.STRIDE).all() and (np.diff(starts) > 0).all()


def test_gradients():
    """Backpropagation against differences."""
    net = toxicity.Network({"a": 1}, 3)
    words = (np.array([1, 0, 1]), [np.array([3, 4]), np.array([5]), np.array([3])])
    windows, y = np.array([[0, 1, 2, -1], [1, 0, -1, -1]]), np.array([1.0, 0.0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    weight = np.ones(2)

    def loss():
        logit = toxicity._window_odds(net, words, windows)
        p = toxicity.sigmoid(logit)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    state = {}
    kept = {k: v.copy() for k, v in net.p.items()}
    net.step(words, windows, y, weight, 0.0, state)
    net.p = kept
    for k in ("w", "uf", "ub", "att", "out", "pad", "b"):
        got = state[k][0] / 0.1  # the first moment after one step
        flat, want = net.p[k].reshape(-1), []
        at = np.linspace(0, len(flat) - 1, 5).astype(int)
        for i in at:
            old, d = flat[i], 0.02
            flat[i] = old + d
            up = loss()
            flat[i] = old - d
            want.append((up - loss()) / (2 * d))
            flat[i] = old
        assert np.allclose(got.reshape(-1)[at], want, atol=2e-3), k


def test_quality_learns(spark, awkward, empty):
    good = [(t, 1) for t, _ in labelled_rows(60, "x", 3)]
    bad = [(t.upper().replace(" ", "$$$ "), 0) for t, _ in labelled_rows(60, "x", 4)]
    model = compression_quality.fit([r for pair in zip(good[:40], bad[:40], strict=True) for r in pair])
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(good[40:] + bad[40:])], "doc_id long, text string, y int")
    assert all(r.predicted == r.y for r in compression_quality.score(docs, model).collect())
    rows = compression_quality.score(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert compression_quality.score(empty, model).count() == 0
    assert compression_quality.fit(good[:3]) is None


def test_held_out(spark):
    """Scores of held-out rows at sf0.1 tell the labels apart."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label, least in ((queries.op9_compression_quality, "quality", 0.97), (queries.op1_toxicity, "toxic", 0.93)):
        rows = [r for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]
        y = np.array([labels[r.doc_id][label] for r in rows])
        order = np.argsort(np.argsort([r.score for r in rows]))
        auc = (order[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()
        assert auc > least


def test_labels_used(spark):
    assert labelled.remainder_of(7, 5) == spark.range(7, 8).select(labelled.remainder(__import__("pyspark").sql.functions.col("id"), 5)).first()[0]
