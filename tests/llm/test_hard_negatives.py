"""Hard negatives equal those found by scoring every pair."""

import math

import numpy as np
import pyarrow as pa
import pytest

from fieldspark.llm import hard_negatives, queries
from fieldspark.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, block string, score double, rank int"


def brute(rows):
    """All (anchor, positive, rank, negative, scores), as a sorted list; rows: (vec_id, embedding, label)."""
    used = []
    for i, e, y in rows:
        if i is None or e is None or y is None or any(c is None or not math.isfinite(c) for c in e):
            continue
        used.append((i, [math.floor(256 * float(np.float32(c))) for c in e], (y + 1) % 10 if i % 7 == 0 else y))
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, a, y in used:
        if i % 100:
            continue
        ranked = sorted(((-score(a, x), j, z) for j, x, z in used))
        for p, j, _ in [r for r in ranked if r[2] == y and r[1] != i][:5]:
            fits = [r for r in ranked if r[2] != y and 30 * -p <= 100 * -r[0] <= 90 * -p][:10]
            out += [(i, j, k, n, -p, -s) for k, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def answer(df):
    assert df.schema.simpleString() == (
        "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"
    )
    return sorted(tuple(r) for r in df.collect())


def mined(spark, rows, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame([(*r, "b", 1.0, 1) for r in rows], SCHEMA).repartition(3))
    return answer(queries.op12_hard_negatives(spark, ""))


def some(n, width, rng, clusters=0, step=25):
    centres = rng.normal(size=(max(1, clusters), width))
    x = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, width)) if clusters else rng.normal(size=(n, width))
    x /= np.sqrt((x * x).sum(1))[:, None]
    return [(int(i) * step, [float(np.float32(c)) for c in v], int(y)) for i, (v, y) in enumerate(zip(x, rng.integers(0, 10, n), strict=True))]


def test_query_on_the_table(spark, sf, monkeypatch):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()]
    want = brute(rows)
    assert len(want) > 100
    assert answer(queries.op12_hard_negatives(spark, sf)) == want


@pytest.mark.parametrize("clusters", [0, 12])
def test_small_blocks(spark, clusters, monkeypatch):
    for name, value in (("ROWS", 16), ("ANCHORS", 5), ("CELL_ROWS", 4), ("CELL_ANCHORS", 3), ("PROBE", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = some(400, 12, np.random.default_rng(5), clusters)
    assert mined(spark, rows, monkeypatch) == brute(rows)


def test_edges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = some(120, 6, rng)
    hot = rows[3][1]
    rows += [(100_000 + i, hot, i % 3) for i in range(60)]
    rows += [(7_000, [0.0] * 6, 1), (7_100, [], 2), (7_200, [1.0, 2.0], 3), (7_300, [3.0] * 9, 3), (7_400, [-1e3] * 6, 3), (7_401, [9e4] * 6, 3),
             (None, hot, 1), (8_100, None, 1), (8_200, hot, None), (8_300, [1.0, None], 1), (8_400, [float("nan")], 1),
             (8_500, [float("inf"), 0.0], 1), rows[0], rows[0], rows[4], (rows[4][0], rows[5][1], 9), (-300, rows[4][1], rows[4][2])]
    assert mined(spark, rows, monkeypatch) == brute(rows)
    assert mined(spark, [], monkeypatch) == []
    assert mined(spark, [(100, [1.0], 1)], monkeypatch) == []
    assert mined(spark, [(100, [0.0], 1), (101, [0.0], 1), (102, [0.0], 2)], monkeypatch) == [(100, 101, 1, 102, 0, 0)]


def test_norms_beyond_exact_scores(spark, monkeypatch):
    with pytest.raises(Exception, match="must be below"):
        mined(spark, [(100, [1e9], 1), (101, [1.0], 1)], monkeypatch)


def as_block(x, references, first=0, label=1):
    norm, angle = hard_negatives.angles_to(x, references)
    a = hard_negatives._Block.__new__(hard_negatives._Block)
    angle = angle.astype(np.float32).astype(float)
    a.label, a.ids, a.x, a.norm, a.angle = label, np.arange(len(x)) + first, x.astype(int), norm, angle
    a.norms, a.angles = (norm.min(), norm.max()), (angle.min(0), angle.max(0))
    return a


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    centres = 100 * rng.normal(size=(6, 10))
    x = np.floor(np.concatenate([c + rng.normal(size=(50, 10)) * s for c in centres for s in (0.5, 20)] + [np.zeros((1, 10)), -centres[:1]]))
    references = centres / np.sqrt((centres**2).sum(1))[:, None]
    a, b = as_block(x[::7], references, 10_000), as_block(x, references)
    true = a.x @ b.x.T
    least, most = hard_negatives.row_bounds(a, np.arange(len(a.ids)), b)
    assert (least <= true).all() and (true <= most).all()
    under, over = hard_negatives.block_bounds(a, b)
    assert (under[:, None] <= true).all() and (true <= over[:, None]).all()
    # In clustered data most products are never worked out.
    blocks = [as_block(x[i : i + 50], references, i) for i in range(0, 600, 50)]
    n = len(a.ids)
    best, scored = hard_negatives.search_block(a, np.full((n, 1), -(2**59)), np.full((n, 1), 2**59), blocks, 5, True)
    assert scored < 0.5 * n * 600
    for k in range(n):
        own = sorted((-int(s), int(i)) for i, s in enumerate(true[k, :600]))[:5]
        assert [(-s, i) for s, i in own] == list(zip(best.score[k, 0].tolist(), best.ids[k, 0].tolist(), strict=True))


def test_whole_numbers():
    lists = pa.array([[0.5, -0.001], [], [1.0]], pa.list_(pa.float64()))
    assert hard_negatives.whole(lists).tolist() == [[128, -1], [0, 0], [256, 0]]
