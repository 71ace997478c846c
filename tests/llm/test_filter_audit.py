"""The audit equals filters run one after the other in every order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from fieldspark.llm import filter_audit

WIDE = "doc_id long, text string, lang string, part string, mask int, n long, digest string"


def masks(docs):
    """(part, mask) of each (doc_id, text, part) by plain Python."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t],
        ]
        yield part or "", {k for k, f in zip("ABCDE", fails, strict=True) if f}


def brute(docs, labels):
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    rows = [(p, f, i in good, i in toxic) for (p, f), (i, _, _) in zip(masks(docs), docs, strict=True)]
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(r[0] == part and f in r[1] for r in rows) - len(gone),
                    sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def answer(df):
    assert df.schema.simpleString() == "struct<" + filter_audit.SCHEMA.replace(" long", " bigint").replace(", ", ",").replace(" ", ":") + ">"
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def same(spark, docs, labels):
    d = spark.createDataFrame([(i, t, p, "x", 9, 9, "y") for i, t, p in docs], WIDE)
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = answer(filter_audit.audit(d.repartition(3), label_rows))
    assert got == brute(docs, labels)
    return got


def test_every_combination(spark):
    rng = np.random.default_rng(3)
    docs = []
    for k in range(150):
        few, same_words, capitals, sign, copied = rng.random(5) < 0.4
        n = 150 if few else 220
        words = ["same" if same_words and i % 3 else f"w{i}x{k}" for i in range(n)]
        text = " ".join(w.upper() if capitals else w for w in words) + (" 50 %" if sign else "")
        docs.append((k * 2, docs[-1][1] if copied and docs else text, ["de", "en", None, ""][k % 4]))
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 300, 3)]
    got = same(spark, docs, labels)
    assert len({k[0] for k in got}) == 3 and len(got) == 1800


def test_edges(spark, awkward, empty):
    a, b = "word " * 300, "x" * 10 + " A"
    docs = [(5, a, "en"), (5, a, "en"), (5, a, "de"), (9, a, "en"), (None, a, "en"), (None, a, "en"), (None, None, None), (None, None, None),
            (3, None, "en"), (4, "", "en"), (2, b, "en"), (1, b, "fr"), (7, None, None), (8, " \t\n", "")]
    labels = [(5, 1, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (9, 1, None), (99, 1, 1)]
    same(spark, docs, labels)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty.withColumn("lang", empty["class"]), none).count() == 0
    assert same(spark, docs, []) is not None
    wide = awkward.withColumnRenamed("class", "lang")
    rows = [(r.doc_id, r.text, r.lang) for r in wide.collect()]
    assert answer(filter_audit.audit(wide, none)) == brute(rows, [])


def test_survivors():
    cells = np.random.default_rng(1).integers(0, 9, (32, 3))
    want = [[sum(cells[m, k] for m in range(32) if not m & s) for k in range(3)] for s in range(32)]
    assert filter_audit.survivors(cells).tolist() == want


@pytest.mark.parametrize("n", [1, 40])
def test_one_text_everywhere(spark, n):
    docs = [(i, "same text", "en" if i % 3 else "de") for i in range(n)]
    got = same(spark, docs, [])
    assert got["de", "EABCD", 1][0] == 1 and got.get(("en", "EABCD", 1), (0,))[0] == 0
