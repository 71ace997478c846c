"""Near duplicates, lines, components, decontamination and the pipeline against plain Python."""

import os
import random
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import AWKWARD
from fieldspark.llm import decontaminate, line_dedup, near_duplicates, quality_rules, queries
from fieldspark.llm.common import local_path
from fieldspark.llm.components import components


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)]
    pairs += [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(90)]
    want = brute.Sets(sorted({x for p in pairs for x in p}))
    for a, b in pairs:
        want.join(a, b)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {x: want.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def varied(n, seed, changes):
    """n copies of one text with words changed, so that pairs lie around the limit."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(changes)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, sf, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_near_duplicates(spark, sf).collect()}
    assert got == brute.near_duplicates(texts[0], 3, 85)


def test_crowded_regions(spark):
    docs = dict(enumerate(varied(90, 1, 5) + varied(60, 2, 9) + [varied(1, 3, 2)[0]] * 40))
    got = near_duplicates.near_duplicates(frame(spark, docs), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(docs, 3, 85)


def test_template_around_the_limit(spark):
    """Hundreds of texts of one template just under the limit and pairs just above it: no link is lost."""
    r = random.Random(21)
    base = [f"t{i}" for i in range(200)]

    def copy(words, changes):
        w = list(words)
        for at in r.sample(range(len(w)), changes):
            w[at] = f"u{r.randrange(10**9)}"
        return w

    strangers = [copy(base, 8) for _ in range(600)]
    twins = [copy(x, 5) for x in strangers[:120]]
    docs = dict(enumerate(" ".join(x) for x in strangers + twins))
    got = near_duplicates.near_duplicates(frame(spark, docs), 3, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near_duplicates(docs, 3, 85)
    assert 500 < sum(x.kept for x in got) < 720


def test_near_duplicates_edges(spark, awkward, empty):
    rows = near_duplicates.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == got[8][:0] + [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert [x[1] for x in got[5]] == [4, 4] and not any(x[2] for x in got[5])
    assert got[2**60 + 2] == [(4, 2**60 + 1, False)] and got[6] == [(1, 6, True)]
    assert near_duplicates.near_duplicates(empty).count() == 0
    kept = near_duplicates.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 3


def test_lines(spark, sf, texts):
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in queries.op6_line_dedup(spark, sf).collect()}
    assert got == brute.first_lines(texts[0])


def test_varied_lines(spark):
    lines = varied(50, 4, 4) + varied(40, 5, 7) + ["short line"] * 5 + ["a line of more than twenty characters"] * 30
    docs = {i: "\n".join(lines[i::9]) for i in range(9)}
    got = line_dedup.line_table(frame(spark, docs)).collect()
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in got} == brute.first_lines(docs)


def test_similar_lines_become_candidates(spark):
    """Short lines, one word, commas, CJK: each pair of similar lines, by its own, is found as brute force finds it."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for i in range(150):
        prose = [word(r.randrange(4, 9)) for _ in range(r.choice((6, 8, 10, 14)))]
        fields = [word(7) for _ in range(20)]
        long_word, cjk = word(40), "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(60))
        typo = list(prose)
        typo[r.randrange(len(typo))] += "x"
        at = r.randrange(5, 35)
        lines += [" ".join(prose), " ".join(typo), ",".join(fields), ",".join(["changed", *fields[1:]])]
        lines += [long_word, long_word[:at] + "7" + long_word[at + 1 :], cjk, cjk[:30] + "x" + cjk[31:]]
    docs = {i: x for i, x in enumerate(lines)}
    got = line_dedup.line_table(frame(spark, docs)).collect()
    assert {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in got} == brute.first_lines(docs)


def test_crowded_buckets(spark):
    """Templates with free slots: links equal brute force."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = []
    for words, slots in ((24, 4), (16, 3)):
        base, fill = [word() for _ in range(words)], [word() for _ in range(6)]
        for _ in range(150):
            own = list(base)
            for i in r.sample(range(words), slots):
                own[i] = r.choice(fill)
            lines.append(" ".join(own))
    docs = {i: x for i, x in enumerate(lines)}
    got = line_dedup.line_table(frame(spark, docs)).collect()
    assert {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in got} == brute.first_lines(docs)


def test_one_bucket(spark, monkeypatch):
    """Twins that all share one bucket, whose smallest members are unlike most of them."""
    r = random.Random(13)
    bands = line_dedup._bands
    monkeypatch.setattr(line_dedup, "_bands", lambda lines: bands(lines).withColumn("bands", F.array(F.lit(6).cast("long"))))
    docs = {}
    for i in range(60):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(r.choice((5, 20)))]
        docs[2 * i], docs[2 * i + 1] = ",".join(words), ",".join([*words[:-1], words[-1][:-1] + "7"])
    got = line_dedup.line_table(frame(spark, docs)).collect()
    assert {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in got} == brute.first_lines(docs)


def test_unlike_lines_of_a_bucket_are_not_compared(spark, monkeypatch):
    """Twins of short lines in one bucket: similar pairs are compared, most of the unlike ones are not."""
    r, compared = random.Random(19), []
    bands, confirmed = line_dedup._bands, line_dedup._confirmed
    monkeypatch.setattr(line_dedup, "_bands", lambda lines: bands(lines).withColumn("bands", F.array(F.lit(6).cast("long"))))

    def counted(pairs, lines):
        compared.append(pairs.count())
        return confirmed(pairs, lines)

    monkeypatch.setattr(line_dedup, "_confirmed", counted)
    docs = {}
    for i in range(60):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)]
        docs[2 * i], docs[2 * i + 1] = ",".join(words), ",".join([*words[:-1], words[-1][:-1] + "7"])
    got = line_dedup.line_table(frame(spark, docs)).collect()
    assert {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in got} == brute.first_lines(docs)
    assert 59 <= sum(compared) < 300


def test_lines_around_the_limit(spark):
    """Variants of one line: pairs a little over and under the limit, and twins that are like their line only."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base, lines = [word() for _ in range(30)], []
    for i in range(500):
        own = list(base)
        for k in r.sample(range(30), 3):
            own[k] = word()
        lines.append(" ".join(own))
        if i % 5 == 0:
            own[r.randrange(30)] = word()
            lines.append(" ".join(own))
    docs = {i: x for i, x in enumerate(lines)}
    got = line_dedup.line_table(frame(spark, docs)).collect()
    assert {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in got} == brute.first_lines(docs)


def test_line_tables_and_pairs_are_bounded(spark, monkeypatch):
    """Many more pairs than lines: they are compared in passes, and tables that nothing reads any more are gone."""
    r, passes, kept, dropped, written = random.Random(23), [], {}, line_dedup.dropped, line_dedup.written
    bands = line_dedup._bands
    monkeypatch.setattr(line_dedup, "_bands", lambda lines: bands(lines).withColumn("bands", F.array(F.lit(6).cast("long"))))
    monkeypatch.setattr(line_dedup, "MOST_PAIRS", 30)

    def noted(df, name):
        table = written(df, name)
        kept[table.written_to] = name
        passes.append((name, table.count()))
        return table

    def gone(*tables):
        dropped(*tables)
        for t in tables:
            del kept[t.written_to]
            assert not os.path.exists(local_path(t.written_to))

    monkeypatch.setattr(line_dedup, "written", noted)
    monkeypatch.setattr(line_dedup, "dropped", gone)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base, docs = [word() for _ in range(12)], {}
    for i in range(10):
        own = list(base)
        own[i] = word()
        docs[2 * i], docs[2 * i + 1] = " ".join(own), " ".join([*own[:-1], own[-1][:-1] + "7"])
    got = line_dedup.line_table(frame(spark, docs)).collect()
    assert {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in got} == brute.first_lines(docs)
    assert sorted(set(kept.values())) == ["confirmed", "named-lines"]
    passes.clear()
    lines = [docs[i] for i in range(15)]
    pairs = [(a, b) for b in range(15) for a in range(b)]
    links = line_dedup._confirmed(noted(spark.createDataFrame(pairs, "a long, b long"), "all"), spark.createDataFrame(list(enumerate(lines)), "node long, norm string"))
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    want = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    # 105 pairs of 15 lines, 30 at once.
    assert {tuple(x) for x in links.collect()} == want and 0 < len(want) < 105
    assert [name for name, _ in passes].count("confirmed") == 4


def test_line_edges(spark, awkward, empty):
    got = defaultdict(list)
    for r in line_dedup.line_table(awkward).collect():
        got[r.doc_id].append((r.line_no, r.first_doc_id, r.kept))
    assert 1 not in got and got[2] == [(0, 2, True)] and len(got[3]) == 2
    # Rows that repeat id and text are one document.
    assert got[4] == [(0, 4, True)] and got[5] == [(0, 4, False)] * 2
    assert line_dedup.line_table(empty).count() == 0
    left = line_dedup.without_repeats(awkward)
    assert left.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == sorted((i or 0) for i, _ in AWKWARD if i != 5)


def test_decontamination(spark, sf, texts):
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, sf).collect()}
    assert got == brute.exact_overlaps(*texts, 13)


def test_substitutions(spark, awkward, empty):
    r = random.Random(9)
    item = [f"q{i}" for i in range(40)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "four words are here"), (3, None), (4, "")], "item_id long, text string")
    noise = lambda n: [f"z{r.randrange(10**6)}" for _ in range(n)]
    some = list(item)
    for i in (9, 17, 18, 30):
        some[i] = "other"
    docs = {
        1: noise(50) + some + noise(20),
        2: noise(30) + item[5:18] + noise(5),
        3: noise(30) + item[5:14] + noise(5),
        4: noise(5) + "Four words, are HERE.".split() + noise(3),
        5: noise(300),
    }
    df = frame(spark, {k: " ".join(v) for k, v in docs.items()})
    got = {(x.doc_id, x.item_id): x for x in decontaminate.overlaps(df, benchmark).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2)}
    assert (got[1, 1].n_words, got[1, 1].n_equal, got[1, 1].doc_start, got[1, 1].item_start) == (40, 36, 50, 0)
    assert sorted(x.doc_id for x in decontaminate.clean(df, benchmark).collect()) == [3, 5]
    assert decontaminate.clean(awkward, benchmark).columns == awkward.columns
    assert decontaminate.clean(awkward, benchmark).count() == len(AWKWARD)
    assert decontaminate.overlaps(empty, benchmark).count() == 0
    assert decontaminate.overlaps(df, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(df, benchmark.limit(0)).count() == 5


def test_benchmark_in_blocks(spark, sf, monkeypatch):
    whole = {tuple(r) for r in queries.op7_decontamination(spark, sf).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 500)
    assert {tuple(r) for r in queries.op7_decontamination(spark, sf).collect()} == whole


def test_best_stretch():
    r = np.random.default_rng(3)
    for _ in range(200):
        equal = r.random(r.integers(1, 30)) < 0.8
        score = np.where(equal, 1, -4)
        i, j = decontaminate.best_stretch(equal)
        best = max(score[a:b].sum() for a in range(len(equal) + 1) for b in range(a, len(equal) + 1))
        assert score[i:j].sum() == best


def test_all_stretches_of_an_alignment(spark):
    """A better stretch that is too short hides none behind it, and two overlaps of an alignment are two rows."""
    item = [f"q{i}" for i in range(60)]
    changed = lambda at: [f"z{i}" if i in at else w for i, w in enumerate(item)]
    docs = {
        1: changed({*range(12, 20), 27, *range(35, 60)}),  # 12 equal words, then 15 with one changed
        2: changed(set(range(20, 30))),  # 20 equal, 10 changed, 30 equal
        3: changed({*range(12, 24), *range(36, 60)}),  # two runs of 12
    }
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    df = frame(spark, {k: " ".join(v) for k, v in docs.items()})
    got = {(x.doc_id, x.item_start, x.n_words, x.n_equal) for x in decontaminate.overlaps(df, benchmark).collect()}
    assert got == {(1, 20, 15, 14), (2, 0, 20, 20), (2, 30, 30, 30)}
    assert [x.doc_id for x in decontaminate.clean(df, benchmark).collect()] == [3]


@pytest.mark.parametrize(("words", "part", "least"), [(20, 0.05, 0.9), (40, 0.05, 0.97), (40, 0.1, 0.93)])
def test_tolerated_substitutions(words, part, least):
    """The part of items found with so many of their words replaced at random."""
    r = np.random.default_rng(4)
    items = [[f"q{i}x{k}" for k in range(words)] for i in range(400)]
    block, hashed = decontaminate.Block([(str(i), " ".join(x)) for i, x in enumerate(items)]), decontaminate.Words()
    found = 0
    for i, x in enumerate(items):
        doc = hashed.of(" ".join(w if r.random() >= part else f"s{r.integers(1 << 40)}" for w in x))
        hits = block.alignments(doc, np.array([len(doc)]))
        found += any(k == i and decontaminate.verified(doc, block.words[k], shift) for _, k, shift in hits)
    assert found >= least * len(items), found / len(items)


def test_pipeline(spark, sf, texts):
    """Each stage's rows from plain Python, from the stage before as Python made it."""
    got = corpus_pipeline.run(spark, sf).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    passed = {i for (i,) in con.execute(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE kept").fetchall()}
    docs = {i: t for i, t in texts[0].items() if i in passed}
    first, left = brute.first_lines(docs), {}
    for i, t in docs.items():
        own = [x for n, x in enumerate(t.split("\n")) if first[i, n] == (i, n)]
        whole = len(own) == t.count("\n") + 1
        if whole or any(len(brute.compared(x)) >= line_dedup.MIN_CHARS for x in own):
            left[i] = "\n".join(own)
    group = brute.near_duplicates(left, 5, 80)
    docs = {i: t for i, t in left.items() if group[i][1] == i}
    leaks = {d for d, _ in brute.exact_overlaps(docs, texts[1], 13)}
    assert {r.doc_id for r in got} == set(docs) - leaks
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, sf, awkward, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (awkward, empty):
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.collect()
