"""Queries that SQL can express give the SQL's rows."""

import textwrap

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows
from fieldspark.llm import license_scan, quality_rules, queries, warc
from fieldspark.llm.common import shared_folder, written

OPERATORS = queries.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = OPERATORS[name](spark, sf)
    cur = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


def test_registered():
    numbers = {int(n[2:].split("_")[0]) for n in OPERATORS if n.startswith("op")}
    assert numbers == set(range(1, 14))
    assert "pipeline" in entry.queries()


def test_quality_rules_edges(spark, awkward, empty):
    got = {r.doc_id: r for r in quality_rules.judge(awkward.select("doc_id", "text")).collect()}
    for i in (1, 2, 3, 8):
        assert (got[i].n_words, got[i].n_repeat_words, got[i].base_failed, got[i].kept) == (0, 0, True, False)
    assert got[4].n_words == 30_000 and got[4].n_repeat_words == 30_000
    assert got[7].n_words == 5 and got[7].word_chars == len("ÄÖß日本語\U0001f600text")
    clashing = awkward.withColumnsRenamed({"class": "__w", "score": "n_words", "first": "verdict"})
    same = {r.doc_id: r for r in quality_rules.judge(clashing).collect()}
    assert same[4]["__w"] == "x" and same[4].verdict is None and same[4].n_words == 30_000
    assert quality_rules.keep(awkward).columns == awkward.columns
    assert quality_rules.keep(empty).count() == 0


@pytest.mark.parametrize(
    "text, repeated",
    [("w233220 x y p1 w2541634 x y p2 w233220 x y p3", 6), ("w2541634 x y w233220 x y p2 w2541634 x y w233220 x y", 12), ("a b c a b c", 6), ("a b c d a b c", 6), ("a a a a", 4), ("a b c", 0), ("a b a b a b", 6), ("x a b c y a b c z", 6)],
)
def test_repeated_words(spark, text, repeated):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.judge(df).first().n_repeat_words == repeated


def test_texts_are_cut_into_words_once(spark, sf):
    """A filter on the verdict that moves below the projection takes one evaluation with it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (quality_rules.keep(docs), quality_rules.judge(docs), quality_rules.keep(docs.withColumn("n_chars", docs.doc_id + 1))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, plan.count("regexp_extract_all")


@pytest.mark.parametrize("mark", ["# ", "// ", " * ", "", ";; "])
def test_licenses_in_comments(spark, mark):
    """Whole texts wrapped into comments of 70 characters a line, behind a copyright line."""
    texts = {"MIT": license_scan._MIT, "Apache-2.0": license_scan._APACHE_NOTICE, "MPL-2.0": license_scan._MPL2_NOTICE,
             "BSD-3-Clause": dict(license_scan.KNOWN[-4:-3])["BSD-3-Clause"]}
    docs = []
    for i, t in enumerate(texts.values()):
        lines = ["Copyright 2020 Some One", ""]
        for paragraph in t.split("\n\n"):
            lines += [*textwrap.wrap(paragraph, 70), ""]
        docs.append((i, "\n".join((mark + x).rstrip() for x in lines)))
    docs.append((9, "A conversion 2 of it.\nconv2"))
    found = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), license_scan.known(spark)).collect()
    assert {(r.doc_id, r.license_id) for r in found if r.unit == "text"} == set(enumerate(texts))
    assert sum(r.unit == "paragraph" and r.license_id == "BSD-3-Clause" for r in found) == 5
    assert not any(r.doc_id == 9 for r in found)


def test_licenses(spark, awkward, empty):
    mit = license_scan._MIT
    docs = [
        (1, "Copyright 2020 A. Person\n\n" + mit.upper().replace("LICENSE", "LICENCE")),
        (2, "intro\n\n" + mit + "\n\nmore"),
        (3, "some text\nReleased under the MIT licence!"),
        (4, mit.replace("free of charge", "for a fee")),
    ]
    found = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), license_scan.known(spark))
    got = {(r.doc_id, r.license_id, r.unit, r.place) for r in found.collect()}
    assert (1, "MIT", "text", 0) in got and (3, "MIT", "line", 1) in got
    assert {p for d, _, u, p in got if (d, u) == (2, "paragraph")} == {1, 2, 3}
    assert not any(d == 2 and u == "text" for d, _, u, _ in got)
    assert {p for d, _, u, p in got if (d, u) == (4, "paragraph")} == {1, 2}
    assert license_scan.scan(awkward, license_scan.known(spark)).count() == 0
    assert license_scan.scan(empty, license_scan.known(spark)).count() == 0


def pages_back(spark, rows):
    folder = shared_folder(spark, "warc-test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, original long")
    made = written(warc.write(pages, folder), "made")
    assert made.agg({"records": "sum"}).first()[0] in (len(rows), None)
    if rows:
        listed = sorted(r.name for r in warc.archives(spark, folder).collect())
        assert listed == sorted(r.name for r in made.collect())
    return folder, [r.asDict() for r in warc.read_archives(made, folder, 2).collect()]


def test_warc_edges(spark):
    big, other = "é" * 500, "x" * 1000
    rows = [(1, "http://a", big), (9, None, big), (9, "http://b", big), (3, "u", big), (None, "u", big), (None, "n", other),
            (4, "u", None), (5, "u", ""), (6, "u", "y" * 999), (7, "u", "y" * 999)]
    _, got = pages_back(spark, [(*r, "d", 0) for r in rows])
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in got)
    assert [k for k in kinds if k[1] == "revisit"] == sorted(
        [("urn:page:1", "revisit", "urn:page:9"), ("urn:page:3", "revisit", "urn:page:9"), ("urn:page:", "revisit", "urn:page:9")]
    )
    by = {(r["record_id"], r["record_type"]): r for r in got}
    assert bytes(by["urn:page:9", "response"]["payload"]).decode() == big
    assert by["urn:page:1", "revisit"]["payload_bytes"] == 1000
    assert bytes(by["urn:page:4", "response"]["payload"]) == b"" and by["urn:page:", "response"]["payload_bytes"] == 1000
    assert pages_back(spark, [])[1] == []


def test_warc_damage(tmp_path):
    good = warc.record("urn:page:1", "u", b"p" * 200_000) + warc.record("urn:page:2", None, b"q", "urn:page:1")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(good)
    with path.open("rb") as f:
        a, b = warc.read(f)
    assert a.payload == b"p" * 200_000 and b.payload_bytes == 1 and b.headers["warc-refers-to"] == "<urn:page:1>"
    path.write_bytes(good[:-20])
    with path.open("rb") as f, pytest.raises(ValueError, match="ends inside"):
        list(warc.read(f))
    import gzip

    plain = gzip.decompress(warc.record("urn:page:1", "u", b"abc"))
    for wrong in (plain.replace(b"abc", b"abd"), plain.replace(b"Content-Length: 3\r\n\r\nabc", b"Content-Length: 3\r\n\r\nabcd")):
        path.write_bytes(gzip.compress(wrong))
        with path.open("rb") as f, pytest.raises(ValueError):
            list(warc.read(f))
