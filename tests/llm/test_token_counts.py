"""Token counts equal the library's on whole texts."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldspark.llm import queries, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(BYTES)
COUNTER = token_counts.TokenCounter(BYTES)
ODD = ["a  b\n\n c\t\td", "it's  I'LL we've 's", "<|endoftext|> x", "a  <|endoftext|>  \n b<|endoftext|>", "naïve É!!! ÀÇ 12345 1a2b²³",
       "\n\nx \n y", "日本語 text  日本 語", "x\x1cy \x1c z", "a\xa0b \xa0c", "é é", "''s 's' 't", "  ", "\r\n a \r b ", "ß ÿ Ÿ ŉ İ ı ǅ ʯ",
       "", "a" * 5000, "soft\xadhyphen a\xad b", "a​b ​ c 　 d e", "x\x85y \x85 z", "\U0001f600 \U0001f600\U0001f600  x", "\x0b\x0c x\x00y \x00"]


def want(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("block", [token_counts.BLOCK, 7])
def test_counts_equal_the_library(block, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    monkeypatch.setattr(token_counts, "KEPT", 50)
    counter = token_counts.TokenCounter(BYTES, {" the": 1})
    rows = [*texts[0].values(), *ODD]
    assert [counter.count(t) for t in rows] == [want(t) for t in rows]


def test_every_certain_character(monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 3)
    counter = token_counts.TokenCounter(BYTES)
    for c in map(chr, range(0x2B0)):
        for t in (f"a{c}b", f"1{c}2", f" {c} {c}", f"!{c}!\n{c}", f"'{c}s {c}'s", f"a {c}\n\n{c}{c}  "):
            assert counter.count(t) == want(t), (hex(ord(c)), t)


ALPHABET = st.sampled_from([*"abT '19.,!-\n\t\r\x0b\x1f", "\x85", "\xa0", "é", "²", "日", "　", "​", "\U0001f600", "'s", "'ve", "<|endoftext|>", "  "])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join), st.integers(1, 20))
def test_any_text(text, block):
    before, token_counts.BLOCK = token_counts.BLOCK, block
    try:
        COUNTER.known.clear()
        assert COUNTER.count(text) == want(text)
    finally:
        token_counts.BLOCK = before


def test_other_files(texts):
    rows = [*list(texts[0].values())[:20], *ODD]
    library = Tokenizer.from_file(WORDS)
    counter = token_counts.TokenCounter(WORDS)
    assert [counter.count(t) for t in rows] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in rows]
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.TokenCounter(path)
    assert [counter.count(t) for t in rows] == [len(pieces.encode(t or "")) for t in rows]


def test_tier_one(spark, awkward, empty):
    lengths = token_counts.frequent_lengths(awkward, BYTES, entries=100)
    assert 0 < len(lengths) <= 100 and all(n == want(p) for p, n in lengths.items())
    assert token_counts.unpack(token_counts.pack(lengths)) == lengths
    odd = {"": 0, " ÄÖ": 3, "\x00\n": 2}
    assert token_counts.unpack(token_counts.pack(odd)) == odd
    assert token_counts.frequent_lengths(empty, BYTES) == {}
    # Every length comes from the table where it has one: counts would follow a wrong entry.
    wrong = token_counts.count_tokens(spark.createDataFrame([(1, "short")], "doc_id long, text string"), BYTES, {"short": 77})
    assert wrong.first().n_tokens == 77


def test_rows(spark, awkward, empty):
    renamed = awkward.withColumnRenamed("first", "n_tokens").withColumnRenamed("class", "n_bytes")
    got = token_counts.count_tokens(renamed, BYTES, limit=1024)
    assert got.columns == [*renamed.columns, "over_limit"] or set(got.columns) == {*renamed.columns, "over_limit"}
    rows = got.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want(r.text), want(r.text) > 1024)
    assert token_counts.count_tokens(empty, BYTES).count() == 0


def test_query(spark, sf, texts):
    rows = queries.op11_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len((t or "").encode()), want(t), want(t) > 1024) for i, t in texts[0].items()
    }
    assert "Exchange" not in queries.op11_token_counts(spark, sf)._jdf.queryExecution().executedPlan().toString()
