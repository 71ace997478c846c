"""Token counts of whole texts by a two-tier lookup of pre-tokens in the tasks that read them.

A byte-level vocabulary splits a text by a fixed pattern before any merge, so a text has as many tokens as its
pre-tokens have together.  Tier one is a table of frequent pre-tokens and their lengths in tokens: made once from a
bounded sample, packed into flat buffers and broadcast (ENTRIES entries at most, about a megabyte).  Tier two is a cache
of the Python worker: pre-tokens in neither are encoded by the library, in one call for a stretch of text, and kept.
No pre-token is shuffled and the counts do not depend on the sample: it only says what is looked up and what is encoded.

The pattern is applied here to characters up to U+02AF, whose classes are certain; a run of other characters between
white space goes to the library as it is, and so do strings of added tokens.  A text is cut only after a character that
is certainly not white space and before ASCII white space, where no merge and no pre-token crosses.  A file of another
kind (a normaliser, another pre-tokeniser, a sentencepiece model) has the library encode whole texts.

Results of edge cases: a null text counts as empty and has 0 bytes and 0 tokens; a text of white space has the tokens of
its white space; a very long text is read in stretches of BLOCK characters, a run without white space as a whole; repeated
rows and rows without an id are counted one by one; an empty table gives no rows; other columns pass through, and the
result's own columns replace columns of the same name.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Files and documents that tier one is made from, and its entries.
SAMPLE_FILES, SAMPLE_DOCS, ENTRIES = 8, 2_000, 65_536
#: Pre-tokens of a worker's cache, the longest that is kept, and characters that are split at a time.
KEPT, LONGEST, BLOCK = 400_000, 64, 1 << 18

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_DIGITS = "0-9²³¹¼-¾"
#: Characters whose classes are certain: ASCII without the separators 0x1C to 0x1F, Latin letters and signs.
_CERTAIN = "\\x00-\\x1b\\x20-\\x7f\xa1-\xac\xae-ʯ"
_PLAIN = re.compile(f"[{_CERTAIN}]*")
#: Fixed value: the pattern of byte-level vocabularies, here for certain characters alone.
_PRE_TOKENS = re.compile(
    rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_DIGITS}]+| ?[^\t-\r {_LETTERS}{_DIGITS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
#: The end of a certain character that is not white space, before ASCII white space.
_CUT = re.compile("(?<=[\\x21-\\x7e\xa1-\xac\xae-ʯ])(?=[\t-\r ])")


class TokenCounter:
    """Counts tokens of texts; `frequent` maps pre-tokens to their lengths in tokens."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.frequent = frequent or {}
        self.known = dict(self.frequent)
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cuts = False
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        form, added = json.loads(self.library.to_str()), self.library.get_added_tokens_decoder().values()
        before = form["pre_tokenizer"] or {}
        self.special = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)")
        self.cuts = (
            form["normalizer"] is None
            and (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        )

    def lengths(self, pieces: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(i) for i in self.pieces.encode(pieces, num_threads=1)]
        return [len(e.ids) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def split(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, and what the library has to split itself, a stretch at a time."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = cut.start() if cut else len(text)
            yield self._pre_tokens(text[at:end])
            at = end

    def _pre_tokens(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and not self.special.search(text):
            return _PRE_TOKENS.findall(text)
        runs, found = _CUT.split(text), []
        for run in runs:
            if _PLAIN.fullmatch(run) and not self.special.search(run):
                found += _PRE_TOKENS.findall(run)
            elif run:
                found.append(run)
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts:
            return self.lengths([text])[0]
        return sum(map(self._count, self.split(text)))

    def _count(self, pieces: list[str]) -> int:
        try:
            return sum(map(self.known.__getitem__, pieces))
        except KeyError:
            pass
        if len(self.known) > KEPT + len(self.frequent):
            self.known = dict(self.frequent)
        missing = list({p for p in pieces if p not in self.known})
        fresh = dict(zip(missing, self.lengths(missing), strict=True))
        self.known |= {p: n for p, n in fresh.items() if len(p) <= LONGEST}
        # Pieces too long to be kept are found among the fresh ones only.
        return sum(fresh[p] if p in fresh else self.known[p] for p in pieces)


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """Tier one as flat buffers: the pre-tokens one after the other, their sizes in bytes, their lengths in tokens."""
    rows = [p.encode("utf-8", "surrogatepass") for p in lengths]
    return b"".join(rows), np.array([len(r) for r in rows], "<u4").tobytes(), np.array(list(lengths.values()), "<u4").tobytes()


def unpack(buffers: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    whole, sizes, lengths = buffers[0], np.frombuffer(buffers[1], "<u4"), np.frombuffer(buffers[2], "<u4").tolist()
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    starts = [0, *ends]
    return {whole[a:b].decode("utf-8", "surrogatepass"): n for a, b, n in zip(starts, ends, lengths, strict=False)}


def sample_files(spark: SparkSession, docs: DataFrame, files: int = SAMPLE_FILES) -> DataFrame:
    """The rows of at most `files` files of a table of Parquet files, spread evenly over them."""
    names = sorted(docs.inputFiles())
    if not names:
        return docs
    return spark.read.schema(docs.schema).parquet(*names[:: -(-len(names) // files)])


def frequent_lengths(sample: DataFrame, path: str, docs: int = SAMPLE_DOCS, entries: int = ENTRIES, text: str = "text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of at most `docs` rows, counted in one task on an executor.

    At most `entries` pre-tokens, none longer than LONGEST, come to the driver."""

    def most(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, seen = TokenCounter(path), Counter()
        for batch in batches:
            for t in batch["text"] if counter.cuts else ():
                for pieces in counter.split(t or ""):
                    seen.update(p for p in pieces if len(p) <= LONGEST)
                if len(seen) > 8 * entries:
                    seen = Counter(dict(seen.most_common(4 * entries)))
        top = [p for p, n in seen.most_common(entries) if n > 1]
        yield pd.DataFrame({"piece": top, "tokens": counter.lengths(top) if top else []}).astype({"tokens": "int32"})

    rows = sample.select(F.col(text).alias("text")).limit(docs).mapInPandas(most, "piece string, tokens int")
    return {r.piece: r.tokens for r in rows.collect()}


#: Of this Python worker: the counter of the job it works for, with the cache that earlier tasks have filled.
_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(
    docs: DataFrame, path: str, frequent: dict[str, int] | None = None, limit: int = 1024, text: str = "text"
) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit): one pass, no shuffle."""
    table, key = docs.sparkSession.sparkContext.broadcast(pack(frequent or {})), uuid.uuid4().hex

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = TokenCounter(path, unpack(table.value))
        counter = _COUNTERS[key]
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    counted = docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": tokens(F.col(text))}
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
