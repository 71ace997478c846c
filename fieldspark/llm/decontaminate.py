"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over SPAN words of which it ignores some; texts that differ only in ignored words have equal
hashes.  The benchmark's hashes under all masks are looked up in every document's, and around each hit the two texts
are compared word by word on their common alignment: every maximal stretch, in which a word that differs costs as much
as four equal ones earn, is an overlap if it has MIN_WORDS words (all of a shorter item).

Words are lower-cased and stripped of punctuation at their ends.  Items shorter than a mask are looked up whole.

The benchmark is the query set.  It goes to the tasks in blocks of at most BLOCK_WORDS words, one pass over the
documents for each block, so nothing broadcast grows with either table and no document is shuffled.

Edge cases: null and empty texts and items have no words and no overlap; repeated items and documents are reported one
by one; an empty table gives no rows; other columns of either table are ignored by `overlaps` and kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 1 compares a word, 0 ignores it; each mask compares 7 words.
MASKS = ("1111111", "110110110101", "101101011011", "111000001111", "1010101010101")
MIN_WORDS = 13
#: Words of one block of the benchmark.
BLOCK_WORDS = 2_000_000
KEPT_WORDS = 500_000
#: Seeds of so many bits are sifted by a table before they are looked up.
SIFT_BITS = 22

_EDGES = re.compile(r"^\W+|\W+$")
OVERLAP_COLUMNS = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"


class Words(dict):
    """Hashes of words; forgets all when it holds KEPT_WORDS."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        bare = _EDGES.sub("", word) or word
        h = self[word] = xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every place where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, f in enumerate(_factors(len(mask))):
        if mask[i] == "1":
            out += words[i : i + n] * f
    return out ^ (out >> np.uint64(29))


class Block:
    """Items of the benchmark with an index of their seeds for each mask."""

    def __init__(self, items: list[tuple[str | None, str]]):
        hashed = Words()
        self.ids = [i for i, _ in items]
        self.words = [hashed.of(t) for _, t in items]
        shortest = min(map(len, MASKS))
        # Whole items that no mask fits into get a mask of their own length.
        self.masks = [*MASKS, *("1" * n for n in sorted({len(w) for w in self.words if 0 < len(w) < shortest}))]
        self.index = {}
        for mask in self.masks:
            item, place, hashes = [], [], []
            for k, w in enumerate(self.words):
                if len(mask) < shortest and len(w) != len(mask):
                    continue
                h = seeds(w, mask)
                hashes.append(h)
                item.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
            if not hashes or not sum(map(len, hashes)):
                continue
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            sift = np.zeros(1 << SIFT_BITS, bool)
            sift[h >> np.uint64(64 - SIFT_BITS)] = True
            self.index[mask] = (h[order], np.concatenate(item)[order], np.concatenate(place)[order], sift)

    def alignments(self, words: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, shift) with a common seed; words of all texts in a row, ends: where each text ends."""
        found: set[tuple[int, int, int]] = set()
        begins = np.append(0, ends[:-1])
        for mask, (hashes, item, place, sift) in self.index.items():
            h = seeds(words, mask)
            at = np.flatnonzero(sift[h >> np.uint64(64 - SIFT_BITS)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            text = np.searchsorted(ends, at, side="right")
            inside = at + len(mask) <= ends[text]
            at, lo, n, text = at[inside], lo[inside], n[inside], text[inside]
            if not len(at):
                continue
            entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shift = np.repeat(at - begins[text], n) - place[entry]
            rows = np.unique(np.column_stack([np.repeat(text, n), item[entry], shift]), axis=0)
            found.update(map(tuple, rows.tolist()))
        return found


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Begin and end of the stretch with the highest sum of 1 for an equal and -4 for a different word."""
    total = np.append(0, np.cumsum(np.where(equal, 1, -4)))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.flatnonzero(total[: end + 1] == low[end])[-1]), end


def stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The best stretch, then those of what lies before and behind it, of all that have at least so many words; in order."""
    found, parts = [], [(0, len(equal))]
    while parts:
        a, b = parts.pop()
        if b - a < least:
            continue
        i, j = best_stretch(equal[a:b])
        if j > i:
            parts += [(a, a + i), (a + j, b)]
            if j - i >= least:
                found.append((a + i, a + j))
    return sorted(found)


def verified(doc: np.ndarray, item: np.ndarray, shift: int, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """(doc start, item start, words, equal words) of each overlap on this alignment."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    equal = doc[a + shift : b + shift] == item[a:b]
    least = max(1, min(min_words, len(item)))
    return [(a + shift + i, a + i, j - i, int(equal[i:j].sum())) for i, j in stretches(equal, least)]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    block, size = [], 0
    for r in benchmark.toLocalIterator():
        block.append((r[0], r[1] or ""))
        size += len(block[-1][1].split())
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row for each verified overlap of a document and an item; a pair may have several, on one alignment too."""
    spark = docs.sparkSession
    # Ids travel as text: pandas would turn long numbers beside nulls into floats.
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("t"))
    out = spark.createDataFrame([], OVERLAP_COLUMNS)
    names = [c.split()[0] for c in OVERLAP_COLUMNS.split(", ")]
    for items in _blocks(benchmark.select(F.col(item_id).cast("string"), text)):
        shipped = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            block, hashed = Block(shipped.value), Words()
            for batch in batches:
                docs_words = [hashed.of(t) for t in batch["t"]]
                ends = np.cumsum([len(w) for w in docs_words])
                words = np.concatenate(docs_words) if docs_words else np.zeros(0, np.uint64)
                ids, rows = batch["doc_id"].tolist(), []
                for k, i, shift in sorted(block.alignments(words, ends)) if len(words) else ():
                    rows += [(ids[k], block.ids[i], *got) for got in verified(docs_words[k], block.words[i], shift)]
                yield pd.DataFrame(rows, columns=names)

        found = slim.mapInPandas(scan, OVERLAP_COLUMNS.replace("_id long", "_id string"))
        out = out.unionByName(found.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")}))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of docs that have no overlap with any item, with all their columns; one pass per block, no shuffle."""
    kept = docs
    for items in _blocks(benchmark.select(F.lit(0).cast("long"), item_text)):
        kept = kept.filter(~_hit(docs.sparkSession.sparkContext.broadcast(items))(F.col(text)))
    return kept


def _hit(shipped):
    """Whether a text overlaps any item of the block."""

    @F.pandas_udf("boolean")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block, hashed = Block(shipped.value), Words()
        for texts in batches:
            docs_words = [hashed.of(t) for t in texts]
            ends = np.cumsum([len(w) for w in docs_words])
            words, flag = np.concatenate([np.zeros(0, np.uint64), *docs_words]), np.zeros(len(texts), bool)
            for k, i, shift in block.alignments(words, ends) if len(words) else ():
                flag[k] = flag[k] or bool(verified(docs_words[k], block.words[i], shift))
            yield pd.Series(flag)

    return hit
