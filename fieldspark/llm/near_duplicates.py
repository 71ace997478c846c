"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one class and only its representative, the smallest id, goes on.  Each of TREES
trees sorts the representatives by its own order of the signature's values; a region of a tree is all that share
a prefix of DEPTH values.

Candidates are checked in three rounds.  First every region links its members with its smallest one.  Once the
components of the confirmed links are known, what is left are regions with members in several components.  In these
each member is compared with the next one in the tree's sorted order, which has the longest common prefix with it: the
depth at which two are neighbours follows how crowded the place is.  Members still apart after that are joined exactly:
the shingles of each set are put into one order from rare to frequent, and two sets at the limit share one of the first
(100 - percent) percent of the larger and an even shorter beginning of the smaller one, so only pairs that meet there,
with enough shingles left behind the place, are compared.  The order comes from a histogram of COUNTERS counters over all
these sets; any order gives the same links.  No pair of a region is dropped for how crowded it is.

A pair is dropped early only if its signatures differ so much that the limit is more than five standard deviations
away; links are confirmed on the full shingle sets.

Edge cases: null and empty texts and texts without words have an empty set and no link; shorter texts than a shingle
are one shingle; rows that repeat an id are all rows of the result, and a link of one is a link of that id; rows without
id have the component of their set's class, or null, and never stand for a class; ties cannot change a result; an
empty table gives no rows; other columns are ignored by `near_duplicates` and passed on by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import written
from fieldspark.llm.components import components
from fieldspark.plans.ordered import Sequence
from fieldspark.plans.sizing import broadcast_if_small

TREES, DEPTH = 24, 5
SIGNATURE = TREES * DEPTH
#: Values behind the prefix by which a tree sorts a region, packed by four into a number.
DEEPER = 8
#: Counters by which shingles are ordered from rare to frequent.
COUNTERS = 1 << 18
#: Members of a crowd of equal shingles that one task compares with others at a time.
BLOCK = 4096
#: Ids that may be broadcast to pick the documents whose sets are needed.
MOST_IDS = 500_000
KEPT_WORDS = 500_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Words(dict):
    """Hashes of words (as bytes); forgets all when it holds KEPT_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        # bytes.split() parts at \x09-\x0D and \x20 and nowhere else.
        words = bytes(text).translate(_LOWER).split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i, f in enumerate(_factors(k, 3)):
        h += (words[i : i + len(h)] ^ (words[i : i + len(h)] >> np.uint64(31))) * f
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SIGNATURE values of 32 bits for each non-empty set."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SIGNATURE), np.int32)
    for i, f in enumerate(_factors(SIGNATURE, 5)):
        out[:, i] = (np.minimum.reduceat(flat * f, begin) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def described(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, n_shingles, class (128 bits of the set, null for an empty one), signature."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Words()
        for b in batches:
            sets = [shingle_set(hashed.of(t), k) for t in b["t"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            signed, sig = [None] * len(sets), signatures([sets[i] for i in full]) if full else ()
            for i, row in zip(full, sig, strict=True):
                signed[i] = row
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "class": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "signature": signed,
            })

    # Ids travel as text: pandas would turn long numbers beside nulls into floats.
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    rows = slim.mapInPandas(task, "doc_id string, n_shingles long, class binary, signature array<int>")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _regions(reps: DataFrame) -> DataFrame:
    """region, rep and its sort keys in the region, for each tree."""
    at = lambda i: F.get("signature", (F.col("tree") * DEPTH + i) % SIGNATURE)
    members = reps.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "rep", "signature")

    def packed(first: int):
        key = F.lit(0).cast("long")
        for i in range(first, first + 4):
            key = F.shiftleft(key, 16).bitwiseOR(at(i).bitwiseAND(F.lit(0xFFFF)).cast("long"))
        return key

    keys = [packed(DEPTH + i).alias(f"key{i // 4}") for i in range(0, DEEPER, 4)]
    return members.select(F.xxhash64("tree", *[at(i) for i in range(DEPTH)]).alias("region"), "rep", *keys)


def _estimate_passes(limit: float):
    """Whether two signatures agree often enough for the limit, with five standard deviations of room."""
    least = limit - 5 * (limit * (1 - limit) / SIGNATURE) ** 0.5
    agree = F.aggregate(
        F.zip_with("__sa", "__sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x
    )
    return agree >= int(least * SIGNATURE)


def _sets_of(docs: DataFrame, need: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """The shingle set (as bytes) of each document in need (rep)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Words()
        for b in batches:
            yield pd.DataFrame({"rep": b["rep"], "set": [shingle_set(hashed.of(t), k).tobytes() for t in b["t"]]})

    slim = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("binary").alias("t"))
    sets = slim.join(broadcast_if_small(need, MOST_IDS), "rep", "left_semi").mapInPandas(task, "rep long, set binary")
    # Rows that share an id: the same one of them for every pair.
    return written(sets.groupBy("rep").agg(F.max("set").alias("set")), "sets")


def _confirmed(pairs: DataFrame, reps: DataFrame, percent: int, sets_of) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; sets_of gives the sets of reps."""
    sig = reps.select("rep", "signature", "n_shingles")
    side = lambda c: sig.select(F.col("rep").alias(c), F.col("signature").alias(f"__s{c}"), F.col("n_shingles").alias(f"__n{c}"))
    likely = written(
        pairs.join(side("a"), "a").join(side("b"), "b")
        .filter(100 * F.least("__na", "__nb") >= percent * F.greatest("__na", "__nb"))
        .filter(_estimate_passes(percent / 100)).select("a", "b"),
        "candidates",
    )
    sets = sets_of(likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct())
    both = likely.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b"
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.loc[keep, ["a", "b"]]

    return written(both.select("a", "b", "x", "y").mapInPandas(task, "a long, b long"), "confirmed")


def _apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The members of regions that hold several components, with their component."""
    component = components(found).select(F.col("node").alias("rep"), "component")
    named = shared.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named, "named")
    ends = named.groupBy("region").agg(F.min("component").alias("__low"), F.max("component").alias("__high"))
    mixed = ends.filter("__low < __high").select("region")
    return written(named.join(mixed, "region"), "mixed")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _neighbours(apart: DataFrame) -> DataFrame:
    """(a, b): members of different components that follow each other in a tree's order."""
    order = [*[f"key{i}" for i in range(DEEPER // 4)], "rep"]
    following = lambda df, w: df.withColumns({"next": F.lead("rep").over(w), "other": F.lead("component").over(w)})
    return _pairs(Sequence(apart, ["region"], order).bounded(1, following).result().filter("component <> other"), "rep", "next")


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """shingle, rep, component, n, place: the beginning of each set, ordered from rare to frequent, that a partner must meet."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            flat = np.frombuffer(b"".join(b["set"]), np.uint64) % np.uint64(COUNTERS)
            total += np.bincount(flat.astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"counter": at, "n": total[at]})

    counted = sets.select("set").mapInPandas(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    often = np.zeros(COUNTERS, np.int64)
    for r in counted.toLocalIterator():  # COUNTERS rows at most
        often[r.counter] = r.n
    shipped = sets.sparkSession.sparkContext.broadcast(often)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shipped.value
        for b in batches:
            for rep, component, s in zip(b["rep"], b["component"], b["set"], strict=True):
                s = np.frombuffer(s, np.uint64)
                n = len(s) - -(-percent * len(s) // 100) + 1
                first = s[np.lexsort((s, often[s % np.uint64(COUNTERS)]))[:n]]
                yield pd.DataFrame({"shingle": first.view(np.int64), "rep": rep, "component": component, "n": len(s), "place": np.arange(n)})

    return sets.select("rep", "component", "set").mapInPandas(begin, "shingle long, rep long, component long, n long, place long")


def _exact(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all members of different components that may reach the limit, by the rarest shingles of their sets."""
    named = sets.join(apart.select("rep", "component").distinct(), "rep")
    rare = written(_rare_first(named, percent), "rare-shingles")
    crowd = rare.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(
        F.max_by("component", F.struct("n", "component")).alias("top"), F.min("component").alias("low"),
        F.max("component").alias("high"), F.ceil(F.sum("n") / BLOCK).alias("blocks"),
    ).filter("low < high").select("shingle", "top", "blocks")
    rows = written(rare.join(crowd, "shingle").withColumn("in_top", F.expr("component = top")).drop("top"), "met-shingles")
    # The smaller set of a pair at the limit shares 2 * percent / (100 + percent) of its shingles at least.
    small = rows.filter(f"{100 + percent} * (n - place) >= {2 * percent} * n").select(
        "shingle", "in_top", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"),
        *[F.col(c).alias(f"{c}_x") for c in ("rep", "component", "n", "place")],
    )
    large = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("blocks").withColumnRenamed("in_top", "large_top")
    fits = F.expr(
        f"component_x <> component and (n_x < n or (n_x = n and rep_x < rep)) and 100 * n_x >= {percent} * n"
        f" and {100 + percent} * least(n_x - place_x, n - place) >= {percent} * (n_x + n)"
    )
    met = lambda x, y: x.drop("in_top").join(y.drop("large_top"), ["shingle", "block"]).filter(fits).select("rep_x", "rep")
    # One of a pair is outside the largest component of the crowd.
    found = met(small.filter("not in_top"), large).union(met(small.filter("in_top"), large.filter("not large_top")))
    return _pairs(found, "rep_x", "rep")


def links(docs: DataFrame, described_docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed pairs of class representatives, and the representatives (rep, class, signature, n_shingles)."""
    known = described_docs.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(
        known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min_by("signature", "doc_id").alias("signature"),
                                   F.first("n_shingles").alias("n_shingles")),
        "classes",
    )
    placed = _regions(reps)
    several = placed.groupBy("region").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    shared = written(placed.join(written(several.select("region", "low"), "regions"), "region"), "shared")
    sets_of = lambda need: _sets_of(docs, need, doc_id, text, k)
    tried = written(_pairs(shared.filter("low < rep"), "low", "rep"), "tried")
    found = _confirmed(tried, reps, percent, sets_of)
    apart = _apart(shared.drop("low"), found)
    near = written(_neighbours(apart).join(tried, ["a", "b"], "left_anti"), "tried")
    if near.isEmpty():
        return found, reps
    linked = _confirmed(near, reps, percent, sets_of)
    if not linked.isEmpty():
        found = found.union(linked)
        apart = _apart(shared.drop("low"), found)
    sets = sets_of(apart.select("rep").distinct())
    rest = written(_exact(apart, sets, percent).join(tried.union(near), ["a", "b"], "left_anti"), "tried")
    if rest.isEmpty():
        return found, reps
    return found.union(_confirmed(rest, reps, percent, lambda need: sets)), reps


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    all_docs = written(described(docs, doc_id, text, k), "described")
    found, reps = links(docs, all_docs, doc_id, text, k, percent)
    group = components(found)
    rep_group = reps.select("class", "rep").join(group.withColumnRenamed("node", "rep"), "rep", "left").select(
        "class", F.coalesce("component", "rep").alias("__component")
    )
    return all_docs.select("doc_id", "n_shingles", "class").join(rep_group, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("__component", "doc_id").alias("component_id"),
        (F.coalesce("__component", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their group of near duplicates, with all their columns."""
    gone = near_duplicates(docs, k, percent, doc_id, text).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.col(doc_id).cast("long").alias("__id"))
    return rows.join(gone, F.col("__id") == F.col("__gone"), "left_anti").select("__row.*")
