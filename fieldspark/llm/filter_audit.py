"""Filter interaction audit: what each of five filters removes, in every order, from 32 counts of survivors.

A document's failures are a mask of five bits, worked out by Spark functions on the whole text.  Whether a text repeats
that of a smaller id is decided on digests (SHA-256 of the text): documents are grouped to one row for each digest, part
and label pair before any shuffle, so a text with a third of all rows travels as a few rows, and the group's first row
stays.  Documents then shrink to counts by part and mask, 32 cells a part.

The cells are walked in Gray-code order of the filter subsets: each step switches one filter on or off, a cell's counter
of active failures goes up or down, and the running survivors lose the cell when its counter leaves 0 and get it back
when it returns to 0.  The 32 states of survivors give every step of every order as a difference of two of them.

Filters (words are maximal runs of `[^\\x20\\x09-\\x0D]`, case-sensitive): A under 200 words; B fewer than half of the
words distinct; C over 3 % of the code points in A-Z; D holds any of `#$%&*|`; E the text of a smaller id.

Results of edge cases: a null text is the empty text (no words: fails A, passes B, C and D; all empty texts are equal); a
null part is the empty string; rows without an id never fail E and make no other row fail it; repeated rows count one by
one, and rows that share an id do not fail E because of each other; a document with several label rows counts for a label
if any row gives it 1, label rows without an id for none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import NOT_SPACE, let

FILTERS = "ABCDE"
N_FILTERS = len(FILTERS)
N_STATES = 1 << N_FILTERS

SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failures(docs: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, part, digest of the text and the mask of filters A to D that it fails."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def of_words(w):
        few = F.when(F.size(w) < 200, 1).otherwise(0)
        same = F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0)
        return few + same

    def of_text(t):
        capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
        return F.struct(
            F.sha2(t, 256).alias("digest"),
            (
                let(F.regexp_extract_all(t, F.lit(NOT_SPACE), F.lit(0)), of_words)
                + F.when(100 * capitals > 3 * F.length(t), 4).otherwise(0)
                + F.when(F.rlike(t, F.lit("[#$%&*|]")), 8).otherwise(0)
            ).alias("mask"),
        )

    return docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), let(whole, of_text).alias("__t")
    ).select("doc_id", "part", "__t.digest", "__t.mask")


def label_flags(labels: DataFrame) -> DataFrame:
    """One row an id: whether any of its label rows says good (quality 1) or toxic."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """part, mask of all five filters, documents, good and toxic ones among them."""
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    group = ["digest", "mask", "part", "good", "toxic"]
    rows = (
        failures(docs, part, text)
        .join(label_flags(labels), "doc_id", "left")
        .select("doc_id", "digest", "mask", "part", flag("good"), flag("toxic"))
        # Repeated rows of an id first, where the join has put them together.
        .groupBy("doc_id", *group)
        .agg(F.count("*").alias("n"))
    )
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    cells = rows.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        first.alias("first"),
    )
    # The cells of a digest are few: parts times labels at most.
    smallest = cells.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    passing = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    split = cells.join(smallest, "digest").select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct("mask", passing.alias("n")),
                F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")),
            )
        ).alias("cell"),
    )
    return (
        split.groupBy("part", F.col("cell.mask").alias("mask"))
        .agg(
            F.sum("cell.n").alias("n"),
            F.sum(F.col("cell.n") * F.col("good")).alias("good"),
            F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"),
        )
        .filter("n > 0")
    )


def survivors(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; cells and result are indexed by mask, with a column a measure."""
    failing = np.zeros(N_STATES, np.int64)
    running = cells.sum(0)
    states = np.empty((N_STATES, cells.shape[1]), np.int64)
    states[0] = running
    active = 0
    for k in range(1, N_STATES):
        gray = k ^ (k >> 1)
        toggled = gray ^ active
        members = [m for m in range(N_STATES) if m & toggled]
        if gray & toggled:
            for m in members:
                running = running - cells[m] if failing[m] == 0 else running
                failing[m] += 1
        else:
            for m in members:
                failing[m] -= 1
                running = running + cells[m] if failing[m] == 0 else running
        active = gray
        states[active] = running
    return states


def steps(cells: np.ndarray) -> Iterator[tuple]:
    """A row for each order and step from one part's cells: documents, good and toxic ones by mask."""
    state = survivors(cells)
    everything = N_STATES - 1
    orders_with_before = [factorial(i) * factorial(N_FILTERS - 1 - i) for i in range(N_FILTERS)]
    totals = []
    for f in range(N_FILTERS):
        rest = [s for s in range(N_STATES) if not s >> f & 1]
        shapley = sum(orders_with_before[s.bit_count()] * int(state[s, 0] - state[s | 1 << f, 0]) for s in rest)
        fails = int(state[0, 0] - state[1 << f, 0])
        alone = int(state[everything ^ 1 << f, 0] - state[everything, 0])
        totals.append((fails, alone, shapley))
    for order in permutations(range(N_FILTERS)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed, good, toxic = (int(x) for x in state[before] - state[after])
            fails, alone, shapley = totals[f]
            name = "".join(FILTERS[i] for i in order)
            yield name, step, int(state[after, 0]), removed, fails - removed, alone, good, toxic, shapley
            before = after


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """The columns of SCHEMA: for each part, all 120 orders of the filters and their five steps."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for name, found in zip(batch["part"], batch["cells"], strict=True):
                cells = np.zeros((N_STATES, 3), np.int64)
                for c in found:
                    cells[c["mask"]] = c["n"], c["good"], c["toxic"]
                yield pd.DataFrame([(name, *row) for row in steps(cells)], columns=names)

    cell = F.struct("mask", "n", "good", "toxic")
    parts = mask_cells(docs, labels, part, text).groupBy("part").agg(F.collect_list(cell).alias("cells"))
    return parts.mapInPandas(walk, SCHEMA)


def oracle() -> str:
    """The audit as DuckDB SQL over documents and labels, each order's steps counted from the masks."""
    return f"""
WITH l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic
           FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{NOT_SPACE}') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
      + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, FALSE)::INT AS mask
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
      FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s AS (SELECT filter_order, step, bit, (SELECT coalesce(sum(bit), 0) FROM f g WHERE instr(filter_order, g.letter) < step) AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k, f WHERE letter = filter_order[step]),
r AS (SELECT part, filter_order, step, any_value(s.bit) AS bit,
      sum(n) FILTER (mask & (before + bit)::INT = 0) AS kept,
      sum(n) FILTER (mask & before::INT = 0 AND mask & bit <> 0) AS removed,
      sum(n) FILTER (mask & before::INT <> 0 AND mask & bit <> 0) AS redundant,
      sum(n) FILTER (mask = bit) AS unique_fails,
      sum(good) FILTER (mask & before::INT = 0 AND mask & bit <> 0) AS good_lost,
      sum(toxic) FILTER (mask & before::INT = 0 AND mask & bit <> 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r"""
