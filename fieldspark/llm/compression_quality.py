"""Quality classifier by compression: which of two zstandard dictionaries, of good or of bad text, packs a text tighter.

A text is compressed in pieces of PIECE bytes with either dictionary; (bad size - good size) / bytes is mapped to
a score by a logistic curve fitted on labelled texts that no dictionary was built from, and moved to the share of good
texts among all labelled ones, so that a score is the odds of label 1 there.

Edge cases: null and empty texts compress to nothing, their difference is 0 and the score is the curve's value
there; ties and repeated rows are scored one by one; with fewer than MIN_FIT texts of a class every score is 0.5;
an empty table gives an empty result; other columns are passed on by `score`, its output columns win over theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import labelled

PIECE = 2048
DICTIONARY_BYTES = 65536
LEVEL = 3
#: Labelled rows of each class to learn from; the sample that reaches the driver is never larger.
PER_CLASS = 1500
MIN_FIT = 8
#: Trained dictionaries are built from at most so many bytes of a class.
TRAIN_BYTES = 4 << 20


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


class Sizer:
    """Compressed bytes of a text for each dictionary."""

    def __init__(self, model: Model):
        def compressor(content):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False
            )

        self.good, self.bad = compressor(model.good).compress, compressor(model.bad).compress

    def difference(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0
        cut = pieces(data)
        return (sum(len(self.bad(p)) for p in cut) - sum(len(self.good(p)) for p in cut)) / len(data)


def _dictionary(texts: list[str]) -> bytes:
    samples, total = [], 0
    for p in (p for t in texts for p in pieces(t.encode("utf-8", "surrogatepass"))):
        if total >= TRAIN_BYTES:
            break
        samples.append(p)
        total += len(p)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves as raw content
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def fit(rows: list[tuple[str, int]], prior: float = 0.5) -> Model | None:
    """Dictionaries from two thirds of the rows, the curve from the others.

    prior: the share of good documents among those to be scored."""
    if min(sum(y == k for _, y in rows) for k in (0, 1)) < MIN_FIT:
        return None
    build = [r for i, r in enumerate(rows) if i % 3]
    tune = [r for i, r in enumerate(rows) if not i % 3]
    good, bad = (_dictionary([t for t, y in build if y == k]) for k in (1, 0))
    sizer = Sizer(Model(good, bad, ()))
    x = np.array([[sizer.difference(t)] for t, _ in tune])
    a, b = labelled.logistic(x * 10, np.array([y for _, y in tune]))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    return Model(good, bad, (a, b + np.log(prior / (1 - prior))))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted; one pass, no shuffle."""
    if model is None:
        return docs.withColumns({"score": F.lit(0.5), "predicted": F.lit(int(threshold <= 0.5))})
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shipped.value
        sizer = Sizer(m)
        for texts in batches:
            x = np.array([sizer.difference(t) for t in texts], dtype=float) * 10
            yield pd.Series(1 / (1 + np.exp(-np.clip(m.weights[0] * x + m.weights[1], -30, 30))))

    return docs.withColumn("score", scored(F.col(text))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
