"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def remainder_of(doc_id: int, divisor: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % divisor


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> list[tuple[str, int]]:
    """At most per_class (text, label) rows of each class, the first by a hash of the id.

    Only the chosen ids, 2 * per_class at most, are joined with the texts."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(usable & F.col("y").isin(0, 1)).distinct()
    picked = [
        rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    ids = F.broadcast(picked[0].union(picked[1]))
    found = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    return [(r.text, r.y) for r in sorted(found.collect(), key=lambda r: (r.doc_id, r.y, r.text))]


def share(labels: DataFrame, label: str, usable: Column) -> float:
    """The part of the usable labelled rows that has label 1; one half where there are none."""
    y = F.col(label).cast("int")
    n = labels.filter(usable & y.isin(0, 1)).agg(F.count("*"), F.sum(y)).first()
    return n[1] / n[0] if n[0] else 0.5


def logistic(x, y, rounds: int = 60):
    """Weights of a class-balanced logistic regression by Newton's method; the last weight is the intercept."""
    import numpy as np

    a = np.column_stack([x, np.ones(len(y))]).astype(float)
    w = np.zeros(a.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-3 * w * len(y) * 1e-2
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(len(w)) * 1e-5 * len(y)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
