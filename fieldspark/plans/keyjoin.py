"""Null-safe equi joins on equally named keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Join where every key is equal or both are null; the left keys stay.

    ``small`` marks a right side bounded by the number of partitions or rules.
    Without keys the right side must be a single row.
    """
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if small or not keys:
        renamed = F.broadcast(renamed)
    if not keys:
        return left.crossJoin(renamed)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])
