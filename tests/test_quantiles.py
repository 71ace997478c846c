"""Sketches: ranks within the stated error, the same from merged parts, bounded size."""

import random

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import raster, stats
from fieldspark.plans import quantiles

WANTED = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    """Three groups: skewed values, few distinct values, and one hot group of most rows."""
    d = spark.range(400_000).withColumns({
        "g": F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "few").otherwise("wide"),
        "day": F.col("id") % 7,
    })
    x = F.when(F.col("g") == "few", (F.col("id") % 3).cast("double")).otherwise(F.exp(F.rand(3) * 20))
    return d.withColumn("x", x)


@pytest.mark.parametrize("k", [200, 4096])
def test_rank_error(rows, k):
    held = {}
    for r in rows.select("g", "x").collect():
        held.setdefault(r.g, []).append(r.x)
    whole = quantiles.quantiles_of(quantiles.sketches(rows, ["g"], "x", k), ["g"], WANTED)
    parts = quantiles.merge_sketches(quantiles.sketches(rows, ["g", "day"], "x", k), ["g"], k)
    for d in (whole, quantiles.quantiles_of(parts, ["g"], WANTED)):
        got = d.collect()
        assert {r.g for r in got} == set(held)
        for r in got:
            values, n = held[r.g], len(held[r.g])
            assert r["count"] == n
            for name, q in WANTED.items():
                below, upto = sum(v < r[name] for v in values) / n, sum(v <= r[name] for v in values) / n
                assert below - quantiles.rank_error(k) <= q <= upto + quantiles.rank_error(k), (r.g, name)


def test_size_does_not_follow_the_rows(rows):
    sizes = [quantiles.sketches(rows.limit(n), [], "x", 200).select(F.octet_length("sketch")).first()[0] for n in (5_000, 200_000)]
    assert sizes[1] < 2 * sizes[0] < 20_000


def test_stats_by_sketch(spark):
    rnd = random.Random(2)
    held = [rnd.gauss(0, 10) for _ in range(50_000)]
    d = spark.createDataFrame([(v,) for v in held] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    exact, near = stats.percentile_stats(d, "v", decimals=6).first(), stats.percentile_stats(d, "v", decimals=6, sketch=4096).first()
    assert (near["count"], near["mean"]) == (exact["count"], exact["mean"]) == (50_000, pytest.approx(sum(held) / 50_000, abs=1e-6))
    for name, q in (("p5", 0.05), ("p95", 0.95)):
        assert abs(sum(v <= near[name] for v in held) / 50_000 - q) <= quantiles.rank_error() + 1e-4
    assert near["range"] == pytest.approx(near["p95"] - near["p5"], abs=1e-5)
    none = stats.percentile_stats(d.limit(0), "v", sketch=200).first()
    assert none["count"] == 0 and none["p5"] is None
    px = spark.range(20_000).select(F.lit(1).alias("raster_id"), F.lit(1).alias("band"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.col("id").cast("double").alias("value"))
    limits = raster.stretch_limits(px, sketch=4096).first()
    assert abs(limits.low - 400) < 40 and abs(limits.high - 19_600) < 40
