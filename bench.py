"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

import workloads
from fieldspark.plans.session import local_session

HEADLINE = (
    "attribute_statistics",
    "percentile_stats",
    "circular_means",
    "lines_between",
    "lines_within",
    "segment_metrics",
    "segment_strips",
    "points_to_lines",
    "ndvi",
    "raster_differences",
    "stretch_limits",
    "overviews",
    "resample_bilinear",
    "sample_rasters",
    "clip_raster",
    "spatial_join",
    "regular_grid",
    "photo_sequence",
    "quality_index",
    "classify_values",
    "flights",
    "hourly_means",
    "filter_logs",
    "order_logs",
    "search_scenes",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, _ = workloads.load()
    times = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
