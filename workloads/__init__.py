"""Registered queries: every operator over the driver's tables, with equal SQL where there is one."""

from __future__ import annotations

import importlib

_MODULES = ("tables_q", "tracks_q", "raster_q", "geometry_q", "photos_q", "report_q", "logs_q", "files_q", "scenes_q", "helpers_q", "outlines_q")


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in _MODULES:
        module = importlib.import_module(f"workloads.{name}")
        for key, (fn, sql) in module.REGISTRY.items():
            queries[key] = fn
            if sql is not None:
                oracles[key] = sql
    return queries, oracles
