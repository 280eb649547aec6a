"""All queries outside the training-data subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_blend, q_catalog, q_edges, q_geometry, q_graph, q_grid, q_match, q_matrices, q_more, q_poses, q_records, q_replay, q_robust, q_runs, q_scan, q_sources, q_tiles, q_timeline

MODULES = (q_grid, q_robust, q_blend, q_match, q_timeline, q_runs, q_graph, q_catalog, q_geometry, q_scan, q_edges, q_matrices, q_records, q_sources, q_tiles, q_more, q_poses, q_replay)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
