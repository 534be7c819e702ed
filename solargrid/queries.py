"""Registered queries of the solar engine, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from solargrid.plans import grid, outputs, pixels, polygons, refinement, series, surveys, uncertain

PARTS = (grid, series, pixels, uncertain, surveys, polygons, outputs, refinement)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for p in PARTS for k, s in p.ORACLES.items()}
