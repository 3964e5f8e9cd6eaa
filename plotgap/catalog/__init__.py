"""Query catalogue: every operator bound to derived tables, with its oracle SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotgap.fixtures import Fixture, duckdb_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SECTION: dict[str, str] = {}
SECTIONS = ["functions_q", "tracks_q", "coverage_q", "matching_q", "statistics_q", "air_q", "land_q", "labels_q",
            "raster_q", "sources_q", "streaming_q", "spacetime_q",
            "behaviour_q", "queue_q"]


def query(name: str, sql: str | None = None):
    """Register ``fn(fixture) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        SECTION[name] = fn.__module__.rsplit('.', 1)[-1]
        QUERIES[name] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if re.match(r"(?i)with\s", body):
                body = "," + body[4:]
            ORACLE[name] = f"WITH {duckdb_ctes()}\n{body}"
        return fn
    return register


def load() -> tuple[dict, dict]:
    for section in SECTIONS:
        importlib.import_module(f"plotgap.catalog.{section}")
    return QUERIES, ORACLE
