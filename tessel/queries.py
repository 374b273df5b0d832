"""Registry of the library's own queries and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("search_queries", "state_queries", "catalog_queries", "text_queries", "segment_queries", "pipeline_queries", "rendering_queries", "cycle_queries", "structure_queries")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"tessel.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage retrieval: the nearest sections, then the chunks nearest to each."""
    return QUERIES["hierarchical_search"](spark, sf_dir)
