"""Registered queries: name -> callable(spark, sf_dir), and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestitch.plans import detail_queries, job_queries, layout_queries, misc_queries, scalar_queries, source_queries, state_queries, text_queries, version_queries

_MODULES = (detail_queries, job_queries, text_queries, layout_queries, source_queries, misc_queries, scalar_queries, state_queries, version_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
