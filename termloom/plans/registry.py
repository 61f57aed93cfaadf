"""Named queries over a table folder: name -> callable(spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MODULES = ("text_jobs", "structure_jobs", "posting_jobs", "match_jobs", "score_jobs", "version_jobs", "compose_jobs", "rewrite_jobs", "stream_jobs")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for m in MODULES:
        import_module(f"termloom.plans.{m}")
    return dict(QUERIES)
