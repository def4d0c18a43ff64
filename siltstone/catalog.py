"""The registry of this package's own queries and their DuckDB counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone import registry

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("windows", "filters", "aggregates", "joins", "paging", "text", "dates", "scores", "resolution", "semistructured", "sources", "streams", "fields", "review", "registry", "extraction", "news", "scalars", "ledgers", "shapes", "projects", "worksheets")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"siltstone.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest evidence of each project."""
    _load()
    return registry.QUERIES["latest_evidence_per_project"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
