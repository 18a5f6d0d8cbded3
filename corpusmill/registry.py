"""Queries of the engine and their SQL, gathered from the modules of plans/."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill import plans


def _modules():
    for m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        yield importlib.import_module(f"corpusmill.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLE", {}).items()}
