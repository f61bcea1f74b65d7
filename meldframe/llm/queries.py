"""The registered queries of the subpackage. Each applies its operator to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this subpackage with QUERIES and ORACLES.
_MODULES = ("query_text", "query_records")


def _modules():
    return [importlib.import_module(f"meldframe.llm.{m}") for m in _MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: query for m in _modules() for name, query in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
