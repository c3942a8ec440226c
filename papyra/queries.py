"""All queries of the document operators over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import assemble, content, files, read

_MODULES = (read, assemble, content, files)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
