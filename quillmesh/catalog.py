"""Registered queries over the store and graph operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.queries import changes, graphs, texts, vectors

MODULES = (texts, vectors, graphs, changes)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
