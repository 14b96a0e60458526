"""Registered queries by name, each over the whole given tables, and their SQL.

Every query applies library operators to the given tables; SQL gives the same columns and values,
doubles rounded to six places on both sides where they are sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation, files, fits, labels, relations, sequences, statistics, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (vectors, curation, relations, sequences, labels, statistics, files, fits):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
