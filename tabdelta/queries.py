"""One query for each operator and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import checks, compare, formulas, merge, values

_PLANS = (values, compare, checks, merge, formulas)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for p in _PLANS for k, q in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in _PLANS for k, s in p.ORACLE_SQL.items()}
