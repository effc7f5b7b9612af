"""All registered queries of the library, without those of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskframe.plans import documents, measurement, packages, security

MODULES = (documents, security, measurement, packages)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
