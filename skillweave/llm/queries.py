"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = "caps survivors encoding leaks spans neardups parsing splitting secrets handwritten".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"skillweave.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
