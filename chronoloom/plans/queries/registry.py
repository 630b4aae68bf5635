"""Where queries and their SQL are kept."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The day on which a run is made; dates after it cannot have happened.
TODAY = dt.date(2025, 6, 1)
_TABLES: dict[tuple, DataFrame] = {}
_KEPT: dict[tuple, object] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def shared(spark: SparkSession, folder: str, name: str,
           make: Callable[[], DataFrame]) -> DataFrame:
    """A table several queries start from, written once per application."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _TABLES:
        _TABLES[key] = cut(make())
    return _TABLES[key]


def kept(spark: SparkSession, folder: str, name: str, make: Callable[[], object]):
    """What several queries start from and what has written its own tables, made once."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what was shared, so that a timed query pays for everything it needs."""
    _TABLES.clear()
    _KEPT.clear()


def text_date(column: str):
    return F.col(column).cast("string").alias(column)
