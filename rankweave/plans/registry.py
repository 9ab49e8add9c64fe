"""Registry of runnable queries and, beside each, the SQL that states its answer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankweave.scale import estimated_bytes
from rankweave.session import deal, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = {}


class Tables:
    """Lazy parquet readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        self._readers: dict[str, DataFrame] = {}
        self._bytes = 0
        deal(self.spark, 0)
        # Tables one query has written for its several uses of them (see ``views.share``).
        self.shared: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._readers:
            self._readers[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self._bytes += estimated_bytes(self._readers[name]) or 0
            deal(self.spark, self._bytes)
        return self._readers[name]


def cte(name: str, body: str) -> None:
    """Name a piece of SQL that oracle statements may refer to."""
    _CTES[name] = body.strip()


def _needed(body: str, seen: dict[str, None], above: tuple[str, ...] = ()) -> None:
    words = set(re.findall(r"\w+", body))
    for name in _CTES:
        if name in words and name not in seen and name not in above:
            _needed(_CTES[name], seen, (*above, name))
            seen[name] = None


def with_ctes(body: str) -> str:
    """Prefix a statement with the named pieces it uses, dependencies first."""
    seen: dict[str, None] = {}
    _needed(body, seen)
    body = body.strip()
    if not seen:
        return body
    head = ",\n".join(f"{name} AS ({_CTES[name]})" for name in seen)
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle SQL."""
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register
