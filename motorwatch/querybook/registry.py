"""Name -> query, name -> equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_CHECKS: dict[str, str] = {}
_MODULES = ("ingestion", "typing", "reporting", "texts", "search", "traces", "answers", "sessions", "lifecycle")


class Tables:
    """The given tables by name, read from one folder; only the columns asked for are scanned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.made(name, lambda: self.spark.read.parquet(self.path(name)))

    def keep(self, label: str, frame: DataFrame) -> None:
        """From here on ``label`` is this frame."""
        self._frames[label] = frame

    def forget(self, label: str) -> None:
        """From here on ``label`` is made anew."""
        self._frames.pop(label, None)

    def made(self, label: str, make: Callable[[], DataFrame]) -> DataFrame:
        if label not in self._frames:
            self._frames[label] = make()
        return self._frames[label]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL check where there is one."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _CHECKS[name] = sql
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"{__package__}.{module}")


def registered() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def checks() -> dict[str, str]:
    _load()
    return dict(_CHECKS)
