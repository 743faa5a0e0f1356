"""Named queries over the given tables, each with the SQL that another engine runs to check it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    module: str


REGISTRY: dict[str, Query] = {}


def query(*covers: str, sql: str | None = None):
    """Registers a function (tables -> DataFrame) under its own name.

    `covers` lists the inventory ids it stands for.
    """

    def register(fn):
        from pleonasm.sources.tables import Tables

        name = fn.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, covers, lambda spark, folder: fn(Tables(spark, folder, spread=True)), sql, fn.__module__.rsplit(".", 1)[-1])
        return fn

    return register


def load() -> dict[str, Query]:
    """All queries; importing a module registers what it defines."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"pleonasm.catalog.{module}")
    return REGISTRY


MODULES = ("corpus", "reports", "extraction", "framing", "likeness", "sections", "meanings", "checks", "streams", "whole")
