"""The catalogue of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sessionledger.plans.binding import with_views
from sessionledger.session import pin_utc

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Plan
    text: str | None

    @property
    def sql(self) -> str | None:
        """The SQL twin with its views, which may come from modules that are loaded later."""
        return with_views(self.text) if self.text else None


CATALOGUE: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a plan under ``name``; ``covers`` lists the inventory ids it answers."""

    def deco(fn: Plan) -> Plan:
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_utc(spark), sf_dir)

        CATALOGUE[name] = Query(name, tuple(covers.split()), run, sql)
        return fn

    return deco
