"""Query registry: a key, its Spark plan and, where SQL can say it, an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hearthspan.sources import derived, written
from hearthspan.sources.tables import table


@dataclass(frozen=True)
class Inputs:
    """The given tables and the inputs Spark derives from them."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in written.LAYOUT:
            return self.held(name)
        return derived.build(self.spark, self.root, name, {n: self.held(n) for n in derived.needs(name) if n in written.LAYOUT})

    def held(self, name: str) -> DataFrame:
        """A written input; one query looks once whether the given files are still the same."""
        memo = self.__dict__.setdefault("_held", {})
        if name not in memo:
            memo[name] = written.written_name(self.spark, self.root, name)
        return self.spark.table(memo[name])


PLANS: dict[str, Callable[[Inputs], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None, uses: str = ""):
    """Register a plan; `uses` lists the derived inputs its SQL twin reads."""

    def register(plan):
        if key in PLANS:
            raise ValueError(f"duplicate query {key}")
        PLANS[key] = plan
        if sql is not None:
            SQL[key] = derived.with_clause(uses.split(), sql)
        return plan

    return register
