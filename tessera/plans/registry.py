"""Registration of queries with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as of

from pyspark.sql import DataFrame, SparkSession

from tessera.rel import Rel
from tessera.sources.tables import read_table


@dataclass
class Tables:
    """The tables of a data directory as attributes."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


@dataclass
class Registry:
    QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = of(default_factory=dict)
    SQL: dict[str, str] = of(default_factory=dict)

    def query(self, sql: str | None = None) -> Callable:
        """Register a function of Tables under its name; sql is the equivalent ANSI SQL, if there is one."""

        def add(f: Callable[[Tables], DataFrame | Rel]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                out = f(Tables(spark, sf_dir))
                return out.df if isinstance(out, Rel) else out

            run.__name__ = f.__name__
            self.QUERIES[f.__name__] = run
            if sql:
                self.SQL[f.__name__] = sql
            return run

        return add
