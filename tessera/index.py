"""Indexes: ordered access to a relation variable by one column.

An index excludes rows whose key is NULL. On stored variables an indexed column also orders the rows within the files
it is written to, so a lookup or range skips row groups by their statistics; the plan is an ordinary filter or sort
that Catalyst pushes to the scan.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.semantics import value

if TYPE_CHECKING:
    from tessera.relvar import Relvar

TESTS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


class Index:
    def __init__(self, relvar: Relvar, key: str):
        self.relvar, self.key = relvar, key

    def _where(self, test: Column) -> DataFrame:
        return self.relvar.scan().where(test)

    def rows(self) -> DataFrame:
        """All rows whose key is not NULL."""
        return self._where(F.col(self.key).isNotNull())

    def getn(self, at: Any) -> DataFrame:
        """Rows whose key equals at; none for NULL."""
        return self._where(F.col(self.key) == value(at))

    def get1(self, at: Any, default: Any = None) -> Any:
        """The first such row in insertion order, or default."""
        rows = self.getn(at).orderBy("_rsn").head(1)
        return rows[0] if rows else default

    def range(self, test: str, a: Any, test2: str | None = None, b: Any = None) -> DataFrame:
        """Rows whose key passes one or two tests of <, <=, >, >=, in either order."""
        if test not in TESTS or (test2 is not None and test2 not in TESTS):
            raise ValueError("a range takes the tests <, <=, > and >=")
        p = TESTS[test](F.col(self.key), value(a))
        return self._where(p if test2 is None else p & TESTS[test2](F.col(self.key), value(b)))

    def asc(self) -> DataFrame:
        """Rows by ascending key, rows of one key in insertion order."""
        return self.rows().orderBy(F.col(self.key).asc(), F.col("_rsn").asc())

    def desc(self) -> DataFrame:
        return self.rows().orderBy(F.col(self.key).desc(), F.col("_rsn").desc())

    def top_k(self, n: int) -> DataFrame:
        return self.desc().limit(n)

    def bottom_k(self, n: int) -> DataFrame:
        return self.asc().limit(n)
