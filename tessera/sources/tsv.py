"""Tab-separated dumps (plain or gzipped) as relations.

A gzipped file can't be split, so it is read by one task however large; ship many files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class TsvColumn:
    """A column and how its text is read: a Spark type, ``flag`` (0 or 1), ``id`` (letters, then a number), or the
    comma lists ``strings`` and ``ids``."""

    name: str
    kind: str = "string"

    def value(self, text: Column) -> Column:
        number = lambda x: F.regexp_extract(x, "^[A-Za-z]*([0-9]+)$", 1).try_cast("long")
        if self.kind == "string":
            return text
        if self.kind == "flag":
            return F.when(text == "1", True).when(text == "0", False)
        if self.kind == "id":
            return number(text)
        if self.kind == "strings":
            return F.split(text, ",", -1)
        if self.kind == "ids":
            return F.transform(F.split(text, ",", -1), number)
        return text.try_cast(self.kind)


def read_tsv(spark: SparkSession, path: str | list[str], columns: list[TsvColumn], header: bool = True) -> DataFrame:
    """A dump with one line per row, ``\\N`` for NULL and no quoting; text that doesn't fit its type is NULL."""
    schema = ", ".join(f"`{c.name}` string" for c in columns)
    raw = spark.read.csv(path, schema=schema, sep="\t", nullValue="\\N", quote="", escape="", header=header, enforceSchema=True)
    return raw.select(*[c.value(F.col(f"`{c.name}`")).alias(c.name) for c in columns])
