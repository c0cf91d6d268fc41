"""Relations from Python iterators, read in parallel through Spark's data source interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def scannable(spark: SparkSession, name: str, schema: str | T.StructType, partitions: list[Any], scan: Callable[[Any], Iterator[tuple]]) -> DataFrame:
    """A relation whose partitions are made by scan(partition) on the executors, each time it is read.

    partitions describes the work (ranges, paths); scan must be picklable and give the same rows when a task is
    repeated. The relation is registered as a data source under name.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(p) for p in partitions] or [InputPartition(None)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return iter(()) if not partitions else iter(scan(partition.value))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str | T.StructType:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
