"""Tables of a data directory."""

from __future__ import annotations

import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema


#: Footers of so many files are read by the driver, those of more by a Spark job.
MANY = 64


def footer_schema(path: str) -> T.StructType | None:
    """The schema in the Parquet footers of a path the driver can open, which spares a Spark job; None elsewhere.

    A table of several files has the columns of all of them, in order of first appearance; None if a column's types
    differ, which is left to Spark to refuse or merge.
    """
    local = path.removeprefix("file://")
    files = [local] if os.path.isfile(local) else sorted(glob.glob(f"{glob.escape(local)}/*.parquet"))
    if len(files) > MANY:
        return None
    fields: dict[str, T.StructField] = {}
    try:
        for f in files:
            for x in from_arrow_schema(pq.read_schema(f), prefer_timestamp_ntz=True).fields:
                if fields.setdefault(x.name, x).dataType != x.dataType:
                    return None
    except Exception:  # noqa: BLE001 - a type only Spark's own reader knows
        return None
    return T.StructType(list(fields.values())) if fields else None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table NAME.parquet (a file or a folder of files) of a data directory."""
    path = f"{sf_dir}/{name}.parquet"
    schema = footer_schema(path)
    return (spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")).parquet(path)
