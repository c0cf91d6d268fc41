"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir.

    A folder of our own is made only where the setting is absent and the master is local, which is the case in tests;
    on a cluster an absent setting is an error, as a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
        # Spark makes a folder of its own in there, which no later session reads
        remove_at_end(spark, sc.getCheckpointDir())
    return named


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver ends."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared folder, as a path of its file system; it is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = path if re.match(r"^[a-z0-9]+:", path) else f"file://{path}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm_path)
    remove_at_end(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Pieces of about one size that a growing relation has at most.
FAN = 16
Pieces = tuple[tuple[DataFrame, int], ...]


def add_piece(pieces: Pieces, df: DataFrame, n: int) -> Pieces:
    """pieces and one more of n rows, which is written already; FAN pieces of about one size are written together as
    one, so a row is written again as often as the relation grows FAN times larger."""
    pieces = (*pieces, (df, n))
    while True:
        tiers: dict[int, list[tuple[DataFrame, int]]] = {}
        for p in pieces:
            tiers.setdefault(int(math.log(max(p[1], 1), FAN)), []).append(p)
        full = next((t for t in tiers.values() if len(t) >= FAN), None)
        if full is None:
            return pieces
        pieces = (*[p for p in pieces if all(p is not q for q in full)], (cut(union_all(full)), sum(n for _, n in full)))


def union_all(pieces: Iterable[tuple[DataFrame, int]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d for d, _ in pieces])
