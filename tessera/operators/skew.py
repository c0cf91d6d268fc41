"""Joins of rows with per-key states where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def heavy_states(states: DataFrame, weight: str, heavy: int = 1000) -> DataFrame:
    """The states whose weight is over 1 / heavy of all weight: fewer than heavy rows, whatever the data."""
    total = states.agg((F.sum(weight) / heavy).alias("_most"))
    return states.join(F.broadcast(total), F.col(weight) > F.col("_most")).drop("_most")


def join_states(rows: DataFrame, states: DataFrame, keys: Sequence[str], weight: str, heavy: int = 1000) -> DataFrame:
    """rows inner joined with states, which have one row per key and the key's number of rows as weight.

    Heavy keys, fewer than ``heavy`` by count, meet their rows in a broadcast; the rest is shuffled without hot keys.
    NULL keys match nothing.
    """
    values = [c for c in states.columns if c not in keys]
    hot = heavy_states(states, weight, heavy).select(*keys, F.struct(*values).alias("_state"))
    tried = rows.join(F.broadcast(hot), list(keys), "left")
    on_heavy = tried.where(F.col("_state").isNotNull()).select(*rows.columns, "_state.*")
    rest = tried.where(F.col("_state").isNull()).select(*rows.columns)
    on_light = rest.join(states, list(keys)).select(*rows.columns, *values)
    return on_heavy.unionByName(on_light)
