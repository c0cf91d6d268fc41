"""Per-key results when a few keys hold most records.

Rows are range partitioned on the composite (key, secondary order): Spark samples quantiles of the composite and cuts
a heavy key into several partitions, so no task gets more than its share however the rows are spread over keys. Each
partition reduces its keys to partial states, and the states of keys that cross a partition boundary are stitched: one
small row per (partition, key), never a key's rows. Only states are shuffled a second time.

The secondary order should be (close to) unique within a key; a key whose rows all tie in it cannot be cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut

#: Aggregates whose partial states merge: name -> (partial, merge).
MERGEABLE = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}
PART = "_tessera_part"


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """df range partitioned by (keys, order) with sampled quantiles; heavy keys span several partitions.

    NULL keys and orders sort first and are kept. An empty table stays empty.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    return df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)


def per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggregates: dict[str, tuple[str, str | Column]],
    partitions: int | None = None,
) -> DataFrame:
    """One row per key with the given aggregates, free of key skew.

    aggregates: result name -> (count | sum | min | max, column). NULL keys form one group, as in GROUP BY; NULL
    values are skipped by the aggregates; repeated rows all count; an empty table gives no rows. Columns that are not
    named are dropped before the shuffle, so clashing names among them don't matter.
    """
    values = {f"_v{i}": (F.col(c) if isinstance(c, str) else c) for i, (_, c) in enumerate(aggregates.values())}
    slim = df.select(*keys, *[c for c in order if c not in keys], *[c.alias(n) for n, c in values.items()])
    parts = spread(slim, keys, [c for c in order if c not in keys], partitions)
    kinds = list(zip(values, aggregates.items(), strict=True))
    # the range partition's partial states; (part, key) is unique in a partition, so this exchange carries states only
    partial = parts.groupBy(*keys, F.spark_partition_id().alias(PART)).agg(*[MERGEABLE[kind][0](v).alias(v) for v, (_, (kind, _)) in kinds])
    # stitch the states of keys that cross a boundary
    merged = partial.groupBy(*keys).agg(*[MERGEABLE[kind][1](v).alias(out) for v, (out, (kind, _)) in kinds])
    return merged


#: Running aggregates: what a row adds, and how two pieces are put together.
RUNNING = {"sum": (lambda v: F.coalesce(v, F.lit(0)), F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "max": (lambda v: v, F.max, F.greatest), "min": (lambda v: v, F.min, F.least)}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, partitions: int | None = None, kind: str = "sum") -> DataFrame:
    """Every row with the running sum, max or min of value within its key, up to and with the row, in the given order.

    The order must be total within a key (add a unique column). NULL values count as 0 in a sum and are skipped by max
    and min. A heavy key is cut over range partitions: each aggregates its own piece, then adds the state of the key's
    earlier pieces. Only a key that crosses a partition boundary has such a state, so there are at most two per
    partition and they are broadcast. All columns are kept.
    """
    each, piece, join = RUNNING[kind]
    # the partition number must be the same for the rows and for the states: write the placed rows once
    placed = cut(spread(df, keys, order, partitions).withColumn(PART, F.spark_partition_id()))
    local = Window.partitionBy(*keys, PART).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", piece(each(F.col(value))).over(local))
    states = placed.groupBy(*keys, PART).agg(piece(each(F.col(value))).alias("_piece"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # a key's first piece has nothing before it
    states = states.select(*keys, PART, piece("_piece").over(before).alias("_before"), F.row_number().over(Window.partitionBy(*keys).orderBy(PART)).alias("_n")).where("_n > 1")
    rows, s = own.alias("r"), F.broadcast(states).alias("s")
    same = F.col(f"r.{PART}") == F.col(f"s.{PART}")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    return rows.join(s, same, "left").select("r.*", "s._before").withColumn(out, join(F.col("_own"), F.col("_before"))).drop("_own", "_before", PART)


def hot_keys(tables: dict[str, tuple[DataFrame, str, str]], share: float, partitions: int | None = None) -> DataFrame:
    """(tbl, hot_key, n, share): the non-NULL keys that hold at least share of all rows of their table.

    tables: name -> (table, key column, secondary order column). Every stored row counts, rows with a NULL key too.
    Ties at the share are kept; an empty table has no hot keys.
    """
    long = None
    for name, (df, key, order) in tables.items():
        part = df.select(F.lit(name).alias("tbl"), df[key].cast("long").alias("hot_key"), df[order].alias("at"))
        long = part if long is None else long.unionByName(part)
    counts = cut(per_key(long, ["tbl", "hot_key"], ["at"], {"n": ("count", F.lit(1))}, partitions))
    # as many rows as tables are named in the call: safe to broadcast
    totals = counts.groupBy("tbl").agg(F.sum("n").alias("total"))
    return (
        counts.join(F.broadcast(totals), "tbl")
        .where(F.col("hot_key").isNotNull() & (F.col("n") >= F.lit(share) * F.col("total")))
        .select("tbl", "hot_key", "n", (F.col("n") / F.col("total")).alias("share"))
    )
