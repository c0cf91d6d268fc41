"""References to records that do not exist, are withdrawn, or arrive later.

Step 1 works on states, not rows: parents and children are put in one long form tagged by parent table and key, and
grouped by (parent table, key). A group keeps a bounded state: the parent flag, from when on a parent is alive for good,
and the number and earliest time of its references. Groups that lack the parent flag hold orphans only; groups in which
every reference falls into the safe time hold none; the others lack a parent at some time.

Step 2 returns to the rows of the groups that hold orphans. Keys with more than 1 / ``heavy`` of all rows, of references
or of parents, are fewer than ``heavy`` in number, so their states are broadcast and their rows are not shuffled by key;
all other rows meet the state of their key in a join in which no key is heavy.

Step 3 is for groups whose parents were alive for a while: their references and the lifetimes of their parents, of no
other keys, are put in time order. A reference is alive if the latest end of the lifetimes that began by then is still
to come, a running maximum over range partitions of (key, time), which cut a key with very many references or lifetimes.

The report sums the counts per period that the groups without parent flag hold, and needs rows for step 3 only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.hotkeys import running
from tessera.operators.skew import heavy_states
from tessera.session import cut

#: Earlier than any time; stands for an unknown one.
NEVER = "0001-01-01"


@dataclass(frozen=True)
class Reference:
    """A field of a table that refers to the key of a parent table."""

    table: str
    field: str
    parent: str
    row_id: str = "rsn"
    at: str = "loaded_at"


@dataclass(frozen=True)
class Parent:
    """A table with a key and the lifetime of each row, [since, until); until may be NULL."""

    table: str
    key: str
    since: str = "loaded_at"
    until: str | None = "deleted_at"


def _children(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """(tbl, fld, parent, key, rsn, at): references that are not NULL; one scan per table."""
    out = None
    for name in dict.fromkeys(r.table for r in refs):
        own, df = [r for r in refs if r.table == name], tables[name]
        each = F.array(*[F.struct(F.lit(r.field).alias("fld"), F.lit(r.parent).alias("parent"), df[r.field].cast("long").alias("key")) for r in own])
        part = df.select(F.lit(name).alias("tbl"), df[own[0].row_id].cast("long").alias("rsn"), df[own[0].at].alias("at"), F.explode(each).alias("e"))
        part = part.select("tbl", "e.fld", "e.parent", "e.key", "rsn", "at").where(F.col("key").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def _parents(tables: dict[str, DataFrame], parents: list[Parent]) -> DataFrame:
    """(parent, key, since, until) of all parent rows with a key."""
    out = None
    for p in parents:
        df = tables[p.table]
        until: Column = df[p.until].cast("timestamp") if p.until else F.lit(None).cast("timestamp")
        part = df.select(F.lit(p.table).alias("parent"), df[p.key].cast("long").alias("key"), df[p.since].cast("timestamp").alias("since"), until.alias("until"))
        part = part.where(F.col("key").isNotNull() & F.col("since").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def _period(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def _states(child: DataFrame, parent: DataFrame, periods: bool) -> DataFrame:
    """One row per (parent, key) with references: rows, has_parent, safe, has_ended, lacking and, on demand, periods,
    the counts per (tbl, fld, period) of a group without parent."""
    none, at = F.lit(None).cast("timestamp"), F.coalesce(F.col("at").cast("timestamp"), F.to_timestamp(F.lit(NEVER)))
    by = ["tbl", "fld", "period"] if periods else []
    names = [F.lit(None).cast("string").alias(c) for c in by]
    if periods:
        child = child.withColumn("period", _period(F.col("at")))
    long = child.select("parent", "key", *by, F.lit(1).alias("refs"), F.lit(0).alias("is_parent"), at.alias("at"), none.alias("since"), F.lit(0).alias("ends")).unionByName(
        parent.select("parent", "key", *names, F.lit(0).alias("refs"), F.lit(1).alias("is_parent"), none.alias("at"), F.when(F.col("until").isNull(), F.col("since")).alias("since"), F.col("until").isNotNull().cast("int").alias("ends"))
    )
    parts = long.groupBy("parent", "key", *by).agg(
        F.sum("refs").alias("refs"), F.sum("is_parent").alias("parents"), F.min("at").alias("first_ref"), F.min("since").alias("safe"), F.max("ends").alias("has_ended")
    )
    if periods:  # one small row per key and period
        own = F.when(F.col("refs") > 0, F.struct(*by, F.col("refs").alias("n")))
        parts = parts.groupBy("parent", "key").agg(
            F.sum("refs").alias("refs"), F.sum("parents").alias("parents"), F.min("first_ref").alias("first_ref"), F.min("safe").alias("safe"), F.max("has_ended").alias("has_ended"),
            F.collect_list(own).alias("periods"),
        )
    lacking = F.col("safe").isNull() | (F.col("safe") > F.col("first_ref"))
    out = parts.where("refs > 0").select("parent", "key", (F.col("refs") + F.col("parents")).alias("rows"), (F.col("parents") > 0).alias("has_parent"), "safe", (F.col("has_ended") > 0).alias("has_ended"), lacking.alias("lacking"), *["periods"] * periods)
    return out.withColumn("periods", F.when(~F.col("has_parent"), F.col("periods"))) if periods else out


def _meet(rows: DataFrame, states: DataFrame, hot: DataFrame, wanted: Column) -> DataFrame:
    """rows with safe and has_ended of the groups for which wanted holds; other rows are dropped."""
    tried = rows.join(F.broadcast(hot), ["parent", "key"], "left")
    heavy = tried.where(F.col("hot.wanted")).select(*rows.columns, "hot.has_parent", "hot.safe", "hot.has_ended")
    cold = states.where(wanted).select("parent", "key", "has_parent", "safe", "has_ended")
    light = tried.where(F.col("hot").isNull()).drop("hot").join(cold, ["parent", "key"])
    return heavy.unionByName(light.select(*rows.columns, "has_parent", "safe", "has_ended"))


def _hot(states: DataFrame, wanted: Column, heavy: int) -> DataFrame:
    return heavy_states(states, "rows", heavy).select("parent", "key", F.struct("has_parent", "safe", "has_ended", wanted.alias("wanted")).alias("hot"))


def _found(child: DataFrame, parent: DataFrame, states: DataFrame, wanted: Column, heavy: int) -> DataFrame:
    """(tbl, fld, rsn, at) of the orphans in the groups for which wanted holds."""
    open_rows = _meet(child, states, _hot(states, wanted, heavy), wanted).where(F.col("at").isNull() | F.col("safe").isNull() | (F.col("at") < F.col("safe")))
    # written once, as two branches follow
    open_rows = cut(open_rows)
    lost = F.col("at").isNull() | ~F.col("has_parent") | ~F.col("has_ended")
    ended = parent.where(F.col("until") > F.col("since")).groupBy("parent", "key", "since").agg(F.max("until").alias("until"))
    asks = wanted & F.col("has_ended")
    ended = _meet(ended, states, _hot(states, asks, heavy), asks).select("parent", "key", F.col("since").alias("t"), "until")
    asked = open_rows.where(~lost).withColumn("t", F.col("at").cast("timestamp")).drop("has_parent", "safe", "has_ended")
    # at one time lifetimes come first, as they begin by then
    line = ended.unionByName(asked, allowMissingColumns=True)
    seen = running(line, ["parent", "key"], ["t", "tbl", "fld", "rsn"], "until", "latest", kind="max")
    dead = seen.where(F.col("tbl").isNotNull() & (F.col("latest").isNull() | (F.col("latest") <= F.col("t"))))
    return open_rows.where(lost).select("tbl", "fld", "rsn", "at").unionByName(dead.select("tbl", "fld", "rsn", "at"))


def orphans(tables: dict[str, DataFrame], refs: list[Reference], parents: list[Parent], heavy: int = 1000) -> DataFrame:
    """(tbl, fld, rsn, at): the rows whose reference has no parent row alive at the row's own time.

    A parent row is alive at t if since <= t and until is NULL or > t. NULL references are not orphans; a reference
    whose own time is NULL is an orphan, as nothing is alive at an unknown time. Parent rows without key or since are
    ignored. Repeated rows are all reported; empty tables give no rows (no parents: all references are orphans).
    """
    child, parent = _children(tables, refs), _parents(tables, parents)
    return _found(child, parent, cut(_states(child, parent, False)), F.col("lacking"), heavy)


def orphan_report(tables: dict[str, DataFrame], refs: list[Reference], parents: list[Parent], heavy: int = 1000) -> DataFrame:
    """(tbl, fld, month, orphans): numbers per table, field and month of the referring rows' time (NULL: unknown)."""
    child, parent = _children(tables, refs), _parents(tables, parents)
    groups = cut(_states(child, parent, True))
    whole = groups.where(~F.col("has_parent")).select(F.inline("periods"))
    some = _found(child, parent, groups.drop("periods"), F.col("lacking") & F.col("has_parent"), heavy)
    some = some.groupBy("tbl", "fld", _period(F.col("at")).alias("period")).agg(F.count("*").alias("n"))
    return whole.unionByName(some).groupBy("tbl", "fld", F.col("period").alias("month")).agg(F.sum("n").alias("orphans"))
