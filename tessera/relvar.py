"""Relation variables: mutable relations with row identities.

Every row has a row sequence number, ``_rsn``, that ascends by insertion and is never used again. A replaced row is
deleted and inserted anew, so it gets a new number and moves to the end. The verbs are written once, over three
primitives a variable provides: append numbered rows, remove numbers, replace everything. Each verb is one batch: the
numbers it targets are computed by a query, then applied together. A change writes the rows it adds and the numbers it
removes, never the variable. ``run`` applies several verbs on several variables from one query's result.

A variable whose schema has the column ``_more map<string,string>`` is open: fields that the schema doesn't name are
kept there as text.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field as of, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T

from tessera.functions.semantics import col, value
from tessera.index import Index
from tessera.operators.numbering import number_rows
from tessera.rel import RSN, Rel
from tessera.session import Pieces, add_piece, cut, union_all


#: The column of an open variable that holds the fields its schema doesn't name.
MORE = "_more"


class Relvar:
    """The verbs of a relation variable; see SessionRelvar and database.StoredRelvar."""

    name: str
    spark: SparkSession

    # primitives

    def scan(self) -> DataFrame:
        """All rows with their _rsn. Order by _rsn where order is observed."""
        raise NotImplementedError

    @property
    def schema(self) -> T.StructType:
        raise NotImplementedError

    def _next(self) -> int:
        raise NotImplementedError

    def _append(self, rows: DataFrame, next_rsn: int) -> None:
        raise NotImplementedError

    def _remove(self, rsns: DataFrame, n: int) -> None:
        """Remove n rows by their numbers, all of which are there."""
        raise NotImplementedError

    def _clear(self) -> None:
        raise NotImplementedError

    def _meta(self) -> dict[str, Any]:
        """auto_id: column or None; indexes: list of columns. Changed through _set_meta."""
        raise NotImplementedError

    def _set_meta(self, **changes: Any) -> None:
        raise NotImplementedError

    @contextmanager
    def _change(self) -> Iterator[None]:
        """All primitives inside are one atomic change."""
        yield

    # reading

    def rel(self, name: str | None = None) -> Rel:
        return Rel.of(self.scan(), name)

    def rows(self) -> list[Row]:
        """All rows in insertion order, on the driver."""
        return self.scan().orderBy(RSN).collect()

    def count(self) -> int:
        return self.scan().count()

    # writing

    def _frame(self, rows: Any) -> DataFrame:
        """Rows (a DataFrame, or dicts) under the variable's schema; missing fields are NULL, and fields the schema
        doesn't name are an error unless the variable is open."""
        if isinstance(rows, Rel):
            rows = rows.df
        fields = self.schema.fields
        names = [f.name for f in fields]
        is_open = MORE in names
        if isinstance(rows, DataFrame):
            have = set(rows.columns)
            unknown = sorted(have - set(names) - {RSN})
            if unknown and not is_open:
                raise ValueError(f"{self.name} has no column {unknown}")
            out = {f.name: (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType) for f in fields}
            if unknown:
                extra = F.map_filter(F.create_map(*[x for c in unknown for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda _, v: v.isNotNull())
                out[MORE] = F.when(out[MORE].isNull(), extra).otherwise(F.map_concat(out[MORE], extra))
            return rows.select(*[out[n].alias(n) for n in names])
        full = []
        for r in rows:
            extra = {k: v for k, v in r.items() if k not in names}
            if extra and not is_open:
                raise ValueError(f"{self.name} has no column {sorted(extra)}")
            if extra:
                text = {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in extra.items() if v is not None}
                r = {**r, MORE: {**(r.get(MORE) or {}), **text}}
            full.append(tuple(r.get(n) for n in names))
        return self.spark.createDataFrame(full, self.schema)

    def _numbered(self, rows: DataFrame, order: list[Column] | None = None) -> None:
        out, after = number_rows(rows, RSN, self._next(), order or [])
        key = self._meta()["auto_id"]
        if key:
            out = out.withColumn(key, F.coalesce(F.col(key), F.col(RSN).cast(self.schema[key].dataType)))
        self._append(out.select(*self.schema.fieldNames(), RSN), after)

    def set(self, relation: Any) -> None:
        """Replace the contents by a relation's rows, numbered anew in their order (by their own _rsn if they have one)."""
        with self._change():
            df = relation.df if isinstance(relation, Rel) else relation
            rows, order = self._frame(df), None
            if isinstance(df, DataFrame) and RSN in df.columns:
                rows, order = df.select(*rows.columns, F.col(RSN).alias("_old")), [F.col("_old")]
            rows = cut(rows)  # the relation may read this variable
            self._clear()
            self._numbered(rows, order)

    def insert(self, row: dict[str, Any]) -> int:
        """Insert one row; its number."""
        with self._change():
            rsn = self._next()
            row = dict(row)
            key = self._meta()["auto_id"]
            if key and row.get(key) is None:
                row[key] = rsn
            self._append(self._frame([row]).withColumn(RSN, F.lit(rsn).cast("long")), rsn + 1)
            return rsn

    def insert_all(self, rows: Any) -> int:
        """Insert the rows of a relation in one batch; how many."""
        with self._change():
            before = self._next()
            self._numbered(self._frame(rows))
            return self._next() - before

    def _hit(self, where: Column | str | DataFrame) -> DataFrame:
        """The rows a predicate is true for, by a filter, or that a relation with an _rsn column names, by a semi join."""
        if isinstance(where, Rel):
            where = where.df
        if isinstance(where, DataFrame):
            return self.scan().join(where.select(RSN), RSN, "left_semi")
        return self.scan().where(col(where))

    def delete(self, where: Column | str | DataFrame) -> int:
        """Delete rows by predicate or by the _rsn of a relation; how many. Numbers without a row are ignored."""
        with self._change():
            gone = cut(self._hit(where).select(RSN))
            n = gone.count()
            if n:
                self._remove(gone, n)
            return n

    def _put_back(self, hit: DataFrame, exprs: dict[str, Column | str]) -> int:
        """Replace the rows of hit, which are written already, by themselves with new column values."""
        n = hit.count()
        if n:
            self._remove(hit.select(RSN), n)
            changed = hit.select(*[(col(exprs[c]).cast(self.schema[c].dataType) if c in exprs else F.col(c)).alias(c) for c in self.schema.fieldNames()], F.col(RSN).alias("_old"))
            self._numbered(changed, [F.col("_old")])
        return n

    def update(self, where: Column | str | DataFrame, **exprs: Column | str) -> int:
        """Replace the targeted rows by themselves with new column values; how many. They move to the end in order."""
        with self._change():
            return self._put_back(cut(self._hit(where)), exprs)

    def replace(self, where: Column | str | DataFrame, row: dict[str, Any]) -> int:
        """Replace every targeted row by row; how many."""
        unknown = set(row) - set(self.schema.fieldNames())
        if unknown:
            raise ValueError(f"{self.name} has no column {sorted(unknown)}")
        return self.update(where, **{f.name: F.lit(row.get(f.name)).cast(f.dataType) for f in self.schema.fields})

    def put(self, key: str, at: Any, row: dict[str, Any]) -> Row | None:
        """Replace all rows whose key equals at by row, or insert it; the last old row, or None."""
        with self._change():
            same = F.col(key) == value(at)
            old = self.scan().where(same).orderBy(F.col(RSN).desc()).head(1)
            self.delete(same)
            self.insert(row)
            return old[0] if old else None

    def swap(self, key: str, at: Any, **exprs: Column | str) -> Row | None:
        """Update the rows whose key equals at; the last new row, or None if there is none."""
        with self._change():
            if not self.update(F.col(key) == value(at), **exprs):
                return None
            return self.scan().orderBy(F.col(RSN).desc()).head(1)[0]

    def del_key(self, key: str, at: Any) -> int:
        """Delete the rows whose key equals at; how many."""
        return self.delete(F.col(key) == value(at))

    def run(self, query: Callable[[DataFrame], DataFrame], verb: str = "delete", **exprs: Column | str) -> int:
        """Apply delete or update to the rows a query over this variable returns (with _rsn), as one batch."""
        found = query(self.scan())
        return self.delete(found) if verb == "delete" else self.update(found, **exprs)

    # keys and indexes

    def auto_id(self, key: str) -> None:
        """From now on, fill key with the row's number where it is NULL."""
        self._set_meta(auto_id=key)

    def index(self, key: str) -> Index:
        """Create the index on a column if it is missing; the index."""
        if key not in self.schema.fieldNames():
            raise ValueError(f"{self.name} has no column {key}")
        if key not in self._meta()["indexes"]:
            self._set_meta(indexes=[*self._meta()["indexes"], key])
        return Index(self, key)

    def get(self, key: str) -> Index | None:
        """The index on a column, or None."""
        return Index(self, key) if key in self._meta()["indexes"] else None

    def lookup(self, key: str, at: Any) -> DataFrame:
        """Rows whose key equals at, with or without an index; none for NULL."""
        return Index(self, key).getn(at)

    def lookup1(self, key: str, at: Any, default: Any = None) -> Any:
        return Index(self, key).get1(at, default)

    def __repr__(self) -> str:
        return f"{type(self).__name__}[{self.name}: {self.schema.simpleString()}]"


@dataclass(frozen=True)
class Effect:
    """A verb on a variable for each row of a query's result. at names the result's column with the target's _rsn (not
    for insert); exprs are columns' new values over the result's columns. update keeps other columns, replace and insert
    make them NULL."""

    var: Relvar
    verb: str
    at: str | None = None
    exprs: dict[str, Column | str] = of(default_factory=dict)


def run(query: DataFrame | Rel, *effects: Effect) -> list[int]:
    """Apply effects on one or several variables to the rows of a query, all or none; how many rows each changed.

    The query is evaluated once, before any effect, so effects don't see each other's changes; they apply in the order
    given. A row that several result rows target is changed once, by the least of their new values, and one that an
    earlier effect removed is left alone.
    """
    for e in effects:
        if e.verb not in ("insert", "update", "replace", "delete"):
            raise ValueError(f"no verb {e.verb}")
        unknown = set(e.exprs) - set(e.var.schema.fieldNames())
        if unknown:
            raise ValueError(f"{e.var.name} has no column {sorted(unknown)}")
    rows = cut(query.df if isinstance(query, Rel) else query)
    done = []
    with ExitStack() as stack:
        for v in dict.fromkeys(e.var for e in effects):
            stack.enter_context(v._change())
        for e in effects:
            schema = e.var.schema
            if e.verb == "insert":
                done.append(e.var.insert_all(rows.select(*[col(x).alias(c) for c, x in e.exprs.items()])))
                continue
            if e.verb == "delete":
                done.append(e.var.delete(rows.select(F.col(e.at).alias(RSN))))
                continue
            exprs = e.exprs if e.verb == "update" else {f.name: e.exprs.get(f.name, F.lit(None)) for f in schema.fields}
            new = rows.select(F.col(e.at).alias(RSN), F.struct(*[col(x).cast(schema[c].dataType).alias(c) for c, x in exprs.items()]).alias("_new"))
            has_map = any(isinstance(schema[c].dataType, T.MapType) for c in exprs)  # maps have no order
            new = new.groupBy(RSN).agg((F.min_by("_new", F.to_json("_new")) if has_map else F.min("_new")).alias("_new"))
            hit = cut(e.var.scan().join(new, RSN))
            done.append(e.var._put_back(hit, {c: F.col(f"_new.`{c}`") for c in exprs}))
    return done


_undo = threading.local()


@contextmanager
def together() -> Iterator[None]:
    """Changes to session variables inside are kept together or, if the block fails, undone together."""
    outer = getattr(_undo, "log", None)
    _undo.log = log = []
    try:
        yield
    except BaseException:
        for var, state in reversed(log):
            var._state = state
        raise
    else:
        if outer is not None:
            outer.extend(log)
    finally:
        _undo.log = outer


@dataclass(frozen=True)
class _State:
    """Pieces of rows and of removed numbers, each with its number of rows."""

    adds: Pieces = ()
    dels: Pieces = ()
    next: int = 0
    meta: dict[str, Any] = of(default_factory=lambda: {"auto_id": None, "indexes": []})


class SessionRelvar(Relvar):
    """A variable that lives as long as its session. Its states are immutable and their pieces are written to the shared
    folder, so a reader keeps what it started with and a change can be undone by returning to the state before."""

    def __init__(self, spark: SparkSession, schema: T.StructType | str, rows: Any = (), name: str = "relvar"):
        self.spark, self.name = spark, name
        self._schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self._lock = threading.RLock()
        self._state = _State()
        if isinstance(rows, DataFrame) or rows:
            self.insert_all(rows)

    @property
    def schema(self) -> T.StructType:
        return self._schema

    def scan(self) -> DataFrame:
        state = self._state
        if not state.adds:
            return self.spark.createDataFrame([], T.StructType([*self._schema.fields, T.StructField(RSN, T.LongType())]))
        rows, gone = (union_all(p) if p else None for p in (state.adds, state.dels))
        return rows if gone is None else rows.join(gone, RSN, "left_anti").select(*rows.columns)

    def _next(self) -> int:
        return self._state.next

    def _meta(self) -> dict[str, Any]:
        return self._state.meta

    def _to(self, **changes: Any) -> None:
        log = getattr(_undo, "log", None)
        if log is not None:
            log.append((self, self._state))
        self._state = replace(self._state, **changes)

    def _append(self, rows: DataFrame, next_rsn: int) -> None:
        n = next_rsn - self._state.next
        self._to(adds=add_piece(self._state.adds, cut(rows), n) if n else self._state.adds, next=next_rsn)

    def _remove(self, rsns: DataFrame, n: int) -> None:
        self._to(dels=add_piece(self._state.dels, rsns, n))

    def _clear(self) -> None:
        # numbers go on, so that numbers of rows that are gone are never used again
        self._to(adds=(), dels=())

    def _set_meta(self, **changes: Any) -> None:
        self._to(meta={**self._state.meta, **changes})

    @contextmanager
    def _change(self) -> Iterator[None]:
        with self._lock, together():
            yield


class FixedRelvar(Relvar):
    """A relation that is only read, under the names a variable's lookups and indexes have; nothing is copied."""

    def __init__(self, df: DataFrame, name: str = "relation"):
        self.spark, self.name, self._df, self._indexes = df.sparkSession, name, df, []

    def scan(self) -> DataFrame:
        return self._df

    @property
    def schema(self) -> T.StructType:
        return self._df.schema

    def _meta(self) -> dict[str, Any]:
        return {"auto_id": None, "indexes": self._indexes}

    def _set_meta(self, **changes: Any) -> None:
        self._indexes = changes.get("indexes", self._indexes)
