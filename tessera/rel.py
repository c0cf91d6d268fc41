"""Rel: a comprehension-style query over named bindings.

A Rel is a DataFrame whose columns are qualified by the names they were bound under, so a query reads like a
comprehension: bind sources, filter, derive, join, group, order, project. Each step is one DataFrame operation and
Catalyst plans the whole; a Rel is immutable and lazy, and is evaluated again by each action.

    Rel.of(orders, "o").join("c", customers, "o.o_custkey = c.c_custkey").when("c.c_nationkey = 7")
       .group({"year": "year(o.o_orderdate)"}, revenue=sum0("o.o_totalprice")).order("revenue desc")

Expressions are Columns or SQL strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql import types as T

from tessera.functions.semantics import col, truthy

RSN = "_rsn"
Expr = Column | str


def relation(source: Any, spark: SparkSession | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Anything that is a relation, as a DataFrame.

    A DataFrame, Rel or relation variable; None is empty; a collection of rows (dicts, tuples with a schema, or plain
    values, which become the column ``value``) gets a ``_rsn`` column with its position.
    """
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, Rel):
        return source.df
    if hasattr(source, "scan"):
        return source.scan()
    spark = spark or SparkSession.active()
    if source is None:
        return spark.createDataFrame([], schema or "value long")
    rows = list(source)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if schema is None and rows and not isinstance(rows[0], (dict, tuple, Row)):
        schema = T.StructType([T.StructField("value", T._infer_type(next((x for x in rows if x is not None), 0)))])
    if schema is not None:
        if len(schema.fields) == 1 and not (rows and isinstance(rows[0], (dict, tuple, Row))):
            rows = [(x,) for x in rows]
        names = schema.fieldNames()
        rows = [tuple(x.get(n) for n in names) if isinstance(x, dict) else tuple(x) for x in rows]
        full = T.StructType([*schema.fields, T.StructField(RSN, T.LongType())])
        return spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], full)
    names = list(dict.fromkeys(k for x in rows for k in x)) if rows else ["value"]
    if not rows:
        return spark.createDataFrame([], f"value long, {RSN} long")
    return spark.createDataFrame([{**{n: x.get(n) for n in names}, RSN: i} for i, x in enumerate(rows)])


def direction(e: Expr | tuple[Expr, str]) -> Column:
    """A sort key: "e", "e asc", "e desc", or (e, "desc"). NULL is lowest; any other direction is ascending."""
    if isinstance(e, str):
        head, _, tail = e.rpartition(" ")
        e = (head, tail) if tail.lower() in ("asc", "desc") and head else (e, "asc")
    if not isinstance(e, tuple):
        return e
    c = col(e[0])
    return c.desc_nulls_last() if str(e[1]).lower() == "desc" else c.asc_nulls_first()


class Rel:
    """An immutable query; see the module's text."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def of(source: Any, name: str | None = None, spark: SparkSession | None = None, schema: T.StructType | str | None = None) -> Rel:
        """Start a query: bind the rows of a source to a name."""
        df = relation(source, spark, schema)
        return Rel(df.alias(name) if name else df)

    # bindings and joins

    def bind(self, name: str, source: Any) -> Rel:
        """One more binding, as a nested loop would: the product with a relation, or, for an array Column or SQL
        string over earlier bindings, one row per element, bound to name (elements that are structs: name.field)."""
        if isinstance(source, (Column, str)):
            return Rel(self.df.select("*", F.explode(col(source)).alias(name)))
        return Rel(self.df.crossJoin(relation(source).alias(name)))

    def bind_outer(self, name: str, array: Expr) -> Rel:
        """As bind over an array, but rows with an empty or NULL array stay, with NULL."""
        return Rel(self.df.select("*", F.explode_outer(col(array)).alias(name)))

    def _join(self, name: str, source: Any, on: Expr | None, how: str) -> Rel:
        other = relation(source).alias(name)
        return Rel(self.df.join(other, F.lit(True) if on is None else col(on), how))

    def join(self, name: str, source: Any, on: Expr | None = None) -> Rel:
        """Inner join; without a condition the product. NULL keys match nothing."""
        return self._join(name, source, on, "inner") if on is not None else self.bind(name, relation(source))

    def left_join(self, name: str, source: Any, on: Expr | None = None) -> Rel:
        """Left outer join: every row once at least."""
        return self._join(name, source, on, "left")

    def semi_join(self, name: str, source: Any, on: Expr | None = None) -> Rel:
        """Rows that have a match, once each (EXISTS)."""
        return self._join(name, source, on, "leftsemi")

    def anti_join(self, name: str, source: Any, on: Expr | None = None) -> Rel:
        """Rows without a match (NOT EXISTS); rows with NULL keys stay."""
        return self._join(name, source, on, "leftanti")

    def mark(self, out: str, name: str, source: Any, keys: dict[str, str]) -> Rel:
        """A boolean column: does a row of source exist with equal keys? keys: expression here -> column there.

        For EXISTS under OR or in a projection; false for NULL keys, rows are kept and not multiplied.
        """
        names = [f"_k{i}" for i in range(len(keys))]
        found = relation(source).select(*[F.col(c).alias(n) for n, c in zip(names, keys.values(), strict=True)]).distinct().withColumn("_found", F.lit(True)).alias(name)
        on = [col(e) == F.col(f"{name}.{n}") for n, e in zip(names, keys, strict=True)]
        joined = self.df.join(found, on, "left")
        return Rel(joined.withColumn(out, F.coalesce(F.col(f"{name}._found"), F.lit(False))).drop(*names, "_found"))

    def lateral(self, name: str, sub: DataFrame, how: str = "inner") -> Rel:
        """Dependent join with a query that refers to this one's columns by ``.outer()``; how: inner or left."""
        return Rel(self.df.lateralJoin(sub.alias(name), how=how))

    def first_match(self, name: str, source: Any, keys: dict[str, str], order: Sequence[Expr]) -> Rel:
        """Left join to the first row, in order, of those with equal keys: a correlated scalar subquery that takes the
        first row and never fails on many. keys: expression here -> column there."""
        other = relation(source)
        w = Window.partitionBy(*keys.values()).orderBy(*map(direction, order))
        top = other.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").alias(name)
        return Rel(self.df.join(top, [col(e) == F.col(f"{name}.{c}") for e, c in keys.items()], "left"))

    def single(self, name: str, source: Any, on: Expr, order: Sequence[Expr]) -> Rel:
        """Left join to the first row, in order, of those for which any condition over both holds: a correlated scalar
        subquery without equal keys. Every row once; the source's columns are NULL without a match."""
        here, other = self.df.withColumn("_at", F.monotonically_increasing_id()), relation(source)
        found = here.join(other.alias(name), col(on), "left")
        w = Window.partitionBy("_at").orderBy(*[direction(f"{name}.{o}" if isinstance(o, str) else o) for o in order])
        return Rel(found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at"))

    # rows and columns

    def take(self, binding: str, *keys: str, whole: str | None = None, **names: str) -> Rel:
        """Columns of a binding under plain names, in its place: keys under their own, names under new ones; whole names
        a struct of all its columns."""
        out = [F.col(f"{binding}.{k}").alias(k) for k in keys] + [F.col(f"{binding}.{c}").alias(n) for n, c in names.items()]
        if whole:
            out.append(F.struct(f"{binding}.*").alias(whole))
        own = [F.col(f"{binding}.`{c}`") for c in self.df.select(f"{binding}.*").columns]
        return Rel(self.df.select("*", *out).drop(*own))

    def places(self, array: Expr, *names: str) -> Rel:
        """The first elements of an array under names, in order; NULL beyond its end."""
        return Rel(self.df.select("*", *[F.get(col(array), F.lit(i)).alias(n) for i, n in enumerate(names)]))

    def when(self, *predicates: Expr) -> Rel:
        """Rows for which every predicate is true; anywhere, after a group it is HAVING."""
        df = self.df
        for p in predicates:
            df = df.where(col(p))
        return Rel(df)

    def when_not(self, p: Expr) -> Rel:
        """Rows for which p is false or NULL."""
        return Rel(self.df.where(~truthy(p)))

    def let(self, **exprs: Expr) -> Rel:
        """Derived columns, in order; later ones may use or shadow earlier ones."""
        df = self.df
        for name, e in exprs.items():
            df = df.withColumn(name, col(e))
        return Rel(df)

    def select(self, *columns: Expr, **exprs: Expr) -> Rel:
        """Projection. Aggregates without a group make one row of all rows, also of none."""
        return Rel(self.df.select(*[col(c) for c in columns], *[col(e).alias(n) for n, e in exprs.items()]))

    def without(self, *names: str) -> Rel:
        return Rel(self.df.drop(*names))

    # groups

    def group(self, keys: dict[str, Expr] | None = None, **aggregates: Expr) -> Rel:
        """Group by named expressions; columns are the keys and the aggregates. NULL keys form a group.

        Without keys there is exactly one group, also of no rows; with keys an empty relation has no groups. May be
        repeated, and aggregates may be used in a following group, order, when or let.
        """
        aggs = [col(e).alias(n) for n, e in aggregates.items()] or [F.count(F.lit(1)).alias("count")]
        if not keys:
            return Rel(self.df.agg(*aggs))
        # keys are made before the group, where Spark allows subqueries in them
        made = self.df.select("*", *[col(e).alias(f"_key_{n}") for n, e in keys.items()])
        return Rel(made.groupBy(*[F.col(f"_key_{n}").alias(n) for n in keys]).agg(*aggs))

    def fold(self, order: Expr, x: Expr, init: Column, step: Callable[[Column, Column], Column], out: str = "value", merge: Callable[[Column, Column], Column] | None = None) -> Rel:
        """A fold over all rows in order, as one row.

        Without merge the values are collected into one array, so this is for folds over data that fits a task. With
        merge, which puts the states of two adjacent runs of rows together and for which init is neutral, each range
        partition folds its own rows and only the states, one per partition, are brought together.
        """
        pair = F.struct(col(order).alias("o"), col(x).alias("v"))
        folded = lambda values: F.reduce(F.transform(F.sort_array(values), lambda s: s.v), init, step)
        if merge is None:
            return Rel(self.df.agg(F.collect_list(pair).alias("_v")).select(folded(F.col("_v")).alias(out)))
        rows = self.df.select(pair.alias("p")).repartitionByRange("p.o")
        states = rows.groupBy(F.spark_partition_id().alias("o")).agg(F.collect_list("p").alias("_v")).select(F.struct("o", folded(F.col("_v")).alias("v")).alias("p"))
        return Rel(states.agg(F.collect_list("p").alias("_v")).select(F.reduce(F.transform(F.sort_array("_v"), lambda s: s.v), init, merge).alias(out)))

    # order, limits, duplicates

    def order(self, *keys: Expr | tuple[Expr, str]) -> Rel:
        """Sort; NULL is lowest. Not stable: end with a unique key where ties matter. A subquery as a key goes into a
        pair with its direction."""
        made = {f"_order_{i}": k for i, k in enumerate(keys) if isinstance(k, tuple) and isinstance(k[0], Column)}
        if not made:
            return Rel(self.df.orderBy(*map(direction, keys)))
        df = self.df.select("*", *[k[0].alias(n) for n, k in made.items()])
        by = [direction((F.col(f"_order_{i}"), k[1])) if f"_order_{i}" in made else direction(k) for i, k in enumerate(keys)]
        return Rel(df.orderBy(*by).drop(*made))

    def limit(self, n: int) -> Rel:
        """The first n rows at this point of the query; steps may follow."""
        return Rel(self.df.limit(n))

    def distinct(self, keys: Sequence[Expr] | None = None, order: Sequence[Expr] = (RSN,)) -> Rel:
        """Without keys, distinct rows. With keys, the first row per key in the given order (DISTINCT ON)."""
        if keys is None:
            return Rel(self.df.distinct())
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*map(direction, order))
        return Rel(self.df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))

    @staticmethod
    def union(*sources: Any) -> Rel:
        """All rows of all relations, duplicates kept; a column that one lacks is NULL there."""
        frames = [relation(s) for s in sources]
        if not frames:
            return Rel(relation(None))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return Rel(out)

    # results

    def q(self) -> list[Row]:
        """The rows, on the driver."""
        return self.df.collect()

    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def first(self, default: Any = None) -> Any:
        """The first row, or default."""
        rows = self.df.head(1)
        return rows[0] if rows else default

    def scalar(self, default: Any = None) -> Any:
        """The first value of the first row, or default; never fails on many rows."""
        row = self.first()
        return default if row is None else row[0]

    def exists(self) -> bool:
        return bool(self.df.take(1))

    def count(self) -> int:
        return self.df.count()

    def show(self, n: int = 20) -> None:
        """Print the first n rows."""
        self.df.show(n, truncate=False)

    def text(self, n: int = 20) -> str:
        """The first n rows as a table of text."""
        return self.df._jdf.showString(n, 0, False)

    def explain(self, mode: str = "formatted") -> str:
        """The plan as text; mode: simple, extended, codegen, cost or formatted."""
        return self.df.sparkSession._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), mode)

    def save(self, path: str, mode: str = "overwrite") -> None:
        self.df.write.mode(mode).parquet(path)

    def __repr__(self) -> str:
        return f"Rel[{', '.join(f'{n} {t}' for n, t in self.df.dtypes)}]"

