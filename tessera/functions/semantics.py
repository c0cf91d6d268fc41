"""The engine's null, truth and aggregate rules, where they differ from SQL.

Comparisons are SQL's: NULL if a side is NULL. Negation is two-valued: the negation of NULL is true, so ``not_(p)``
keeps rows that ``~p`` would drop, and ``not_in`` holds for NULL. A filter keeps rows whose predicate is true; a value
that isn't boolean passes if it is not NULL. Sums and averages of no values are 0, not NULL. Collections made by
grouping keep NULLs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def col(x: Column | str) -> Column:
    """A Column as it is; a string as a SQL expression."""
    return x if isinstance(x, Column) else F.expr(x)


def value(x: object) -> Column:
    """A Column as it is; anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def truthy(p: Column | str) -> Column:
    """A predicate as a filter sees it: NULL is false."""
    return F.coalesce(col(p), F.lit(False))


def present(x: Column | str) -> Column:
    """Truth of a value that is not boolean: everything but NULL passes, 0 and the empty string too."""
    return col(x).isNotNull()


def not_(p: Column | str) -> Column:
    """Two-valued negation: true for NULL."""
    return ~truthy(p)


def not_equal(a: object, b: object) -> Column:
    """True if the sides differ or one of them is NULL."""
    return not_(value(a) == value(b))


def is_in(x: Column | str, values: Iterable) -> Column:
    """Membership in constants; false for NULL, never NULL."""
    items = list(values)
    return F.coalesce(col(x).isin(items), F.lit(False)) if items else F.lit(False)


def not_in(x: Column | str, values: Iterable) -> Column:
    return ~is_in(x, values)


def holds(container: Column | str, item: object) -> Column:
    """Whether an array column holds an item; false if either is NULL."""
    return F.coalesce(F.array_contains(col(container), value(item)), F.lit(False))


def _chain(op: Callable[[Column, Column], Column], args: tuple[object, ...]) -> Column:
    cols = [value(a) for a in args]
    if len(cols) == 1:
        return F.when(cols[0].isNotNull(), F.lit(True))
    return reduce(lambda a, b: a & b, [op(a, b) for a, b in zip(cols, cols[1:])])


def eq(*args: object) -> Column:
    """a = b = c ...; of one argument, true unless NULL."""
    return _chain(lambda a, b: a == b, args)


def lt(*args: object) -> Column:
    return _chain(lambda a, b: a < b, args)


def le(*args: object) -> Column:
    return _chain(lambda a, b: a <= b, args)


def gt(*args: object) -> Column:
    return _chain(lambda a, b: a > b, args)


def ge(*args: object) -> Column:
    return _chain(lambda a, b: a >= b, args)


def number_compare(op: Callable[[Column, Column], Column], a: object, b: object) -> Column:
    """A comparison of doubles that is false if a side is NaN."""
    x, y = value(a), value(b)
    return op(x, y) & ~F.isnan(x) & ~F.isnan(y)


def holds_key(m: Column | str, key: object) -> Column:
    """Whether a map has a key; false for a NULL map."""
    return F.coalesce(F.map_contains_key(col(m), key), F.lit(False))


def sum0(x: Column | str) -> Column:
    """Sum without NULLs; 0 of no values."""
    return F.coalesce(F.sum(col(x)), F.lit(0))


def avg0(x: Column | str) -> Column:
    """SQL average; 0.0 of no values."""
    return F.coalesce(F.avg(col(x)), F.lit(0.0))


def avg_all(x: Column | str) -> Column:
    """Sum of the values over the number of all rows, rows with NULL too; 0.0 of no rows."""
    return F.coalesce(F.sum(col(x)), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))


def count_rows() -> Column:
    return F.count(F.lit(1))


def collect(x: Column | str, order: Column | str | None = None) -> Column:
    """The group's values as an array that keeps NULLs, in the given order (rows without one come in any order)."""
    if order is None:
        return F.transform(F.collect_list(F.struct(col(x).alias("v"))), lambda s: s.v)
    return F.transform(F.sort_array(F.collect_list(F.struct(col(order).alias("o"), col(x).alias("v")))), lambda s: s.v)


def collect_distinct(x: Column | str) -> Column:
    """The group's distinct values, sorted, NULL dropped."""
    return F.sort_array(F.collect_set(col(x)))


def at(array: Column | str, i: int) -> Column:
    """Element i of an array, from 0; NULL out of bounds."""
    return F.get(col(array), F.lit(i))


def quot(a: object, b: object) -> Column:
    """Integer quotient, truncated towards zero."""
    return F.call_function("div", value(a), value(b))


def rem(a: object, b: object) -> Column:
    """Remainder with the sign of the dividend."""
    return value(a) % value(b)


def inc(x: Column | str) -> Column:
    return col(x) + 1


def dec(x: Column | str) -> Column:
    return col(x) - 1


def subs(s: Column | str, start: int, end: int | None = None) -> Column:
    """Substring from start, 0-based, to before end; cut at the end of the text."""
    return F.substring(col(s), start + 1, 2**31 - 1 if end is None else end - start)


def includes(s: Column | str, part: str) -> Column:
    return col(s).contains(part)


def starts_with(s: Column | str, part: str) -> Column:
    return col(s).startswith(part)


def ends_with(s: Column | str, part: str) -> Column:
    return col(s).endswith(part)


def text(*xs: Column | str) -> Column:
    """The texts of values, one after the other; NULL gives nothing."""
    return F.concat(*[F.coalesce(col(x).cast("string"), F.lit("")) for x in xs])


def join_texts(sep: str, array: Column | str) -> Column:
    """An array's values as one text; NULL elements are empty texts, as in ``text``."""
    return F.array_join(F.transform(col(array), lambda x: x.cast("string")), sep, "")


def trimr(s: Column | str) -> Column:
    """Without white space at the end."""
    return F.regexp_replace(col(s), r"\s+$", "")


def even(x: Column | str) -> Column:
    return col(x) % 2 == 0


def re_find(pattern: str, s: Column | str) -> Column:
    """The first match of a Java pattern in s, NULL if there is none; as a predicate use ``re_matches``."""
    return F.when(col(s).rlike(pattern), F.regexp_extract(col(s), f"({pattern})", 1))


def re_matches(pattern: str, s: Column | str) -> Column:
    return col(s).rlike(pattern)


def same_instant(a: Column | str, b: Column | str) -> Column:
    """Equality of timestamps at millisecond precision."""
    return F.date_trunc("millisecond", col(a)) == F.date_trunc("millisecond", col(b))


def map_key(m: Column | str) -> Column:
    """A map as a value that can be compared, grouped and sorted: its entries in key order."""
    return F.sort_array(F.map_entries(col(m)))


def null_safe(f: Callable[..., Column]) -> Callable[..., Column]:
    """A function of columns that gives NULL if an argument is NULL, whatever f does with it."""

    def wrapped(*args: object) -> Column:
        cols = [value(a) for a in args]
        ok = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]) if cols else F.lit(True)
        return F.when(ok, f(*cols))

    return wrapped


def scalar_udf(f: Callable, returns: T.DataType | str, pinned: bool = False) -> Callable[..., Column]:
    """A vectorised Python function (of pandas Series) as a null-safe function of columns.

    Spark may still evaluate it on rows with NULL arguments, so f must not fail on them; their results are dropped. A
    pinned function stays where the query has it: no filter or join is moved before or behind it, and it is called once
    per row that comes by.
    """
    udf = F.pandas_udf(f, returns)
    return null_safe(udf.asNondeterministic() if pinned else udf)


def aggregate_udf(f: Callable, returns: T.DataType | str) -> Callable[..., Column]:
    """A Python function of one pandas Series per argument, one result per group."""
    return F.pandas_udf(f, returns)
