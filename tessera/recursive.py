"""Common table expressions and recursion.

A recursive member sees, in its first round, all rows its name has so far, and after that only the rows of the round
before; duplicates are kept and rounds go on until one adds nothing. Linear recursion in the shapes Spark SQL accepts
is best written with ``sql_recursion``; ``fixpoint`` runs the rest (aggregates or sorting in the member, several
members of one name, depths beyond Spark's limits) as one job a round, each round's rows written to the shared
checkpoint folder so that the plan doesn't grow and lost executors cost nothing but time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import add_piece, cut, union_all

Env = dict[str, DataFrame]
Member = DataFrame | Callable[[Env], DataFrame]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """base and all rows that step adds: step(base), step of that result, and so on until nothing is added.

    Duplicates are kept, so a step over a cycle must stop itself; more than max_rounds rounds are an error.
    """
    delta = cut(base)
    parts = add_piece((), delta, delta.count())
    for _ in range(max_rounds):
        delta = cut(step(delta).select(*base.columns))
        n = delta.count()
        if not n:
            return union_all(parts)
        parts = add_piece(parts, delta, n)
    raise RuntimeError(f"recursion went on for more than {max_rounds} rounds")


def closure(base: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """The distinct rows reachable from base: as fixpoint, but rows known already are dropped, so cycles end.

    A round writes its new rows only and reads those known before.
    """
    delta = cut(base.distinct())
    parts = add_piece((), delta, delta.count())
    for _ in range(max_rounds):
        n, k = step(delta).select(*base.columns).distinct().alias("n"), union_all(parts).alias("k")
        same = [F.col(f"n.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in base.columns]
        delta = cut(n.join(k, same, "left_anti"))
        size = delta.count()
        if not size:
            return union_all(parts)
        parts = add_piece(parts, delta, size)
    raise RuntimeError(f"recursion went on for more than {max_rounds} rounds")


class recursive:  # noqa: N801
    """Marks a member that refers to its own name."""

    def __init__(self, f: Callable[[Env], DataFrame]):
        self.f = f


def with_(bindings: list[tuple[str, Member | recursive]], body: Callable[[Env], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """body over named relations. Members of one name are appended, names in order of first appearance.

    A member is a DataFrame, a function of the relations bound so far, or ``recursive(f)``.
    """
    env: Env = {}
    for name in dict.fromkeys(n for n, _ in bindings):
        parts: list[DataFrame] = []
        for m in (m for n, m in bindings if n == name):
            if isinstance(m, recursive):
                if not parts:
                    raise ValueError(f"the recursive member of {name} comes before any rows")
                so_far = _union(parts)
                grown = fixpoint(so_far, lambda d, m=m: m.f({**env, name: d}), max_rounds)
                parts = [grown]
            else:
                parts.append(m if isinstance(m, DataFrame) else m(env))
        env[name] = _union(parts)
    return body(env)


def sql_recursion(spark: SparkSession, name: str, columns: str, base_sql: str, step_sql: str, body_sql: str, max_level: int = 100) -> DataFrame:
    """WITH RECURSIVE name(columns) AS (base UNION ALL step) body, to the given depth.

    Spark stops a recursion at a million rows unless told otherwise; this lifts that bound for the session.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    return spark.sql(f"WITH RECURSIVE {name}({columns}) MAX RECURSION LEVEL {max_level} AS ({base_sql} UNION ALL {step_sql}) {body_sql}")
