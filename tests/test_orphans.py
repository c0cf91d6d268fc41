import datetime as dt
import random
from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st

from tessera.operators.orphans import Parent, Reference, orphan_report, orphans

REFS = [Reference("c", "a", "p"), Reference("c", "b", "q")]
PARENTS = [Parent("p", "k"), Parent("q", "k")]
CHILD, PARENT = "rsn long, a long, b long, loaded_at timestamp, at string", "k long, loaded_at timestamp, deleted_at timestamp, refs int"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def tables(spark, child, p, q):
    make = lambda rows: spark.createDataFrame([(k, day(a), day(b), 0) for k, a, b in rows], PARENT)
    return {"c": spark.createDataFrame([(i, a, b, day(t), "x") for i, (a, b, t) in enumerate(child)], CHILD), "p": make(p), "q": make(q)}


def brute(child, p, q):
    out = set()
    for i, (a, b, t) in enumerate(child):
        for fld, key, parents in (("a", a, p), ("b", b, q)):
            alive = any(k == key and s is not None and t is not None and s <= t and (e is None or e > t) for k, s, e in parents)
            if key is not None and not alive:
                out.add((fld, i))
    return out


def test_against_brute_force_with_a_hot_key(spark):
    r = random.Random(3)
    p = [(r.choice([None, *range(12)]), r.randint(0, 60), r.choice([None, None, r.randint(0, 80)])) for _ in range(40)]
    q = [(r.randint(0, 8), r.randint(0, 60), r.choice([None, r.randint(0, 80)])) for _ in range(20)]
    child = [(7 if r.random() < 0.5 else r.choice([None, *range(15)]), r.choice([None, *range(10)]), r.choice([None, *range(90)])) for _ in range(900)]
    for heavy in (5, 1000):
        t = tables(spark, child, p, q)
        got = [(x.fld, x.rsn) for x in orphans(t, REFS, PARENTS, heavy).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(child, p, q)
        want = Counter((f, None if child[i][2] is None else day(child[i][2]).strftime("%Y-%m")) for f, i in got)
        report = orphan_report(t, REFS, PARENTS, heavy).collect()
        assert {(x.fld, x.month): x.orphans for x in report} == want and len(report) == len(want)


def test_a_parent_key_of_very_many_lifetimes(spark):
    """Lifetimes of a day each with a day between them, and few references; and many of a key nobody asks about."""
    n = 300_000
    start = "timestamp'0500-01-01'"
    life = lambda key: f"select {key} k, {start} + make_dt_interval(cast(2 * id as int)) loaded_at, {start} + make_dt_interval(cast(2 * id + 1 as int)) deleted_at from range({n})"
    p = spark.sql(f"{life(5)} union all {life(6)}")
    c = spark.sql(f"select id rsn, 5L a, {start} + make_dt_interval(cast(id as int), 12) loaded_at from range(0, {2 * n}, 1000) union all select -1, 5, timestamp'0400-01-01' union all select -2, 5, timestamp'9000-01-01'")
    odd = spark.sql(f"select id + 1 rsn, 5L a, {start} + make_dt_interval(cast(id + 1 as int), 12) loaded_at from range(0, {2 * n}, 1000)")
    found = orphans({"c": c.union(odd), "p": p}, REFS[:1], PARENTS[:1])
    got = {r.rsn for r in found.select("rsn").collect()}
    assert got == {-1, -2} | {i + 1 for i in range(0, 2 * n, 1000)}


small = st.one_of(st.none(), st.integers(0, 3))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(small, small, small), max_size=8), st.lists(st.tuples(small, small, small), max_size=6))
def test_property(spark, child, p):
    got = {(x.fld, x.rsn) for x in orphans(tables(spark, child, p, p), REFS, PARENTS).collect()}
    assert got == brute(child, p, p)


def test_empty_tables(spark):
    t = tables(spark, [(1, None, 5)], [], [])
    assert [(x.fld, x.rsn) for x in orphans(t, REFS, PARENTS).collect()] == [("a", 0)]
    assert orphans(tables(spark, [], [(1, 0, None)], []), REFS, PARENTS).count() == 0
