import pytest
from pyspark.sql import functions as F

from tessera.recursive import closure, fixpoint, recursive, sql_recursion, with_
from tessera.rel import Rel

EDGES = [("bob", "jim"), ("jim", "phil"), ("bob", "karen"), ("karen", "lois"), ("lois", "eve")]


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def step_from(edges):
    return lambda d: Rel.of(d, "x").join("y", edges, "x.b = y.a").select("x.a", "y.b").df


def test_count_up(spark):
    base = spark.createDataFrame([(42,)], "n int")
    assert pairs(fixpoint(base, lambda d: d.where("n < 44").select((F.col("n") + 1).alias("n")))) == [(42,), (43,), (44,)]


def test_accumulated_names(spark):
    a, b = spark.createDataFrame([(42,)], "n int"), spark.createDataFrame([(43,)], "n int")
    assert pairs(with_([("a", a), ("a", b)], lambda e: e["a"])) == [(42,), (43,)]


def test_nonlinear_recursion_has_delta_semantics(spark):
    e = spark.createDataFrame(EDGES, "a string, b string")
    step = recursive(lambda env: Rel.of(env["anc"], "x").join("y", env["anc"], "x.b = y.a").select("x.a", "y.b").df)
    got = pairs(with_([("anc", e), ("anc", step)], lambda env: env["anc"]))
    assert got == sorted([*EDGES, ("bob", "phil"), ("bob", "lois"), ("karen", "eve")])


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string")
    assert len(pairs(closure(e, step_from(e)))) == 9
    with pytest.raises(RuntimeError):
        fixpoint(e, step_from(e), max_rounds=5)


def test_duplicates_are_kept(spark):
    base = spark.createDataFrame([(1,), (1,)], "n int")
    assert pairs(fixpoint(base, lambda d: d.where("n < 2").select((F.col("n") + 1).alias("n")))) == [(1,), (1,), (2,), (2,)]


def test_two_recursive_members_of_one_name(spark):
    base = spark.createDataFrame([(1,)], "n int")
    up = recursive(lambda e: e["a"].where("n < 3").select((F.col("n") + 1).alias("n")))
    times = recursive(lambda e: e["a"].where("n < 3").select((F.col("n") * 10).alias("n")))
    assert pairs(with_([("a", base), ("a", up), ("a", times)], lambda e: e["a"])) == [(1,), (2,), (3,), (10,), (20,)]


def test_sql_recursion_self_join_and_depth(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 5)], "a int, b int")
    e.createOrReplaceTempView("chain")
    got = sql_recursion(spark, "p", "a, b", "SELECT a, b FROM chain", "SELECT x.a, y.b FROM p x JOIN p y ON x.b = y.a", "SELECT b - a d, count(*) n FROM p GROUP BY 1")
    assert pairs(got) == [(1, 4), (2, 3), (4, 1)]
    assert sql_recursion(spark, "r", "n", "SELECT 1", "SELECT n + 1 FROM r WHERE n < 130", "SELECT max(n) FROM r", 200).first()[0] == 130


def test_recursive_member_needs_rows(spark):
    with pytest.raises(ValueError):
        with_([("a", recursive(lambda e: e["a"]))], lambda e: e["a"])


def test_empty_base(spark):
    base = spark.createDataFrame([], "n int")
    assert pairs(fixpoint(base, lambda d: d)) == []


def test_many_rounds_keep_few_pieces(spark):
    base = spark.createDataFrame([(0,)], "n int")
    got = fixpoint(base, lambda d: d.where("n < 40").select((F.col("n") + 1).alias("n")))
    assert pairs(got) == [(i,) for i in range(41)]
    assert got._jdf.queryExecution().analyzed().toString().count("LogicalRDD") <= 20
