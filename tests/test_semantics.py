import itertools

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import semantics as S


def one(spark, **exprs):
    return spark.range(1).select(*[e.alias(n) for n, e in exprs.items()]).first()


def lit(x, kind="long"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(("f", "py"), [(S.eq, lambda a, b: a == b), (S.lt, lambda a, b: a < b), (S.le, lambda a, b: a <= b), (S.gt, lambda a, b: a > b), (S.ge, lambda a, b: a >= b)])
def test_comparisons(spark, f, py):
    cases = list(itertools.product([None, 1, 2], repeat=2))
    row = one(spark, **{f"c{i}": f(lit(a), lit(b)) for i, (a, b) in enumerate(cases)})
    assert list(row) == [None if a is None or b is None else py(a, b) for a, b in cases]


def test_chains_and_single_arguments(spark):
    r = one(spark, up=S.lt(lit(1), lit(2), lit(3)), no=S.lt(lit(1), lit(3), lit(2)), null=S.lt(lit(1), lit(2), lit(None)), one=S.lt(lit(1)), none=S.lt(lit(None)))
    assert tuple(r) == (True, False, None, True, None)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.integers(-3, 3))), min_size=1, max_size=20))
def test_negation_is_two_valued(spark, rows):
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select(S.not_equal(F.col("a"), F.col("b")).alias("x"), S.not_(F.col("a") < F.col("b")).alias("y"), S.not_in("a", [1, 2]).alias("z"), S.is_in("a", [1, 2]).alias("w")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        null = a is None or b is None
        assert r.x is (null or a != b) and r.y is (null or not a < b) and r.z is (a not in (1, 2)) and r.w is (a in (1, 2))


def test_nan(spark):
    nan = F.lit(float("nan"))
    r = one(spark, native=nan == nan, ours=S.number_compare(lambda a, b: a == b, nan, nan), gt=S.number_compare(lambda a, b: a > b, nan, F.lit(1.0)), ok=S.number_compare(lambda a, b: a < b, F.lit(1.0), F.lit(2.0)))
    assert tuple(r) == (True, False, False, True)


def test_aggregates_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, None)], "k long, v long")
    aggs = [S.sum0("v").alias("s"), S.avg0("v").alias("a"), S.avg_all("v").alias("aa"), F.min("v").alias("m"), S.count_rows().alias("n"), F.count("v").alias("c"), F.count_distinct("v").alias("d"), S.collect("v", "v").alias("l")]
    assert tuple(df.where("k > 9").agg(*aggs).first()) == (0, 0.0, 0.0, None, 0, 0, 0, [])
    got = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(*aggs).collect()}
    assert got == {1: (2, 2.0, 1.0, 2, 2, 1, 1, [None, 2]), 2: (0, 0.0, 0.0, None, 1, 0, 0, [None])}


def test_functions(spark):
    r = one(
        spark, q=S.quot(lit(-7), lit(3)), r=S.rem(lit(-7), lit(3)), sub=S.subs(F.lit("abcdef"), 1, 3), tail=S.subs(F.lit("abc"), 1), past=S.subs(F.lit("abc"), 2, 9), inc=S.inc(lit(1)), f=S.re_find("b+", F.lit("abbc")),
        miss=S.re_find("x", F.lit("abc")), at=S.at(F.array(F.lit(5)), 1), null=S.includes(F.lit(None).cast("string"), "a"), ms=S.same_instant(F.lit("2024-01-01 00:00:00.0001").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")),
    )
    assert tuple(r) == (-2, -1, "bc", "bc", "c", 2, "bb", None, None, None, True)


def test_maps_as_keys(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert df.groupBy(S.map_key("m")).count().count() == 1


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(F.lit(2**63 - 1) + F.col("id") + 1).collect()


def test_null_safe_functions(spark):
    def double(x: pd.Series) -> pd.Series:
        return x.fillna(0) * 2

    f = S.scalar_udf(double, "double")
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(f(F.col("x"))).collect()] == [2.0, None]
    g = S.null_safe(lambda a, b: F.concat_ws("-", a, b))
    assert tuple(one(spark, a=g(F.lit("x"), F.lit("y")), b=g(F.lit("x"), F.lit(None).cast("string")))) == ("x-y", None)
