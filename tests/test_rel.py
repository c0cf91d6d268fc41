import pytest
from pyspark.sql import functions as F

from tessera.functions import semantics as S
from tessera.rel import RSN, Rel, direction, relation


def rows(rel):
    return [tuple(r) for r in rel.q()]


def test_sources(spark):
    assert Rel.of(None).count() == 0
    assert rows(Rel.of([1, None, 2])) == [(1, 0), (None, 1), (2, 2)]
    assert relation([{"a": 1}, {"b": "x"}]).orderBy(RSN).select("a", "b").collect() == [(1, None), (None, "x")]
    assert relation([], schema="a long").count() == 0
    assert relation([(1, "x")], schema="a long, b string").columns == ["a", "b", RSN]


def test_readme_query(spark):
    customers = [{"id": 1, "country": "GB"}, {"id": 2, "country": "FR"}]
    orders = [{"customer": 1, "gross": 50.0, "discount": 8.0}, {"customer": 2, "gross": 9.0, "discount": 0.0}]
    q = Rel.of(customers, "c").when("c.country = 'GB'").join("o", orders, "o.customer = c.id").group({"country": "c.country"}, revenue=S.sum0("o.gross - o.discount"))
    assert rows(q) == [("GB", 42.0)]


def test_joins_and_null_keys(spark):
    a, b = [{"k": 1}, {"k": None}, {"k": 3}], [{"k": 1, "v": 10}, {"k": 1, "v": 20}, {"k": None, "v": 30}]
    left = Rel.of(a, "a").left_join("b", b, "a.k = b.k").select("a.k", "b.v")
    assert sorted(rows(left), key=str) == [(1, 10), (1, 20), (3, None), (None, None)]
    assert rows(Rel.of(a, "a").semi_join("b", b, "a.k = b.k").select("k")) == [(1,)]
    assert sorted(rows(Rel.of(a, "a").anti_join("b", b, "a.k = b.k").select("k")), key=str) == [(3,), (None,)]
    marked = Rel.of(a, "a").mark("there", "b", b, {"a.k": "k"}).select("a.k", "there")
    assert sorted(rows(marked), key=str) == [(1, True), (3, False), (None, False)]
    assert Rel.of(a, "a").join("b", b).count() == 9


def test_plans(spark):
    spark.range(10).createOrReplaceTempView("t10")
    a, b = spark.range(1000).withColumnRenamed("id", "k"), spark.range(1000).withColumnRenamed("id", "k")
    assert "LeftSemi" in Rel.of(a, "a").semi_join("b", b, "a.k = b.k").explain()
    assert "LeftAnti" in Rel.of(a, "a").anti_join("b", b, "a.k = b.k").explain()
    assert "TakeOrderedAndProject" in Rel.of(a, "a").order("k desc").limit(3).explain()
    assert "BroadcastNestedLoopJoin" in Rel.of(a, "a").join("b", b, "a.k < b.k").explain("simple")


def test_correlated_sources_and_first_match(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k long, xs array<long>")
    assert rows(Rel.of(df, "d").bind("x", "d.xs").select("k", "x")) == [(1, 1), (1, 2)]
    assert rows(Rel.of(df, "d").bind_outer("x", "d.xs").select("k", "x")) == [(1, 1), (1, 2), (2, None), (3, None)]
    many = [{"k": 1, "v": 7}, {"k": 1, "v": 5}]
    got = Rel.of(df, "d").first_match("m", many, {"d.k": "k"}, ["v"]).select("d.k", "m.v")
    assert sorted(rows(got)) == [(1, 5), (2, None), (3, None)]


def test_let_shadows_in_order(spark):
    assert rows(Rel.of([{"a": 1}]).let(a="a + 1", b="a * 10", c="b + a").select("a", "b", "c")) == [(2, 20, 22)]


def test_groups(spark):
    ints = [1, 2, 3, None]
    even = Rel.of([1, 2, 3]).group({"even": "value % 2 = 0"}, xs=S.collect("value", RSN)).order("even")
    assert rows(even) == [(False, [1, 3]), (True, [2])]
    assert rows(Rel.of(ints).select(n="count(value)", d="count(distinct value)")) == [(3, 3)]
    assert rows(Rel.of([], schema="value long").select(n=S.count_rows() + 1)) == [(1,)]
    assert rows(Rel.of([], schema="value long").group({"k": "value"})) == []
    assert rows(Rel.of(ints).group({"k": "value > 1"}).order("k")) == [(None, 1), (False, 1), (True, 2)]
    twice = Rel.of([1, 1, 2, 3]).group({"v": "value"}, n="count(*)").group({"n": "n"}, m="count(*)").when("m > 1")
    assert rows(twice) == [(1, 2)]


def test_order_limit_distinct_union(spark):
    r = Rel.of([3, None, 1, 2], "x")
    assert [x[0] for x in rows(r.order("value"))] == [None, 1, 2, 3]
    assert [x[0] for x in rows(r.order("value desc"))] == [3, 2, 1, None]
    assert [x[0] for x in rows(r.order(("value", "sideways")))] == [None, 1, 2, 3]
    assert [x[0] for x in rows(r.order("value desc").limit(2).when("value < 3"))] == [2]
    maps = [{"k": 2, "n": 2}, {"k": 1, "n": 1}, {"k": 4, "n": 9}]
    assert [x[0] for x in rows(Rel.of(maps).distinct(["k % 2 = 0"]).order(RSN).select("n"))] == [2, 1]
    assert sorted(x[0] for x in rows(Rel.union(Rel.of([1, 2]).select("value"), Rel.of([1]).select("value")))) == [1, 1, 2]
    assert Rel.union().count() == 0
    assert rows(Rel.union(Rel.of([{"a": 1}]).select("a"), Rel.of([{"b": 2}]).select("b")).order("a")) == [(None, 2), (1, None)]


def test_results(spark):
    r = Rel.of([5, 6])
    assert r.first()[0] == 5 and r.when("value > 9").first("none") == "none" and r.scalar() == 5 and r.when("value > 9").scalar(0) == 0
    assert r.exists() and not r.when("value > 9").exists() and [x[0] for x in r] == [5, 6]
    assert repr(r) == "Rel[value bigint, _rsn bigint]"
    assert Rel.of([1, 2, 3]).fold(RSN, "value", F.lit(0).cast("long"), lambda a, x: a * 10 + x).scalar() == 123


def test_when_not_keeps_null(spark):
    assert [x[0] for x in rows(Rel.of([1, None, 2]).when_not("value = 1"))] == [None, 2]


@pytest.mark.parametrize("key", ["a", "a asc", ("a", "desc")])
def test_directions(spark, key):
    assert direction(key) is not None


def test_bindings_by_keys_names_places_and_whole(spark):
    df = spark.createDataFrame([(1, "x", [7, 8]), (2, None, [])], "a int, b string, c array<int>")
    got = Rel.of(df, "t").places("t.c", "p", "q", "r").take("t", "a", other="b", whole="all").df
    assert got.columns == ["p", "q", "r", "a", "other", "all"]
    assert [(r.p, r.q, r.r, r.a, r.other, r.all.a) for r in got.orderBy("a").collect()] == [(7, 8, None, 1, "x", 1), (None, None, None, 2, None, 2)]


def test_single_takes_the_first_match_of_any_condition(spark):
    a, b = spark.createDataFrame([(1,), (5,), (9,), (9,)], "x int"), spark.createDataFrame([(2,), (6,), (6,), (None,)], "y int")
    got = Rel.of(a, "a").single("b", b, "b.y > a.x", ["y"]).select("a.x", "b.y").q()
    assert sorted((r.x, r.y) for r in got if r.y) == [(1, 2), (5, 6)] and sum(r.y is None for r in got) == 2 and len(got) == 4


def test_fold_with_merge_equals_fold(spark):
    df = spark.range(1000).selectExpr("id", "cast(id * 17 % 101 as long) v").repartition(5)
    last = lambda s, x: F.when(x.isNull(), s).otherwise(x)
    none = F.lit(None).cast("long")
    one = Rel.of(df).fold("id", "if(id % 3 = 0, v, null)", none, last).scalar()
    assert Rel.of(df).fold("id", "if(id % 3 = 0, v, null)", none, last, merge=last).scalar() == one == 999 * 17 % 101
    assert Rel.of(df.limit(0)).fold("id", "v", F.lit(5).cast("long"), lambda s, x: s + x, merge=lambda a, b: a + b).scalar() == 5


def test_text_of_rows(spark):
    assert Rel.of([1, 2], spark=spark).text(1).count("\n") > 3
