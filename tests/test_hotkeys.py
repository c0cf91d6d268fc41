import random

from pyspark.sql import functions as F

from tessera.operators.hotkeys import hot_keys, per_key, running, spread
from tessera.operators.numbering import number_rows
from tessera.operators.skew import heavy_states, join_states


def skewed(spark, n=3000):
    r = random.Random(1)
    rows = [(i, 7 if r.random() < 0.6 else r.choice([None, *range(50)]), r.choice([None, 1, 2, 3])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "rsn long, k long, v long")


def test_per_key_equals_group_by(spark):
    rows, df = skewed(spark)
    got = {r.k: (r.n, r.s, r.lo, r.hi) for r in per_key(df, ["k"], ["rsn"], {"n": ("count", F.lit(1)), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, 6).collect()}
    want = {}
    for _, k, v in rows:
        want.setdefault(k, []).append(v)
    for k, vs in want.items():
        own = [v for v in vs if v is not None]
        assert got[k] == (len(vs), sum(own) if own else None, min(own, default=None), max(own, default=None))
    assert len(got) == len(want)


def test_a_heavy_key_spans_partitions(spark):
    _, df = skewed(spark)
    sizes = [r["count"] for r in spread(df, ["k"], ["rsn"], 6).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 0.35 * 3000


def test_running_sums_cross_partitions(spark):
    rows, df = skewed(spark, 800)
    got = {r.rsn: r.total for r in running(df, ["k"], ["rsn"], "v", "total", 5).collect()}
    sums = {}
    for i, k, v in rows:
        sums[k] = sums.get(k, 0) + (v or 0)
        assert got[i] == sums[k]


def test_running_maxima_cross_partitions(spark):
    rows, df = skewed(spark, 800)
    got = {r.rsn: r.top for r in running(df, ["k"], ["rsn"], "v", "top", 5, kind="max").collect()}
    tops = {}
    for i, k, v in rows:
        tops[k] = max([x for x in (tops.get(k), v) if x is not None], default=None)
        assert got[i] == tops[k]
    assert len(got) == len(rows)


def test_hot_keys_ties_nulls_and_empty(spark):
    a = spark.createDataFrame([(i, k) for i, k in enumerate([1] * 2 + [2] * 1 + [None] * 97)], "rsn long, k long")
    b = a.limit(0)
    got = hot_keys({"a": (a, "k", "rsn"), "b": (b, "k", "rsn")}, 0.02).collect()
    assert [(r.tbl, r.hot_key, r.n) for r in got] == [("a", 1, 2)]


def test_join_states(spark):
    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(k, k) for k in range(2, 100)] + [(None, 0), (500, 1)], "k long, x long")
    states = spark.createDataFrame([(1, 900, "hot")] + [(k, 1, "cold") for k in range(2, 100)], "k long, n long, s string")
    assert [r.k for r in heavy_states(states, "n", 10).collect()] == [1]
    got = join_states(rows, states, ["k"], "n", 10)
    assert got.columns == ["k", "x", "n", "s"] and got.count() == 998
    assert join_states(rows.limit(0), states, ["k"], "n").count() == 0
    assert join_states(rows, states.limit(0), ["k"], "n").count() == 0


def test_number_rows(spark):
    df = spark.range(100).repartition(7)
    got, after = number_rows(df, "n", 5, [F.col("id").desc()])
    assert after == 105 and [(r.id, r.n) for r in got.orderBy("n").collect()] == [(99 - i, 5 + i) for i in range(100)]
    same, after = number_rows(df.limit(0), "n")
    assert after == 0 and same.count() == 0
