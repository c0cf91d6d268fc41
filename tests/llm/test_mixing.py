import pytest

from tessera.llm.mixing import draw, rates, shares, source_key

SIZES = "doc_id long, source string, n_tokens long"


def sizes(spark, per_source):
    rows, i = [], 0
    for s, n, tokens in per_source:
        for _ in range(n):
            rows.append((i, s, tokens))
            i += 1
    return spark.createDataFrame(rows, SIZES)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_come_close_and_caps_hold(spark):
    docs = sizes(spark, [("a", 4000, 10), ("b", 600, 20), ("c", 50, 10), (None, 30, 10), ("other", 30, 10)])
    want = targets(spark, [("a", 0.5, 1), (" B ", 0.4, 3), ("c", 0.1, 2), ("empty", 0.0, 4)])
    rate = rates(docs, want, 40_000)
    out = draw(docs, rate)
    per_doc = out.groupBy("doc_id", "source").count().collect()
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(r["count"] <= caps[r.source] for r in per_doc)
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    report = {r.source: r for r in shares(out, rate).collect()}
    assert set(report) == {"a", "b", "c", "empty"}
    assert report["a"].drawn_tokens == pytest.approx(20_000, rel=0.05) and report["b"].drawn_tokens == pytest.approx(16_000, rel=0.05)
    assert report["c"].drawn_tokens == 1000 and report["c"].short and not report["a"].short
    assert report["empty"].records == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_every_document_is_used_floor_or_ceiling_times(spark):
    docs = sizes(spark, [("a", 300, 10)])
    out = draw(docs, rates(docs, targets(spark, [("a", 1.0, 9)]), 7500)).groupBy("doc_id").count().collect()
    assert len(out) == 300 and {r["count"] for r in out} == {2, 3}


def test_the_draw_is_repeatable_and_seeded(spark):
    docs = sizes(spark, [("a", 500, 10)])
    rate = rates(docs, targets(spark, [("a", 1.0, 1)]), 2500)
    first = {r.doc_id for r in draw(docs, rate, seed=1).collect()}
    assert first == {r.doc_id for r in draw(docs.repartition(7), rate, seed=1).collect()} != {r.doc_id for r in draw(docs, rate, seed=2).collect()}
    assert 200 < len(first) < 300


def test_empty_tables_nulls_and_zero_sizes(spark):
    docs = sizes(spark, [("a", 3, 0)])
    want = targets(spark, [("a", None, 2), ("a", 0.5, None), ("z", -1.0, 1)])
    rate = rates(docs, want, 100)
    assert draw(docs, rate).count() == 0 and all(r.actual_share == 0 for r in shares(draw(docs, rate), rate).collect())
    assert draw(docs.limit(0), rates(docs.limit(0), targets(spark, [("a", 1.0, 1)]), 100)).count() == 0
    assert rates(docs, want.limit(0), 100).count() == 0


def test_source_names(spark):
    df = spark.createDataFrame([(" CodeHarbor ",), ("codeharbor",), ("\tcodeharbor",), (None,)], "s string")
    assert [r[0] for r in df.select(source_key(df.s)).collect()] == ["codeharbor"] * 3 + [None]
