import threading

import pytest
from pyspark.sql import functions as F

from tessera.database import Database
from tessera.files import Folder
from tessera.rel import RSN
from tessera.relvar import Effect, FixedRelvar, SessionRelvar, run, together

SCHEMA = "id long, n long, s string"


@pytest.fixture(params=["session", "stored"])
def rv(request, spark, tmp_path):
    if request.param == "session":
        return SessionRelvar(spark, SCHEMA)
    return Database(spark, str(tmp_path / "db")).create("rv", SCHEMA)


def plain(rv):
    return [(r[RSN], r.id, r.n, r.s) for r in rv.rows()]


def test_crud(rv):
    assert rv.insert({"id": 1, "n": 10}) == 0 and rv.insert({"id": 2, "s": "x"}) == 1
    assert rv.insert_all([{"id": 3}, {"id": 4}]) == 2
    assert plain(rv) == [(0, 1, 10, None), (1, 2, None, "x"), (2, 3, None, None), (3, 4, None, None)]
    assert rv.update("id = 1", n="n + 1") == 1
    assert plain(rv)[-1] == (4, 1, 11, None)
    assert rv.delete("id = 3") == 1 and rv.delete("id = 3") == 0
    assert rv.replace("id = 2", {"id": 2, "s": "y"}) == 1 and plain(rv)[-1] == (5, 2, None, "y")
    assert rv.count() == 3
    rv.set([{"id": 9}])
    assert [(r.id, r.n) for r in rv.rows()] == [(9, None)]
    with pytest.raises(ValueError):
        rv.insert({"nope": 1})


def test_rsn_is_never_used_again(rv):
    rv.insert({"id": 1})
    rv.delete("true")
    assert rv.insert({"id": 2}) == 1


def test_put_swap_del_key(rv):
    assert rv.put("id", 1, {"id": 1, "n": 1}) is None
    rv.insert({"id": 1, "n": 2})
    assert rv.put("id", 1, {"id": 1, "n": 3}).n == 2
    assert rv.count() == 1
    assert rv.swap("id", 1, n="n * 2").n == 6 and rv.swap("id", 77, n="0") is None
    assert rv.del_key("id", 1) == 1 and rv.del_key("id", 1) == 0 and rv.count() == 0


def test_auto_id(rv):
    rv.auto_id("id")
    rv.insert({})
    rv.insert({"id": 42})
    rv.insert_all([{}, {"id": 7}])
    assert [r.id for r in rv.rows()] == [0, 42, 2, 7]


def test_indexes(rv):
    rv.insert_all([{"id": i, "n": n} for i, n in enumerate([42, 42, 43, 44, 45, None])])
    assert rv.get("n") is None
    idx = rv.index("n")
    assert rv.get("n") is not None
    assert [r.id for r in idx.getn(42).orderBy(RSN).collect()] == [0, 1] and idx.getn(99).count() == 0 and idx.getn(None).count() == 0
    assert idx.get1(42).id == 0 and idx.get1(99, "none") == "none"
    assert sorted(r.n for r in idx.range(">", 42, "<=", 44).collect()) == [43, 44] == sorted(r.n for r in idx.range("<=", 44, ">", 42).collect())
    assert [r.n for r in idx.asc().collect()] == [42, 42, 43, 44, 45] and [r.n for r in idx.desc().collect()] == [45, 44, 43, 42, 42]
    assert [r.n for r in idx.top_k(2).collect()] == [45, 44] and [r.n for r in idx.bottom_k(1).collect()] == [42]
    assert rv.lookup("n", 43).count() == 1 and rv.lookup1("n", 99, 0) == 0
    with pytest.raises(ValueError):
        idx.range("=", 1)
    with pytest.raises(ValueError):
        rv.index("nope")


def test_long_keys_keep_their_order(rv):
    keys = ["k" * 512 + c for c in "bac"]
    rv.insert_all([{"s": k} for k in keys])
    assert [r.s[-1] for r in rv.index("s").asc().collect()] == ["a", "b", "c"] and rv.index("s").getn(keys[0]).count() == 1


def test_a_scan_keeps_what_it_read(rv):
    rv.insert_all([{"id": 1}, {"id": 2}])
    before = rv.scan()
    rv.delete("id = 1")
    assert before.count() == 2 and rv.count() == 1


def test_update_by_query(rv):
    rv.insert_all([{"id": i, "n": i} for i in range(5)])
    assert rv.run(lambda d: d.where("n >= 3"), "update", n="-n") == 2
    assert rv.run(lambda d: d.where("n < 0")) == 2 and rv.count() == 3


def test_session_changes_are_undone_together(spark):
    a, b = SessionRelvar(spark, "n long"), SessionRelvar(spark, "n long", [{"n": 1}])
    with pytest.raises(KeyError), together():
        a.insert({"n": 5})
        b.delete("true")
        raise KeyError
    assert a.count() == 0 and b.count() == 1


def test_transactions(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    rv = db.create("a", "n long")
    assert db.create("a", "n long").name == "a"
    rv.insert({"n": 1})
    with pytest.raises(RuntimeError, match="stop"), db.write() as tx:
        tx["a"].insert({"n": 2})
        rv.insert({"n": 3})  # inside the block it is part of the block
        assert tx["a"].count() == 3
        raise RuntimeError("stop")
    assert rv.count() == 1
    with db.read() as tx:
        inner = tx["a"]
        assert inner.count() == 1 and tx.get("none") is None
        with pytest.raises(RuntimeError):
            rv.insert({"n": 9})
    with pytest.raises(RuntimeError):
        inner.count()
    with pytest.raises(KeyError):
        db["none"]
    again = Database(spark, str(tmp_path / "db"))
    assert again["a"].count() == 1
    assert [r.name for r in again.variables().collect()] == ["a"] and again.stats().first().variables == 1


def test_compact_vacuum_and_new_columns(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    rv = db.create("a", "n long")
    rv.insert_all([{"n": i} for i in range(6)])
    rv.delete("n < 3")
    rv.add_column("s", "string")
    rv.insert({"n": 9, "s": "new"})
    before = sorted((r[RSN], r.n, r.s) for r in rv.rows())
    db.compact("a")
    assert db.vacuum() > 0
    assert sorted((r[RSN], r.n, r.s) for r in rv.rows()) == before and db.stats().first().folders == 1


def test_concurrent_increments(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    rv = db.create("c", "id long, n long")
    rv.insert({"id": 0, "n": 0})
    errors = []

    def work():
        try:
            with db.write() as tx:
                n = tx["c"].rows()[0].n
                tx["c"].put("id", 0, {"id": 0, "n": n + 1})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and rv.rows()[0].n == 6


def test_changes_write_only_what_they_change(spark):
    rv = SessionRelvar(spark, "id long", spark.range(10_000))
    base = rv._state.adds
    for i in range(20):
        rv.insert({"id": -i})
    assert rv._state.adds[0] is base[0] and len(rv._state.adds) < 20 and rv.count() == 10_020
    rv.delete("id < 0")
    assert rv._state.adds[0] is base[0] and sum(n for _, n in rv._state.dels) == 19 and rv.count() == 10_001
    plan = rv._hit("id = 7")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_run_with_several_effects(spark, tmp_path):
    rv = SessionRelvar(spark, SCHEMA, [{"id": i, "n": i, "s": "x"} for i in range(6)])
    log = Database(spark, str(tmp_path / "db")).create("log", SCHEMA)
    rows = rv.scan().selectExpr(f"{RSN} at", "id", "if(id = 0, _rsn, null) gone", "if(id in (1, 2), _rsn, null) up", "if(id = 3, _rsn, null) new")
    twice = rows.unionByName(rows.where("id = 1").selectExpr("at", "id + 100 id", "gone", "up", "new"))
    done = run(twice, Effect(rv, "delete", "gone"), Effect(rv, "update", "up", {"n": "id * 10"}), Effect(rv, "replace", "new", {"id": "id"}), Effect(log, "insert", exprs={"id": "id"}))
    assert done == [1, 2, 1, 7]
    assert [(r.id, r.n, r.s) for r in rv.rows()] == [(4, 4, "x"), (5, 5, "x"), (1, 10, "x"), (2, 20, "x"), (3, None, None)]
    assert log.count() == 7
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        run(rv.scan().selectExpr(f"{RSN} at", "id"), Effect(rv, "delete", "at"), Effect(log, "insert", exprs={"id": "1 div (id - 4)"}))
    assert rv.count() == 5 and log.count() == 7  # all or none
    with pytest.raises(ValueError):
        run(rv.scan(), Effect(rv, "upsert"))
    with pytest.raises(ValueError):
        run(rv.scan(), Effect(rv, "update", RSN, {"nope": "1"}))


def test_open_variables_keep_other_fields(spark, tmp_path):
    for rv in (SessionRelvar(spark, "id long, _more map<string,string>"), Database(spark, str(tmp_path / "db")).create("a", "id long, _more map<string,string>")):
        rv.insert_all([{"id": 1, "tag": "x", "list": [1, 2], "none": None}, {"id": 2}, {"tag": "y"}])
        rv.insert_all(spark.createDataFrame([(4, 7, None), (5, None, "z")], "id long, size int, tag string"))
        got = [(r.id, r._more) for r in rv.rows()]
        assert got == [(1, {"tag": "x", "list": "[1, 2]"}), (2, None), (None, {"tag": "y"}), (4, {"size": "7"}), (5, {"tag": "z"})]
        assert rv.update("id = 4", id="40") == 1 and rv.rows()[-1]._more == {"size": "7"}


def test_an_index_puts_older_rows_into_ranges(spark, tmp_path):
    rv = Database(spark, str(tmp_path / "db")).create("a", "id long, s string")
    rv.insert_all(spark.range(5000).selectExpr("(id * 7919) % 5000 id", "'x' s").repartition(4))
    rv.delete("id < 10")
    before = {r[RSN]: r.id for r in rv.rows()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = rv.index("id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r[RSN]: r.id for r in rv.rows()} == before
    spans = sorted((r.lo, r.hi) for r in rv.scan().groupBy(F.input_file_name()).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    plan = index.getn(77)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,77)]" in plan and "Join" not in plan


def test_fixed_relations(spark):
    rv = FixedRelvar(spark.range(9).withColumnRenamed("id", "k"))
    assert rv.lookup("k", 3).count() == 1 and rv.get("k") is None and rv.index("k").key == "k" and rv.get("k") is not None
    with pytest.raises(NotImplementedError):
        rv.insert({"k": 1})


def test_two_commits_of_one_version(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    folder.publish("1.json", "a")
    with pytest.raises(FileExistsError):
        folder.publish("1.json", "b")
    assert folder.read("1.json") == "a" and folder.names("") == ["1.json"] and folder.size("") == 1
