from tessera.operators.packed import PackedSource, count_consistency, infer_separators, split_lists, split_packed

NAMES = [f"word{c}" for c in "abcdefgh"]


def table(spark, values, extra=""):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "rsn long, f string")


def items(spark, values):
    out = split_packed({"t": table(spark, values)}, [PackedSource("t", "f")])
    assert [f.simpleString() for f in out.schema] == ["tbl:string", "fld:string", "rsn:bigint", "pos:int", "item:string"]
    return sorted((r.rsn, r.pos, r.item) for r in out.collect())


BASE = ["actor", "editor", "writer", "co-producer", "art_department", "script supervisor", "actor,editor", "writer,actor", "editor;actor", "actor;writer", "actor|editor"]


def test_separators_are_inferred_and_word_marks_are_not(spark):
    long = table(spark, BASE).selectExpr("'t' tbl", "'f' fld", "f raw")
    assert infer_separators(long) == {("t", "f"): [",", ";", "|"]}


def test_positions_blanks_and_nulls(spark):
    got = items(spark, [*BASE, None, "", "  ", "\\N", ",actor,, \\N,actor", "co-producer,script supervisor"])
    n = len(BASE)
    assert [(p, x) for r, p, x in got if r == n + 4] == [(2, "actor"), (5, "actor")]
    assert [(p, x) for r, p, x in got if r == n + 5] == [(1, "co-producer"), (2, "script supervisor")]
    assert not [x for x in got if n <= x[0] < n + 4]


def test_quotes_and_brackets(spark):
    got = items(spark, [*BASE * 3, ' [ "actor" , writer ] ', 'actor,"a; ""b"", c",editor', "'actor','writer'", '"actor', "{actor}", "[actor],[editor]"])
    n = 3 * len(BASE)
    by = {i: [x for r, _, x in got if r == n + i] for i in range(6)}
    assert by[0] == ["actor", "writer"]
    assert by[1] == ["actor", 'a; "b", c', "editor"]
    assert by[2] == ["actor", "writer"]
    assert by[3] == ['"actor']
    assert by[4] == ["actor"]
    assert by[5] == ["[actor]", "[editor]"]


def test_blank_separates_ids_only(spark):
    got = items(spark, ["tt1", "tt2", "tt1 tt2", "tt1,tt3", "tt3 , tt4", " tt5  tt6 ", "tt1 ; tt2,tt3 tt4"])
    assert [x for r, _, x in got if r == 2] == ["tt1", "tt2"]
    assert [x for r, _, x in got if r == 4] == ["tt3", "tt4"]
    assert [x for r, _, x in got if r == 5] == ["tt5", "tt6"]


def test_mixed_separators_never_alone(spark):
    got = items(spark, [*BASE, "actor/editor,writer", "writer/actor;editor"])
    assert [x for r, _, x in got if r == len(BASE)] == ["actor", "editor", "writer"]


def test_empty_table_and_single_values(spark):
    assert items(spark, []) == []
    assert items(spark, ["a", "b", "b"]) == [(0, 1, "a"), (1, 1, "b"), (2, 1, "b")]


def test_very_long_field_is_split_whole(spark):
    got = items(spark, [*BASE, ",".join(["actor"] * 200_000)])
    assert len(got) == 200_000 + 6 + 2 * 5 and max(p for _, p, _ in got) == 200_000


def test_clashing_columns_are_ignored(spark):
    df = table(spark, BASE).selectExpr("rsn", "f", "'x' item", "'y' tbl", "1 pos", "'z' raw", "array(1) parts")
    out = split_packed({"t": df}, [PackedSource("t", "f")])
    assert out.count() == 6 + 2 * 5


def test_piece_counts_tell_lists_from_marks_inside_values():
    lists = {2: 400, 3: 300, 4: 200, 5: 100}
    got = count_consistency({",": lists, ";": {2: 45, 3: 28, 4: 19, 5: 8}, "-": {2: 500}}, {",": 1.0, ";": 1.0, "-": 0.1})
    assert got[","] > 0.9 and got[";"] > 0.9 and got["-"] < 0.6
    assert count_consistency({"-": {2: 5}}, {}) == {"-": 0.0}


def test_a_field_is_split_once(spark):
    out = split_packed({"t": table(spark, BASE)}, [PackedSource("t", "f")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 3  # a simple field at separators; any other at quotes, then at separators


def test_lists_keep_blank_slots(spark):
    got = split_lists({"t": table(spark, [*BASE, ",actor,, editor", None, " "])}, [PackedSource("t", "f")])
    by = {r.rsn: r["items"] for r in got.collect()}
    assert len(by) == len(BASE) + 1 and by[len(BASE)] == [None, "actor", None, "editor"]
