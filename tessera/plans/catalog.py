"""One query per operator of the engine, with its SQL. Rows with ties are ordered by keys that make them total."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.database import Database
from tessera.functions import semantics as S
from tessera.operators.numbering import number_rows
from tessera.plans.registry import Registry, Tables
from tessera.recursive import closure, fixpoint, recursive, sql_recursion, with_
from tessera.rel import RSN, Rel
from tessera.relvar import Effect, FixedRelvar, SessionRelvar, run, together
from tessera.session import scratch
from tessera.sources.scannable import scannable
from tessera.sources.tsv import TsvColumn, read_tsv

registry = Registry()
query = registry.query
QUERIES, SQL = registry.QUERIES, registry.SQL

# scans, projection, filters


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def scan_project(t: Tables) -> Rel:
    return Rel.of(t.customer, "c").select(id="c.c_custkey", name="c.c_name", segment="c.c_mktsegment")


@query("SELECT p_partkey AS k, p_brand AS b, split(p_name, ' ')[1] AS first_word, split(p_name, ' ')[9] AS ninth_word FROM part")
def destructure_alias(t: Tables) -> Rel:
    """Columns under new names and elements of an array by place, NULL out of bounds."""
    return Rel.of(t.part, "p").let(words="split(p.p_name, ' ')").select(k="p.p_partkey", b="p.p_brand", first_word=S.at("words", 0), ninth_word=S.at("words", 8))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE 5 < l_quantity AND l_quantity <= 10 AND l_discount >= 0.05")
def filter_cmp_chain(t: Tables) -> Rel:
    return Rel.of(t.lineitem, "l").when(S.lt(5, F.col("l.l_quantity")), S.le(F.col("l.l_quantity"), 10), S.ge(F.col("l.l_discount"), 0.05)).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def filter_not_null_semantics(t: Tables) -> Rel:
    """Two-valued negation keeps rows whose comparison is NULL."""
    return Rel.of(t.orders).when(S.not_(F.nullif("o_orderstatus", F.lit("P")) == "F")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL OR nullif(o_orderstatus, 'P') <> 'O'")
def filter_not_equal(t: Tables) -> Rel:
    return Rel.of(t.orders).when(S.not_equal(F.nullif("o_orderstatus", F.lit("P")), "O")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND NOT coalesce(nullif(p_type, 'PROMO') IN ('SMALL', 'LARGE'), false)")
def in_set_not_in(t: Tables) -> Rel:
    return Rel.of(t.part).when(S.is_in("p_size", [1, 2, 3]), S.not_in(F.nullif("p_type", F.lit("PROMO")), ["SMALL", "LARGE"])).select("p_partkey")


@query("SELECT event_id FROM events WHERE nullif(user_id % 3, 0) IS NOT NULL")
def filter_truthy_value(t: Tables) -> Rel:
    """A value that isn't boolean passes a filter unless it is NULL."""
    return Rel.of(t.events).when(S.present(F.nullif(F.col("user_id") % 3, F.lit(0)))).select("event_id")


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * 1.5)::BIGINT AS c FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 90000")
def let_sequential(t: Tables) -> Rel:
    return Rel.of(t.lineitem, "l").let(a="1 - l.l_discount", b="l.l_extendedprice * a").when("b > 90000").let(a="b * 1.5D").select("l_orderkey", "l_linenumber", c="floor(a)")


@query("SELECT p_partkey, substr(p_name, 2, 3) AS sub, contains(p_name, 'ring') AS inc, starts_with(p_name, 'small') AS st, ends_with(p_name, 'ring') AS en, p_name || '/' || p_brand AS cat, upper(p_type) AS up FROM part")
def string_funcs(t: Tables) -> Rel:
    return Rel.of(t.part).select(
        "p_partkey", sub=S.subs("p_name", 1, 4), inc=S.includes("p_name", "ring"), st=S.starts_with("p_name", "small"), en=S.ends_with("p_name", "ring"), cat="p_name || '/' || p_brand", up="upper(p_type)"
    )


@query("SELECT p_partkey, regexp_extract(p_brand, '[0-9]+') AS num FROM part WHERE regexp_matches(p_name, '^s.*(ing|old)$')")
def regex_filter(t: Tables) -> Rel:
    return Rel.of(t.part).when(S.re_matches("^s.*(ing|old)$", "p_name")).select("p_partkey", num=S.re_find("[0-9]+", "p_brand"))


@query("SELECT o_orderkey, (o_custkey - 700) // 7 AS q, (o_custkey - 700) % 7 AS r, o_custkey + 1 AS i, o_custkey - 1 AS d FROM orders")
def quot_rem(t: Tables) -> Rel:
    """Quotient truncated towards zero, remainder with the sign of the dividend."""
    x = F.col("o_custkey") - 700
    return Rel.of(t.orders).select("o_orderkey", q=S.quot(x, 7), r=S.rem(x, 7), i=S.inc("o_custkey"), d=S.dec("o_custkey"))


@query("SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY 1, 2")
def date_year(t: Tables) -> Rel:
    return Rel.of(t.orders).group({"year": "year(o_orderdate)", "month": "month(o_orderdate)"}, n="count(*)")


@query("SELECT p_type, sum(CASE WHEN p_size > 40 THEN 3 WHEN p_size > 20 THEN 2 ELSE 1 END)::BIGINT AS s FROM part GROUP BY 1")
def case_sum(t: Tables) -> Rel:
    return Rel.of(t.part).group({"p_type": "p_type"}, s=S.sum0("case when p_size > 40 then 3 when p_size > 20 then 2 else 1 end"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_lookup(t: Tables) -> Rel:
    return Rel.of(t.events).let(p="from_json(props, 'k long')").select("event_id", k="p.k")


@query("SELECT event_type, count(*) AS n FROM events WHERE date_trunc('millisecond', ts) >= TIMESTAMP '2024-01-15' GROUP BY 1")
def date_compare(t: Tables) -> Rel:
    return Rel.of(t.events).when(F.date_trunc("millisecond", "ts") >= F.lit("2024-01-15").cast("timestamp")).group({"event_type": "event_type"}, n="count(*)")


@query("SELECT n_nationkey, n_name, n_regionkey, n_regionkey * 10 AS r10 FROM nation")
def select_star(t: Tables) -> Rel:
    return Rel.of(t.nation).select("*", r10="n_regionkey * 10")


@query("SELECT nconst, name, born, list_transform(string_split(titles, ','), lambda x: substr(x, 3)::BIGINT) AS titles FROM (SELECT n_nationkey AS nconst, n_name AS name, nullif(n_regionkey, 2) AS born, 'tt' || n_nationkey || ',tt' || (n_nationkey + 7) AS titles FROM nation)")
def source_tsv(t: Tables) -> DataFrame:
    """A gzipped TSV with ids, nulls and lists, written and read back."""
    path = scratch(t.spark, "tessera-tsv")
    lines = t.nation.select(F.expr("concat_ws('\t', concat('nm', n_nationkey), n_name, coalesce(cast(nullif(n_regionkey, 2) as string), '\\\\N'), concat('tt', n_nationkey, ',tt', n_nationkey + 7))"))
    lines.write.option("compression", "gzip").text(f"{path}/lines")
    return read_tsv(t.spark, f"{path}/lines", [TsvColumn("nconst", "id"), TsvColumn("name"), TsvColumn("born", "int"), TsvColumn("titles", "ids")], header=False).select(F.col("nconst").cast("int").alias("nconst"), "name", "born", "titles")


@query("SELECT range AS n, range * range AS square FROM range(1000)")
def source_scannable(t: Tables) -> DataFrame:
    """A relation of our own, read in parallel through the data source interface."""
    return scannable(t.spark, "tessera_squares", "n long, square long", [(i, i + 250) for i in range(0, 1000, 250)], lambda part: ((n, n * n) for n in range(*part)))


# joins


@query("SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM region a, nation b WHERE a.r_regionkey < 3")
def cross_join_small(t: Tables) -> Rel:
    return Rel.of(t.region, "a").bind("b", t.nation).when("a.r_regionkey < 3").select(x="a.r_regionkey", y="b.n_nationkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_equi(t: Tables) -> Rel:
    return Rel.of(t.orders, "o").join("c", t.customer, "o.o_custkey = c.c_custkey").select("o.o_orderkey", "c.c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate AND l_extendedprice > o_totalprice / 2")
def inner_equi_theta(t: Tables) -> Rel:
    on = "l.l_orderkey = o.o_orderkey and l.l_shipdate < o.o_orderdate and l.l_extendedprice > o.o_totalprice / 2"
    return Rel.of(t.lineitem, "l").join("o", t.orders, on).select("l.l_orderkey", "l.l_linenumber", "l.l_partkey")


@query("SELECT a.s_suppkey AS a, b.n_nationkey AS b FROM supplier a JOIN nation b ON a.s_nationkey < b.n_nationkey")
def inner_theta(t: Tables) -> Rel:
    return Rel.of(t.supplier, "a").join("b", t.nation, "a.s_nationkey < b.n_nationkey").select(a="a.s_suppkey", b="b.n_nationkey")


@query("SELECT d.doc_id, l.abusive FROM documents d LEFT JOIN doc_labels l ON d.doc_id = l.doc_id")
def left_equi(t: Tables) -> Rel:
    return Rel.of(t.documents, "d").left_join("l", t.doc_labels, "d.doc_id = l.doc_id").select("d.doc_id", "l.abusive")


@query("SELECT d.doc_id, l.abusive FROM documents d LEFT JOIN doc_labels l ON d.doc_id = l.doc_id AND l.abusive = 1 AND d.n_chars > 500")
def left_equi_theta(t: Tables) -> Rel:
    return Rel.of(t.documents, "d").left_join("l", t.doc_labels, "d.doc_id = l.doc_id and l.abusive = 1 and d.n_chars > 500").select("d.doc_id", "l.abusive")


@query("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a LEFT JOIN region b ON b.r_regionkey > a.n_nationkey")
def left_theta(t: Tables) -> Rel:
    return Rel.of(t.nation, "a").left_join("b", t.region, "b.r_regionkey > a.n_nationkey").select(a="a.n_nationkey", b="b.r_regionkey")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join(t: Tables) -> Rel:
    return Rel.of(t.supplier, "a").join("b", t.supplier, "a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey").select(a="a.s_suppkey", b="b.s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_exists(t: Tables) -> Rel:
    return Rel.of(t.customer, "c").semi_join("o", t.orders, "o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT'").select("c_custkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM doc_labels l WHERE l.doc_id = d.doc_id)")
def anti_not_exists(t: Tables) -> Rel:
    return Rel.of(t.documents, "d").anti_join("l", t.doc_labels, "l.doc_id = d.doc_id").select("doc_id")


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey > n_nationkey)")
def semi_theta(t: Tables) -> Rel:
    return Rel.of(t.nation, "n").semi_join("r", t.region, "r.r_regionkey > n.n_nationkey").select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey > n_nationkey)")
def anti_theta(t: Tables) -> Rel:
    return Rel.of(t.nation, "n").anti_join("r", t.region, "r.r_regionkey > n.n_nationkey").select("n_nationkey")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM doc_labels) AS labelled FROM documents WHERE n_chars > 2000 OR doc_id IN (SELECT doc_id FROM doc_labels)")
def exists_or_mark(t: Tables) -> Rel:
    return Rel.of(t.documents, "d").mark("labelled", "l", t.doc_labels, {"d.doc_id": "doc_id"}).when("d.n_chars > 2000 or labelled").select("d.doc_id", "labelled")


# subqueries


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_uncorrelated(t: Tables) -> Rel:
    usual = Rel.of(t.customer, "x").select(a="avg(x.c_acctbal)").df.scalar()
    return Rel.of(t.customer, "c").when(F.col("c.c_acctbal") > usual).select("c_custkey")


@query("SELECT c_custkey, o_orderkey AS first_order FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) n FROM orders) ON o_custkey = c_custkey AND n = 1")
def scalar_correlated_first(t: Tables) -> Rel:
    return Rel.of(t.customer, "c").first_match("o", t.orders, {"c.c_custkey": "o_custkey"}, ["o_orderdate", "o_orderkey"]).select("c.c_custkey", first_order="o.o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT l_partkey k, avg(l_quantity) a FROM lineitem GROUP BY 1) ON k = l_partkey WHERE l_quantity > 1.8 * a")
def scalar_correlated_agg(t: Tables) -> Rel:
    sub = t.lineitem.alias("x").where(F.col("x.l_partkey") == F.col("l.l_partkey").outer()).select(F.avg("x.l_quantity") * 1.8)
    return Rel.of(t.lineitem, "l").when(F.col("l.l_quantity") > sub.scalar()).select("l.l_orderkey", "l.l_linenumber", "l.l_partkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01') AS n FROM customer")
def scalar_count_zero(t: Tables) -> Rel:
    """A count over no rows is 0, not NULL and not 1."""
    sub = t.orders.alias("o").where((F.col("o.o_custkey") == F.col("c.c_custkey").outer()) & (F.col("o.o_orderdate") >= F.lit("2001-01-01").cast("timestamp"))).select(F.count("*"))
    return Rel.of(t.customer, "c").select("c.c_custkey", n=sub.scalar())


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def in_subquery(t: Tables) -> Rel:
    return Rel.of(t.part, "p").semi_join("l", Rel.of(t.lineitem).when("l_quantity = 50"), "l.l_partkey = p.p_partkey").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity = 50 AND l_partkey = p_partkey)")
def not_in_subquery(t: Tables) -> Rel:
    """NOT IN without SQL's NULL trap."""
    return Rel.of(t.part, "p").anti_join("l", Rel.of(t.lineitem).when("l_quantity = 50"), "l.l_partkey = p.p_partkey").select("p_partkey")


@query("SELECT vec_id, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0.2")
def lateral_explode(t: Tables) -> Rel:
    """A source that depends on an earlier binding: the elements of a row's array."""
    return Rel.of(t.embeddings, "e").bind("x", "e.embedding").when("x > 0.2").select("e.vec_id", x="cast(x as double)")


@query("SELECT tconst, g AS genre FROM (SELECT rsn, tconst, unnest(genres) AS g FROM titles_tsv UNION ALL SELECT rsn, tconst, NULL FROM titles_tsv WHERE coalesce(len(genres), 0) = 0)")
def lateral_explode_outer(t: Tables) -> Rel:
    return Rel.of(t.titles_tsv, "t").bind_outer("genre", "t.genres").select("t.tconst", "genre")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) n FROM orders) ON o_custkey = c_custkey AND n = 1")
def lateral_top1(t: Tables) -> Rel:
    sub = t.orders.alias("o").where(F.col("o.o_custkey") == F.col("c.c_custkey").outer()).orderBy(F.col("o.o_totalprice").desc(), F.col("o.o_orderkey")).limit(1).select("o_orderkey", "o_totalprice")
    return Rel.of(t.customer, "c").lateral("b", sub, "left").select("c.c_custkey", "b.o_orderkey", "b.o_totalprice")


# groups and aggregates


@query("SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, max(o_custkey) AS m FROM orders GROUP BY 1, 2")
def group_keys(t: Tables) -> Rel:
    return Rel.of(t.orders).group({"s": "o_orderstatus", "p": "o_orderpriority"}, n=S.count_rows(), m="max(o_custkey)")


@query("SELECT count(*) AS n, max(l_quantity) AS m FROM lineitem")
def group_global(t: Tables) -> Rel:
    return Rel.of(t.lineitem).group(n=S.count_rows(), m="max(l_quantity)")


@query("SELECT count(*) + 1 AS n, coalesce(sum(l_quantity), 0.0) AS s, max(l_quantity) AS m FROM lineitem WHERE l_quantity < 0")
def group_global_empty(t: Tables) -> Rel:
    """A group without keys makes one row, also of no rows."""
    return Rel.of(t.lineitem).when("l_quantity < 0").select(n=S.count_rows() + 1, s=S.sum0("l_quantity"), m="max(l_quantity)")


@query("SELECT o_custkey % 10 AS k, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def group_expr(t: Tables) -> Rel:
    return Rel.of(t.orders).group({"k": "o_custkey % 10", "y": "year(o_orderdate)"}, n=S.count_rows())


@query("SELECT nullif(o_orderstatus, 'P') AS s, count(*) AS n FROM orders GROUP BY 1")
def group_null_key(t: Tables) -> Rel:
    return Rel.of(t.orders).group({"s": "nullif(o_orderstatus, 'P')"}, n=S.count_rows())


@query("SELECT n AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def group_twice(t: Tables) -> Rel:
    return Rel.of(t.orders).group({"c": "o_custkey"}, n=S.count_rows()).group({"orders": "n"}, customers=S.count_rows())


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having(t: Tables) -> Rel:
    return Rel.of(t.orders).group({"o_custkey": "o_custkey"}, n=S.count_rows()).when("n > 12")


@query("SELECT p_type, coalesce(sum(CASE WHEN p_size > 49 AND p_type <> 'PROMO' THEN p_size END), 0)::BIGINT AS s FROM part GROUP BY 1")
def agg_sum0(t: Tables) -> Rel:
    return Rel.of(t.part).group({"p_type": "p_type"}, s=S.sum0("case when p_size > 49 and p_type <> 'PROMO' then p_size end"))


@query("""SELECT o_orderstatus AS s, round(coalesce(avg(CASE WHEN o_custkey % 2 = 0 THEN o_custkey END), 0.0), 6) AS a,
round(coalesce(sum(CASE WHEN o_custkey % 2 = 0 THEN o_custkey END), 0) / greatest(count(*), 1), 6) AS a_all FROM orders GROUP BY 1""")
def agg_avg(t: Tables) -> Rel:
    """The SQL average, and the average over all rows, those without a value too."""
    even = "case when o_custkey % 2 = 0 then o_custkey end"
    return Rel.of(t.orders).group({"s": "o_orderstatus"}, a=F.round(S.avg0(even), 6), a_all=F.round(S.avg_all(even), 6))


@query("SELECT n_regionkey AS r, min(n_name) AS lo, max(n_name) AS hi, min(nullif(n_nationkey, 0)) AS k FROM nation GROUP BY 1")
def agg_minmax(t: Tables) -> Rel:
    return Rel.of(t.nation).group({"r": "n_regionkey"}, lo="min(n_name)", hi="max(n_name)", k="min(nullif(n_nationkey, 0))")


@query("SELECT o_orderpriority AS p, count(nullif(o_orderstatus, 'P')) AS n, count(*) AS all_rows FROM orders GROUP BY 1")
def agg_count_expr(t: Tables) -> Rel:
    return Rel.of(t.orders).group({"p": "o_orderpriority"}, n="count(nullif(o_orderstatus, 'P'))", all_rows=S.count_rows())


@query("SELECT l_returnflag AS f, count(DISTINCT l_suppkey) AS s, count(DISTINCT nullif(l_linenumber, 1)) AS l FROM lineitem GROUP BY 1")
def agg_count_distinct(t: Tables) -> Rel:
    return Rel.of(t.lineitem).group({"f": "l_returnflag"}, s="count(distinct l_suppkey)", l="count(distinct nullif(l_linenumber, 1))")


@query("SELECT r, array_to_string(list_transform(list(x ORDER BY k), lambda v: coalesce(v, '-')), ',') AS names FROM (SELECT n_regionkey r, n_nationkey k, nullif(n_name, 'NATION_3') x FROM nation) GROUP BY 1")
def group_collect_list(t: Tables) -> Rel:
    """A group's values as a collection that keeps NULLs."""
    got = Rel.of(t.nation).group({"r": "n_regionkey"}, xs=S.collect("nullif(n_name, 'NATION_3')", "n_nationkey"))
    return got.select("r", names="array_join(xs, ',', '-')")


@query("SELECT l_linenumber AS n, count(DISTINCT l_returnflag)::INT AS flags, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS which FROM lineitem GROUP BY 1")
def group_collect_set_size(t: Tables) -> Rel:
    got = Rel.of(t.lineitem).group({"n": "l_linenumber"}, fs=S.collect_distinct("l_returnflag"))
    return got.select("n", flags="size(fs)", which="array_join(fs, '')")


@query("SELECT n_regionkey AS r, sum(n_nationkey * n_nationkey)::BIGINT AS squares, list_sort(list(n_nationkey * 2)) AS doubled FROM nation GROUP BY 1")
def group_column_map(t: Tables) -> Rel:
    """Element-wise expressions and reductions over a group's collection."""
    got = Rel.of(t.nation).group({"r": "n_regionkey"}, xs=S.collect("n_nationkey", "n_nationkey"))
    return got.select("r", squares="aggregate(xs, 0L, (a, x) -> a + x * x)", doubled="transform(xs, x -> x * 2)")


@query("SELECT list_reduce(list_prepend(7, list(n_nationkey ORDER BY n_nationkey)), lambda a, x: (a * 31 + x) % 1000003)::BIGINT AS value FROM nation")
def fold_agg(t: Tables) -> Rel:
    """An arbitrary fold over rows in order."""
    return Rel.of(t.nation).fold("n_nationkey", "n_nationkey", F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 1000003)


@query("SELECT list_reduce(list_prepend(0::BIGINT, list(o_custkey::BIGINT ORDER BY o_orderkey)), lambda a, x: (a * 31 + x) % 1000003)::BIGINT AS value FROM orders")
def fold_merge(t: Tables) -> Rel:
    """The same fold over a large table: its steps are x -> m x + a, so partitions fold apart and merge in order."""
    p = 1000003
    pair = lambda m, a: F.struct((m % p).alias("m"), (a % p).alias("a"))
    init = pair(F.lit(1).cast("long"), F.lit(0).cast("long"))
    state = Rel.of(t.orders).fold("o_orderkey", "cast(o_custkey as long)", init, lambda s, x: pair(s.m * 31, s.a * 31 + x), "s", merge=lambda s, r: pair(s.m * r.m, s.a * r.m + r.a))
    return state.select(value="s.a")


@query("SELECT p_type AS k, count(*) AS n, round(stddev_pop(p_retailprice), 4) AS sd FROM part GROUP BY 1")
def udaf_group(t: Tables) -> Rel:
    """A Python aggregate of our own, one Series per group."""

    def spread(x: pd.Series) -> float:
        return float(x.std(ddof=0)) if len(x) else 0.0

    sd = S.aggregate_udf(spread, "double")
    a = t.part.groupBy(F.col("p_type").alias("k")).agg(sd(F.col("p_retailprice")).alias("sd"))
    n = t.part.groupBy(F.col("p_type").alias("k")).agg(F.count("*").alias("n"))
    return a.join(n, "k").select("k", "n", F.round("sd", 4).alias("sd"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN (p_size * 7) % 11 END AS h FROM part")
def udf_null_safe(t: Tables) -> Rel:
    """A vectorised Python function that is NULL for a NULL argument."""

    def hashed(x: pd.Series) -> pd.Series:
        return (x.fillna(0).astype("int64") * 7) % 11

    f = S.scalar_udf(hashed, "long")
    return Rel.of(t.part).let(s="if(p_size % 5 = 0, null, p_size)").select("p_partkey", h=f(F.col("s")).cast("int"))


@query("SELECT doc_id, unnest(range(1, 1 + n_chars // 1000)) AS part FROM documents WHERE n_chars IS NOT NULL")
def udtf_lateral(t: Tables) -> DataFrame:
    """A function that returns rows, used as a correlated source; rows come in Arrow batches."""

    @F.udtf(returnType="part long", useArrow=True)
    class Parts:
        def eval(self, n: int):  # noqa: ANN202
            for i in range(1, 1 + n // 1000):
                yield (i,)

    docs = t.documents.where("n_chars is not null").select("doc_id", "n_chars").alias("d")
    return docs.lateralJoin(Parts(F.col("d.n_chars").outer())).select("doc_id", "part")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 1000 // (p_size - 20) END AS inv FROM part WHERE p_size > 20")
def udf_pinned(t: Tables) -> Rel:
    """A function that must not be moved before the filter that guards it."""

    def inverse(x: pd.Series) -> pd.Series:
        if (x <= 20).any():
            raise ValueError("called before its guard")
        return 1000 // (x - 20)

    f = S.scalar_udf(inverse, "long", pinned=True)
    return Rel.of(t.part).when("p_size > 20").select("p_partkey", inv=f(F.col("p_size").cast("long")).cast("int"))


# order, limit, distinct, union


@query("SELECT row_number() OVER (ORDER BY k NULLS FIRST, n_nationkey DESC) AS n, n_nationkey FROM (SELECT n_nationkey, nullif(n_regionkey, 2) k FROM nation)")
def order_nulls(t: Tables) -> DataFrame:
    """NULL sorts lowest; the rank shows the order."""
    rows = Rel.of(t.nation).let(k="nullif(n_regionkey, 2)").order("k", "n_nationkey desc").df.select("n_nationkey")
    ranked = Rel.of([r[0] for r in rows.collect()], schema="n_nationkey int", spark=t.spark)  # 25 rows, whatever the scale
    return ranked.df.select((F.col(RSN) + 1).alias("n"), "n_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit_topk(t: Tables) -> Rel:
    return Rel.of(t.orders).order("o_totalprice desc", "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT c_name, o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10) JOIN customer ON o_custkey = c_custkey")
def limit_then_join(t: Tables) -> Rel:
    return Rel.of(t.orders, "o").order("o.o_totalprice", "o.o_orderkey").limit(10).join("c", t.customer, "o.o_custkey = c.c_custkey").select("c.c_name", "o.o_orderkey")


@query("SELECT DISTINCT ON (tconst) tconst, rsn, primaryTitle FROM titles_tsv ORDER BY tconst, rsn")
def distinct_on_first(t: Tables) -> Rel:
    return Rel.of(t.titles_tsv).distinct(["tconst"], ["rsn"]).select("tconst", "rsn", "primaryTitle")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t: Tables) -> Rel:
    return Rel.of(t.orders).select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def union_all(t: Tables) -> Rel:
    return Rel.union(Rel.of(t.customer).select(k="c_nationkey"), Rel.of(t.supplier).select(k="s_nationkey"), Rel.of(t.nation).select(k="n_nationkey"))


@query("SELECT n_name AS name FROM nation ORDER BY n_nationkey LIMIT 1")
def rel_first(t: Tables) -> DataFrame:
    row = Rel.of(t.nation).order("n_nationkey").first()
    return t.spark.createDataFrame([(row.n_name,)] if row else [], "name string")


@query("SELECT (SELECT count(*) FROM nation) AS n, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 9) AS e")
def rel_count_exists(t: Tables) -> DataFrame:
    n = Rel.of(t.nation)
    return t.spark.createDataFrame([(n.count(), n.when("n_regionkey = 9").exists())], "n long, e boolean")


# common table expressions and recursion


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 400000) SELECT a.o_orderkey FROM big a JOIN big b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey")
def cte_plain(t: Tables) -> DataFrame:
    body = lambda e: Rel.of(e["big"], "a").join("b", e["big"], "a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey").select("a.o_orderkey").df
    return with_([("big", t.orders.where("o_totalprice > 400000"))], body)


@query("SELECT r_regionkey::BIGINT AS k FROM region UNION ALL SELECT n_nationkey::BIGINT FROM nation")
def cte_accumulate(t: Tables) -> DataFrame:
    """Members of one name are appended."""
    return with_([("a", t.region.select(F.col("r_regionkey").cast("long").alias("k"))), ("a", t.nation.select(F.col("n_nationkey").cast("long").alias("k")))], lambda e: e["a"])


@query("WITH RECURSIVE r(k, up) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 0 UNION ALL SELECT k, up // 2 FROM r WHERE up > 1) SELECT k, up FROM r")
def cte_linear(t: Tables) -> DataFrame:
    """All ancestors in the binary numbering of customers, by Spark's own recursion."""
    t.customer.createOrReplaceTempView("_tessera_customer")
    return sql_recursion(t.spark, "r", "k, up", "SELECT c_custkey, c_custkey div 2 FROM _tessera_customer WHERE c_custkey > 0", "SELECT k, up div 2 FROM r WHERE up > 1", "SELECT k, up FROM r")


@query("WITH RECURSIVE r(k, up) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 0 UNION ALL SELECT k, up // 2 FROM r WHERE up > 1) SELECT up AS k, count(*) AS below FROM r GROUP BY 1")
def cte_linear_driver(t: Tables) -> DataFrame:
    """The same recursion as rounds, feeding a group."""
    base = t.customer.where("c_custkey > 0").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 2").alias("up"))
    grown = fixpoint(base, lambda d: d.where("up > 1").select("k", F.expr("up div 2").alias("up")))
    return Rel.of(grown).group({"k": "up"}, below=S.count_rows()).df


@query("""WITH e AS (SELECT n_nationkey a, n_nationkey + 1 b FROM nation WHERE n_nationkey < 24), d1 AS (SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a),
d2 AS (SELECT x.a, y.b FROM d1 x JOIN d1 y ON x.b = y.a), d3 AS (SELECT x.a, y.b FROM d2 x JOIN d2 y ON x.b = y.a), d4 AS (SELECT x.a, y.b FROM d3 x JOIN d3 y ON x.b = y.a)
SELECT a, b FROM e UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4""")
def cte_nonlinear_delta(t: Tables) -> DataFrame:
    """Both references see only the round before, so paths double in length; this is not the closure."""
    e = t.nation.where("n_nationkey < 24").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    step = recursive(lambda env: Rel.of(env["p"], "x").join("y", env["p"], "x.b = y.a").select("x.a", "y.b").df)
    return with_([("p", e), ("p", step)], lambda env: env["p"])


@query("""WITH RECURSIVE e AS (SELECT s_suppkey a, s_suppkey // 10 * 10 + (s_suppkey * 7 + 3) % 10 b FROM supplier), r(a, b, path) AS (SELECT a, b, [a, b] FROM e WHERE a <> b
UNION ALL SELECT r.a, e.b, list_append(r.path, e.b) FROM r JOIN e ON r.b = e.a WHERE NOT list_contains(r.path, e.b)) SELECT a, b, len(path)::INT AS steps FROM r""")
def cte_cycle_guard(t: Tables) -> DataFrame:
    """Walks over a cyclic relation that carry their path and stop before repeating a place."""
    e = t.supplier.select(F.col("s_suppkey").alias("a"), F.expr("s_suppkey div 10 * 10 + (s_suppkey * 7 + 3) % 10").alias("b"))
    base = e.where("a <> b").select("a", "b", F.array("a", "b").alias("path"))
    step = lambda d: Rel.of(d, "r").join("e", e, "r.b = e.a").when(S.not_(S.holds("r.path", F.col("e.b")))).select("r.a", "e.b", path="array_append(r.path, e.b)").df
    return Rel.of(fixpoint(base, step)).select("a", "b", steps="size(path)").df


@query("""WITH RECURSIVE r(k, boss, path) AS (SELECT n_nationkey, NULL::INT, n_name FROM nation WHERE n_nationkey = 0
UNION ALL SELECT n.n_nationkey, r.k, r.path || '/' || n.n_name FROM nation n JOIN r ON (n.n_nationkey - 1) // 3 = r.k AND n.n_nationkey > 0) SELECT k, boss, path FROM r""")
def cte_org_chart(t: Tables) -> DataFrame:
    people = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.expr("cast(if(n_nationkey > 0, (n_nationkey - 1) div 3, null) as int)").alias("boss"))
    root = people.where("k = 0").select("k", "boss", F.col("name").alias("path"))
    step = recursive(lambda env: Rel.of(people, "n").join("r", env["chart"], "n.boss = r.k").order("n.k").select(k="n.k", boss="n.boss", path="r.path || '/' || n.name").df)
    return with_([("chart", root), ("chart", step)], lambda env: env["chart"])


@query("""WITH RECURSIVE r(k, n) AS (SELECT c_nationkey, count(*) FROM customer GROUP BY 1 UNION ALL SELECT k // 2, n FROM r WHERE k > 0) SELECT k, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def cte_aggregate_member(t: Tables) -> DataFrame:
    """A recursive member that aggregates; summed at the end, so rounds may merge their rows."""
    base = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    step = lambda d: d.where("k > 0").groupBy(F.expr("cast(k div 2 as int)").alias("k")).agg(F.sum("n").alias("n"))
    return fixpoint(base, step).groupBy("k").agg(F.sum("n").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey a, (s_nationkey * 3 + 1) % 25 b FROM supplier), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r""")
def cte_closure(t: Tables) -> DataFrame:
    """Distinct closure over a cyclic relation."""
    e = t.supplier.select(F.col("s_nationkey").alias("a"), F.expr("(s_nationkey * 3 + 1) % 25").alias("b")).distinct()
    return closure(e, lambda d: Rel.of(d, "r").join("e", e, "r.b = e.a").select("r.a", "e.b").df)


@query("""WITH RECURSIVE a(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM a WHERE n < 6), b(n, m) AS (SELECT n, n FROM a UNION ALL SELECT n, m * 2 FROM b WHERE m < 20) SELECT n, m FROM b""")
def cte_chained(t: Tables) -> DataFrame:
    """A recursive relation that feeds another."""
    one = t.spark.createDataFrame([(1,)], "n int")
    return with_(
        [
            ("a", one), ("a", recursive(lambda e: e["a"].where("n < 6").select((F.col("n") + 1).alias("n")))),
            ("b", lambda e: e["a"].select("n", F.col("n").alias("m"))), ("b", recursive(lambda e: e["b"].where("m < 20").select("n", (F.col("m") * 2).alias("m")))),
        ],
        lambda e: e["b"],
    )


@query("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 150) SELECT n FROM r")
def cte_deep(t: Tables) -> DataFrame:
    """Deeper than Spark's default limit of 100 levels."""
    return sql_recursion(t.spark, "r", "n", "SELECT 1", "SELECT n + 1 FROM r WHERE n < 150", "SELECT n FROM r", 500)


@query("WITH RECURSIVE a(n) AS (SELECT n_nationkey::BIGINT FROM nation UNION ALL SELECT n + 25 FROM a WHERE n < 75), b(n) AS (SELECT n FROM a UNION ALL SELECT n * 10 FROM b WHERE n BETWEEN 1 AND 50) SELECT n FROM b")
def cte_two_members(t: Tables) -> DataFrame:
    """Two recursive members of one name: the second starts from all that the first added."""
    base = t.nation.select(F.col("n_nationkey").cast("long").alias("n"))
    up = recursive(lambda e: e["a"].where("n < 75").select((F.col("n") + 25).alias("n")))
    times = recursive(lambda e: e["a"].where("n between 1 and 50").select((F.col("n") * 10).alias("n")))
    return with_([("a", base), ("a", up), ("a", times)], lambda e: e["a"])


@query("SELECT l_orderkey % 97 AS k, level, count(*) AS n FROM lineitem, range(20) r(level) GROUP BY 1, 2")
def cte_large(t: Tables) -> DataFrame:
    """A recursion of more than a million rows, where Spark stops unless told otherwise."""
    t.lineitem.createOrReplaceTempView("_tessera_lines")
    step, body = "SELECT k, level + 1 FROM r WHERE level < 19", "SELECT k % 97 AS k, level, count(*) AS n FROM r GROUP BY 1, 2"
    return sql_recursion(t.spark, "r", "k, level", "SELECT l_orderkey, 0L FROM _tessera_lines", step, body, 200)


# relation variables, indexes, transactions; in folders of their own


def _customers(t: Tables) -> SessionRelvar:
    return SessionRelvar(t.spark, "id long, name string, nation int, bal double", t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")))


def _database(t: Tables) -> Database:
    return Database(t.spark, scratch(t.spark, "tessera-db"))


_C = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS bal FROM customer"


@query(f"SELECT * FROM ({_C}) WHERE nation = 7")
def index_getn(t: Tables) -> DataFrame:
    return _customers(t).index("nation").getn(7).drop(RSN)


@query(f"SELECT * FROM ({_C}) WHERE bal > 1000 AND bal <= 2000")
def index_range(t: Tables) -> DataFrame:
    return _customers(t).index("bal").range("<=", 2000.0, ">", 1000.0).drop(RSN)


@query(f"SELECT * FROM ({_C}) ORDER BY bal DESC, id DESC LIMIT 15")
def index_topk(t: Tables) -> DataFrame:
    return _customers(t).index("bal").top_k(15).drop(RSN)


@query(f"SELECT * FROM ({_C}) ORDER BY bal, id LIMIT 15")
def index_bottomk(t: Tables) -> DataFrame:
    return _customers(t).index("bal").bottom_k(15).drop(RSN)


@query(f"SELECT * FROM ({_C}) WHERE nullif(nation, 3) IS NOT NULL")
def index_scan(t: Tables) -> DataFrame:
    """An index has no rows with a NULL key."""
    rv = _customers(t)
    rv.update("nation = 3", nation="null")
    return rv.index("nation").rows().drop(RSN)


@query(f"SELECT * FROM ({_C}) WHERE id = 42")
def relvar_lookup(t: Tables) -> DataFrame:
    return _customers(t).lookup("id", 42).drop(RSN)


@query(f"SELECT * FROM ({_C}) UNION ALL SELECT -1, 'new', 3, 1.5 UNION ALL SELECT id + 1000000, name, nation, bal FROM ({_C}) WHERE nation = 1")
def relvar_insert(t: Tables) -> DataFrame:
    rv = _customers(t)
    rv.insert({"id": -1, "name": "new", "nation": 3, "bal": 1.5})
    rv.insert_all(rv.scan().where("nation = 1").select((F.col("id") + 1000000).alias("id"), "name", "nation", "bal"))
    return rv.scan().drop(RSN)


@query("SELECT id, name, nation, bal, row_number() OVER (ORDER BY id) - 1 AS rsn FROM (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS bal FROM supplier)")
def relvar_set(t: Tables) -> DataFrame:
    """Replacing all contents numbers the rows anew, in order of the source's numbers."""
    rv = SessionRelvar(t.spark, "id long, name string, nation int, bal double")
    rv.set(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias(RSN)))
    return rv.scan().withColumnRenamed(RSN, "rsn")


@query(f"SELECT id, name, nation, CASE WHEN nation = 5 THEN bal + 100 ELSE bal END AS bal FROM ({_C})")
def relvar_update(t: Tables) -> DataFrame:
    rv = _customers(t)
    rv.update("nation = 5", bal="bal + 100")
    return rv.scan().drop(RSN)


@query(f"WITH c AS ({_C}), k AS (SELECT id, row_number() OVER (ORDER BY nation = 4, id) AS place FROM c) SELECT id, place FROM k")
def relvar_replace_moves_end(t: Tables) -> DataFrame:
    """A replaced row gets a new number and moves to the end, in the old order."""
    rv = SessionRelvar(t.spark, "id long, nation int")
    rv.set(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias(RSN)))
    rv.update("nation = 4", nation="nation")
    ranked, _ = number_rows(rv.scan(), "place", 1, [F.col(RSN)])
    return ranked.select("id", "place")


@query(f"SELECT * FROM ({_C}) WHERE NOT (nation = 2 OR id % 5 = 0)")
def relvar_delete(t: Tables) -> DataFrame:
    rv = _customers(t)
    rv.delete("nation = 2")
    rv.run(lambda rows: rows.where("id % 5 = 0"))
    return rv.scan().drop(RSN)


@query(f"SELECT * FROM ({_C}) WHERE id <> 7 UNION ALL SELECT 7, 'seven', 1, 0.0 UNION ALL SELECT -7, 'minus', 2, 1.0")
def relvar_put(t: Tables) -> DataFrame:
    rv = _customers(t)
    rv.put("id", 7, {"id": 7, "name": "seven", "nation": 1, "bal": 0.0})
    rv.put("id", -7, {"id": -7, "name": "minus", "nation": 2, "bal": 1.0})
    return rv.scan().drop(RSN)


@query(f"SELECT id, name, CASE WHEN id = 9 THEN nation + 100 ELSE nation END AS nation, bal FROM ({_C}) WHERE nation <> 6")
def relvar_swap_del_key(t: Tables) -> DataFrame:
    rv = _customers(t)
    rv.del_key("nation", 6)
    rv.swap("id", 9, nation="nation + 100")
    return rv.scan().drop(RSN)


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 42, 'explicit' UNION ALL SELECT 26, 'after'")
def relvar_auto_id(t: Tables) -> DataFrame:
    rv = SessionRelvar(t.spark, "id long, name string")
    rv.auto_id("id")
    rv.set(t.nation.select("n_nationkey", F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias(RSN)).drop("n_nationkey").withColumn("id", F.lit(None).cast("long")))
    rv.insert({"id": 42, "name": "explicit"})
    rv.insert({"name": "after"})
    return rv.scan().drop(RSN)


@query(f"SELECT * FROM ({_C}) WHERE nation <> 8")
def tx_rollback(t: Tables) -> DataFrame:
    """A block that fails leaves a durable variable as it was; one that succeeds is kept whole."""
    db = _database(t)
    rv = db.create("customers", "id long, name string, nation int, bal double")
    rv.insert_all(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")))
    try:
        with db.write() as tx:
            tx["customers"].delete("true")
            raise RuntimeError("roll back")
    except RuntimeError:
        pass
    with db.write() as tx:
        tx["customers"].delete("nation = 8")
    return rv.scan().drop(RSN)


@query(f"SELECT * FROM ({_C})")
def tx_snapshot(t: Tables) -> DataFrame:
    """A relation read before a change keeps what it read."""
    rv = _customers(t)
    before = rv.scan()
    rv.delete("nation < 20")
    return before.drop(RSN)


@query(f"SELECT * FROM ({_C}) WHERE id % 2 = 0")
def session_rollback(t: Tables) -> DataFrame:
    rv = _customers(t)
    rv.delete("id % 2 = 1")
    try:
        with together():
            rv.delete("true")
            raise RuntimeError("roll back")
    except RuntimeError:
        pass
    return rv.scan().drop(RSN)


@query(f"SELECT id, CASE WHEN nation = 9 THEN 'n9' ELSE name END AS name, nation, bal FROM ({_C}) WHERE id > 10")
def database_relvar(t: Tables) -> DataFrame:
    """Durable variables: inserts, an update, a deletion, an index and a compaction."""
    db = _database(t)
    rv = db.create("customers", "id long, name string, nation int, bal double")
    rv.index("id")
    rv.insert_all(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")))
    rv.update("nation = 9", name="'n9'")
    rv.delete(rv.index("id").range("<=", 10))
    db.compact("customers")
    return rv.scan().drop(RSN)


@query("SELECT 'a' AS name, 1::BIGINT AS next_rsn, 'id' AS keys UNION ALL SELECT 'b', 0, ''")
def system_relations(t: Tables) -> DataFrame:
    db = _database(t)
    db.create("a", "id long").index("id")
    db["a"].insert({"id": 3})
    db.create("b", "x string")
    return db.variables().select("name", "next_rsn", F.array_join("indexes", ",").alias("keys"))


@query(f"SELECT 'customers' AS tbl, id, CASE WHEN nation = 3 THEN name || '!' ELSE name END AS name, nation, CASE WHEN nation = 5 THEN NULL ELSE bal END AS bal FROM ({_C}) WHERE nation <> 4 UNION ALL SELECT 'archive', id, NULL, nation, bal FROM ({_C}) WHERE nation = 4")
def run_mixed(t: Tables) -> DataFrame:
    """One query with effects on two variables: an insert, a deletion, an update and a replacement, all or none."""
    rv, archive = _customers(t), SessionRelvar(t.spark, "id long, name string, nation int, bal double")
    rows = Rel.of(rv, "c").join("n", t.nation, "n.n_nationkey = c.nation").when("c.nation between 3 and 5").let(at=f"c.{RSN}")
    # a target that is NULL is none
    rows = rows.let(gone="if(c.nation = 4, at, null)", loud="if(c.nation = 3, at, null)", poor="if(c.nation = 5, at, null)").df
    rows = rows.select("id", "name", "nation", "bal", "gone", "loud", "poor")
    run(rows.where("gone is not null"), Effect(archive, "insert", exprs={"id": "id", "nation": "nation", "bal": "bal"}))
    run(rows, Effect(rv, "delete", "gone"), Effect(rv, "update", "loud", {"name": "name || '!'"}), Effect(rv, "replace", "poor", {"id": "id", "name": "name", "nation": "nation"}))
    return rv.scan().select(F.lit("customers").alias("tbl"), "id", "name", "nation", "bal").unionByName(archive.scan().select(F.lit("archive").alias("tbl"), "id", "name", "nation", "bal"))


def _stored(t: Tables, db: Database) -> None:
    db.create("customers", "id long, name string, nation int, bal double").insert_all(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    )


@query(f"SELECT * FROM ({_C}) WHERE bal >= 100 AND bal < 150")
def index_durable(t: Tables) -> DataFrame:
    """An index made after the rows: they are put into its ranges, so that a range reads few row groups."""
    db = _database(t)
    _stored(t, db)
    return db["customers"].index("bal").range(">=", 100.0, "<", 150.0).drop(RSN)


@query(f"SELECT * FROM ({_C}) WHERE nation = 11")
def index_get(t: Tables) -> DataFrame:
    """An index got by name, or none: a variable without the index on bal gives all it has by lookup."""
    rv = _customers(t)
    rv.index("nation")
    return rv.lookup("nation", 11).drop(RSN) if rv.get("bal") is not None else rv.get("nation").getn(11).drop(RSN)


@query(f"SELECT id, name FROM ({_C}) WHERE id = 17 UNION ALL SELECT -1, 'none' UNION ALL SELECT id, name FROM ({_C}) WHERE id = 18")
def index_get1(t: Tables) -> DataFrame:
    """The first row of a key, or a default; with and without an index."""
    rv = _customers(t)
    one, none, other = rv.index("id").get1(17), rv.index("id").get1(-5, {"id": -1, "name": "none"}), rv.lookup1("id", 18)
    return t.spark.createDataFrame([(r["id"], r["name"]) for r in (one, none, other)], "id long, name string")


@query(f"SELECT id, bal FROM ({_C}) WHERE nation <> 1")
def tx_read(t: Tables) -> DataFrame:
    """A read block sees one state, whatever is written meanwhile by others."""
    db = _database(t)
    _stored(t, db)
    db["customers"].delete("nation = 1")
    other = Database(t.spark, db.folder.uri)
    with db.read() as tx:
        before = tx["customers"].scan().select("id", "bal")
        other["customers"].delete("nation > 2")
        assert tx["customers"].count() == before.count()
    return before


@query(f"SELECT id FROM ({_C}) WHERE nation NOT IN (1, 2) UNION ALL SELECT -1")
def tx_nested(t: Tables) -> DataFrame:
    """Verbs and blocks inside a write block are part of it: they see its changes and are published with it."""
    db = _database(t)
    _stored(t, db)
    rv = db["customers"]
    with db.write() as tx:
        tx["customers"].delete("nation = 1")
        with db.write() as inner:
            inner["customers"].delete("nation = 2")
        rv.insert({"id": -1})
        with db.read() as seen:
            assert seen["customers"].lookup("id", -1).count() == 1
    return rv.scan().select("id")


@query("SELECT 3 AS version, 1 AS variables, 2 AS folders, true AS has_bytes")
def system_stats(t: Tables) -> DataFrame:
    db = _database(t)
    _stored(t, db)
    db["customers"].delete("nation = 1")
    return db.stats().select(F.col("version").cast("int").alias("version"), "variables", "folders", (F.col("bytes") > 0).alias("has_bytes"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer")
def relvar_open(t: Tables) -> DataFrame:
    """Rows with fields the schema doesn't name keep them."""
    rv = SessionRelvar(t.spark, "id long, _more map<string,string>")
    rv.insert_all(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name")))
    return rv.scan().select("id", F.col("_more")["segment"].alias("segment"), F.col("_more")["name"].alias("name"))


# forms of binding, empty relations, more subqueries and functions


@query("SELECT CAST(NULL AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS s WHERE false")
def nil_scan(t: Tables) -> Rel:
    """No relation is an empty one, also as a binding."""
    return Rel.of(t.nation, "n").bind("e", Rel.of(None, spark=t.spark, schema="k long")).select(k="e.k", s="n.n_name")


@query("SELECT n_nationkey, n_regionkey FROM nation")
def without_columns(t: Tables) -> Rel:
    return Rel.of(t.nation).without("n_name", "n_comment")


@query("SELECT tconst, startYear AS year, titleType, genres[1] AS first, genres[2] AS second, struct_pack(t := tconst, y := startYear).y AS again FROM titles_tsv")
def destructure_forms(t: Tables) -> Rel:
    """Keys under their own names and new ones, the whole row, and elements by place."""
    return (
        Rel.of(t.titles_tsv, "t").places("t.genres", "first", "second").take("t", "tconst", "titleType", year="startYear", whole="r")
        .select("tconst", "titleType", "year", "first", "second", again="r.startYear")
    )


@query("SELECT n_nationkey AS k, (SELECT min(r_regionkey) FROM region WHERE r_regionkey > n_nationkey) AS above FROM nation")
def single_theta(t: Tables) -> Rel:
    """The first row of another relation under a condition that is no equality, or NULL."""
    return Rel.of(t.nation, "n").single("r", t.region, "r.r_regionkey > n.n_nationkey", ["r_regionkey"]).select(k="n.n_nationkey", above="r.r_regionkey")


@query("SELECT c_custkey AS k, c_acctbal - (SELECT min(c_acctbal) FROM customer) AS over FROM customer")
def scalar_outside(t: Tables) -> Rel:
    """A scalar taken outside of the query, as a value in it."""
    least = Rel.of(t.customer).select(m="min(c_acctbal)").scalar(0.0)
    return Rel.of(t.customer).select(k="c_custkey", over=F.col("c_acctbal") - F.lit(least))


@query("SELECT n AS orders, count(*) AS customers FROM (SELECT (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) GROUP BY 1")
def group_by_subquery(t: Tables) -> Rel:
    n = t.orders.alias("o").where(F.col("o.o_custkey") == F.col("c.c_custkey").outer()).select(F.count("*"))
    return Rel.of(t.customer, "c").group({"orders": n.scalar()}, customers=S.count_rows())


@query("SELECT c_custkey AS k FROM customer ORDER BY (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) DESC, c_custkey LIMIT 20")
def order_by_subquery(t: Tables) -> Rel:
    n = t.orders.alias("o").where(F.col("o.o_custkey") == F.col("c.c_custkey").outer()).select(F.count("*"))
    return Rel.of(t.customer, "c").order((n.scalar(), "desc"), "c.c_custkey").limit(20).select(k="c.c_custkey")


@query("SELECT event_id, coalesce(list_contains(json_keys(props::JSON), 'k'), false) AS has FROM events")
def contains_key(t: Tables) -> Rel:
    return Rel.of(t.events).select("event_id", has=S.holds_key("from_json(props, 'map<string,string>')", "k"))


@query(r"""SELECT tconst, tconst % 2 = 0 AS ev, coalesce(tconst::VARCHAR, '') || '-' || coalesce(primaryTitle, '') AS txt, array_to_string(list_transform(genres, lambda x: coalesce(x, '')), '/') AS joined,
regexp_replace(primaryTitle || '  ', '\s+$', '') AS trimmed FROM titles_tsv""")
def text_funcs(t: Tables) -> Rel:
    return Rel.of(t.titles_tsv).select(
        "tconst", ev=S.even("tconst"), txt=S.text("tconst", F.lit("-"), "primaryTitle"), joined=S.join_texts("/", "genres"), trimmed=S.trimr("primaryTitle || '  '")
    )


# the comprehensions of the catalogue of films and of the people benchmark

_FILM = "SELECT * FROM titles_tsv WHERE titleType = 'movie' ORDER BY rsn LIMIT 1"


@query(f"WITH t AS ({_FILM}) SELECT n.primaryName AS name FROM t JOIN principals_tsv p ON p.tconst = t.tconst JOIN names_tsv n ON n.nconst = p.nconst")
def film_cast(t: Tables) -> Rel:
    """A limit in the middle of a comprehension: the first film, then its cast."""
    return (
        Rel.of(t.titles_tsv, "t").when("t.titleType = 'movie'").order("t.rsn").limit(1)
        .join("p", t.principals_tsv, "p.tconst = t.tconst").join("n", t.names_tsv, "n.nconst = p.nconst").select(name="n.primaryName")
    )


@query(f"WITH t AS ({_FILM}) SELECT n.primaryName AS name FROM t JOIN principals_tsv p ON p.tconst = t.tconst JOIN names_tsv n ON n.nconst = p.nconst")
def film_cast_lookup(t: Tables) -> Rel:
    """The same by lookups in an indexed relation, which become filters of its scan."""
    cast = FixedRelvar(t.principals_tsv.select("tconst", "nconst"))
    cast.index("tconst")
    film = Rel.of(t.titles_tsv).when("titleType = 'movie'").order("rsn").first()
    credits = cast.lookup("tconst", film.tconst if film else None)
    return Rel.of(credits, "p").join("n", t.names_tsv, "n.nconst = p.nconst").select(name="n.primaryName")


@query("SELECT primaryTitle AS title, (SELECT count(*) FROM episodes_tsv e WHERE e.parentTconst = t.tconst) AS episodes FROM titles_tsv t WHERE titleType = 'tvSeries' AND starts_with(primaryTitle, 'The ')")
def series_episodes(t: Tables) -> Rel:
    """A correlated scalar subquery in a projection."""
    sub = t.episodes_tsv.alias("e").where(F.col("e.parentTconst") == F.col("t.tconst").outer()).select(F.count("*"))
    return Rel.of(t.titles_tsv, "t").when("t.titleType = 'tvSeries'", S.starts_with("t.primaryTitle", "The ")).select(title="t.primaryTitle", episodes=sub.scalar())


@query("SELECT o_orderkey FROM orders o JOIN customer c ON c_custkey = o_custkey WHERE o_totalprice = (SELECT min(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = c_custkey)")
def unnest_min(t: Tables) -> Rel:
    """Orders at their customer's least price: a correlated aggregate that Catalyst decorrelates."""
    sub = t.orders.alias("o2").where(F.col("o2.o_custkey") == F.col("c.c_custkey").outer()).select(F.min("o2.o_totalprice"))
    return Rel.of(t.customer, "c").join("o", t.orders, "c.c_custkey = o.o_custkey").when(F.col("o.o_totalprice") == sub.scalar()).select("o.o_orderkey")


@query("SELECT c_custkey AS id, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 AND c_acctbal > 1000")
def people_filters(t: Tables) -> Rel:
    return Rel.of(t.customer, "p").when("p.c_mktsegment = 'BUILDING' and p.c_nationkey = 3", S.gt(F.col("p.c_acctbal"), 1000)).select(id="p.c_custkey", bal="p.c_acctbal")


@query("SELECT b.s_suppkey AS id, b.s_nationkey AS nation FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_name LIKE '%7'")
def people_self_product(t: Tables) -> Rel:
    """Two bindings and a filter that makes the join's key."""
    return Rel.of(t.supplier, "a").bind("b", t.supplier).when(S.ends_with("a.s_name", "7"), "a.s_nationkey = b.s_nationkey").select(id="b.s_suppkey", nation="b.s_nationkey")
