"""TPC-H on the given tables, as comprehensions. The tables have no partsupp, comments, phones or receipt dates; where a
query needs them it is restated on what is there (see each query), with literals in the data's range."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.semantics import sum0
from tessera.plans.registry import Registry, Tables
from tessera.rel import Rel

registry = Registry()
query = registry.query
QUERIES, SQL = registry.QUERIES, registry.SQL

NET = "l.l_extendedprice * (1 - l.l_discount)"


def money(e: str):
    """A rounded sum of an expression."""
    return F.round(sum0(e), 2)


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2""")
def tpch_q01(t: Tables) -> Rel:
    return (
        Rel.of(t.lineitem, "l")
        .when("l.l_shipdate <= timestamp'2001-09-02'")
        .group(
            {"flag": "l.l_returnflag", "status": "l.l_linestatus"},
            sum_qty=money("l.l_quantity"), sum_base=money("l.l_extendedprice"), sum_disc=money(NET), sum_charge=money(f"{NET} * (1 + l.l_tax)"),
            avg_qty="round(avg(l.l_quantity), 4)", avg_price="round(avg(l.l_extendedprice), 4)", avg_disc="round(avg(l.l_discount), 6)", n="count(*)",
        )
        .order("flag", "status")
    )


def _partsupp(t: Tables, parts: Rel | None = None, suppliers: Rel | None = None) -> Rel:
    """Parts with their suppliers and least unit price, taken from the line items (of some parts or suppliers only)."""
    lines = Rel.of(t.lineitem, "l")
    if parts is not None:
        lines = lines.semi_join("p", parts.select("p_partkey"), "p.p_partkey = l.l_partkey")
    if suppliers is not None:
        lines = lines.semi_join("s", suppliers.select("s_suppkey"), "s.s_suppkey = l.l_suppkey")
    return lines.group({"ps_partkey": "l.l_partkey", "ps_suppkey": "l.l_suppkey"}, ps_cost="min(l.l_extendedprice / l.l_quantity)", ps_qty="sum(l.l_quantity)")


PS = "ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_cost, sum(l_quantity) AS ps_qty FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {PS}, c AS (SELECT ps.*, s_name, n_name FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_regionkey = 3), m AS (SELECT ps_partkey, min(ps_cost) AS least FROM c GROUP BY 1)
SELECT p_partkey AS partkey, s_name AS supplier, n_name AS nation, ps_cost AS cost FROM c JOIN m USING (ps_partkey) JOIN part ON p_partkey = ps_partkey WHERE ps_cost = least AND p_size = 15""")
def tpch_q02(t: Tables) -> Rel:
    """Least-cost suppliers in a region; costs from the line items, of which only those of wanted parts are grouped."""
    here = (
        _partsupp(t, Rel.of(t.part).when("p_size = 15")).join("s", t.supplier, "ps_suppkey = s.s_suppkey").join("n", t.nation, "n.n_nationkey = s.s_nationkey")
        .join("r", t.region, "r.r_regionkey = n.n_regionkey").when("r.r_regionkey = 3").select("ps_partkey", "ps_cost", "s.s_name", "n.n_name")
    )
    least = here.group({"partkey": "ps_partkey"}, least="min(ps_cost)")
    return here.join("m", least, "m.partkey = ps_partkey and ps_cost = m.least").select(partkey="ps_partkey", supplier="s_name", nation="n_name", cost="ps_cost")


@query("""SELECT l_orderkey AS orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate AS orderdate, o_orderpriority AS priority
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY 1, 3, 4 ORDER BY revenue DESC, orderkey LIMIT 10""")
def tpch_q03(t: Tables) -> Rel:
    return (
        Rel.of(t.customer, "c").when("c.c_mktsegment = 'BUILDING'")
        .join("o", t.orders, "c.c_custkey = o.o_custkey").when("o.o_orderdate < timestamp'1998-03-15'")
        .join("l", t.lineitem, "l.l_orderkey = o.o_orderkey").when("l.l_shipdate > timestamp'1998-03-15'")
        .group({"orderkey": "l.l_orderkey", "orderdate": "o.o_orderdate", "priority": "o.o_orderpriority"}, revenue=money(NET))
        .order("revenue desc", "orderkey").limit(10)
    )


@query("""SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) GROUP BY 1""")
def tpch_q04(t: Tables) -> Rel:
    """Orders with a line shipped before its order's date."""
    return (
        Rel.of(t.orders, "o").when("o.o_orderdate >= timestamp'1997-07-01' and o.o_orderdate < timestamp'1997-10-01'")
        .semi_join("l", t.lineitem, "l.l_orderkey = o.o_orderkey and l.l_shipdate < o.o_orderdate")
        .group({"priority": "o.o_orderpriority"}, n="count(*)").order("priority")
    )


@query("""SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey = 2 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1""")
def tpch_q05(t: Tables) -> Rel:
    return (
        Rel.of(t.customer, "c").join("o", t.orders, "c.c_custkey = o.o_custkey").join("l", t.lineitem, "l.l_orderkey = o.o_orderkey")
        .join("s", t.supplier, "s.s_suppkey = l.l_suppkey and s.s_nationkey = c.c_nationkey").join("n", t.nation, "n.n_nationkey = s.s_nationkey")
        .join("r", t.region, "r.r_regionkey = n.n_regionkey")
        .when("r.r_regionkey = 2", "o.o_orderdate >= timestamp'1996-01-01' and o.o_orderdate < timestamp'1997-01-01'")
        .group({"nation": "n.n_name"}, revenue=money(NET)).order("revenue desc")
    )


@query("""SELECT round(coalesce(sum(l_extendedprice * l_discount), 0), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'
AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""")
def tpch_q06(t: Tables) -> Rel:
    return (
        Rel.of(t.lineitem, "l")
        .when("l.l_shipdate >= timestamp'1996-01-01' and l.l_shipdate < timestamp'1997-01-01'", "l.l_discount between 0.045D and 0.075D", "l.l_quantity < 24")
        .select(revenue=money("l.l_extendedprice * l.l_discount"))
    )


@query("""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate)::INT AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation n1 ON n1.n_nationkey = s_nationkey JOIN nation n2 ON n2.n_nationkey = c_nationkey
WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2' OR n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1') GROUP BY 1, 2, 3""")
def tpch_q07(t: Tables) -> Rel:
    pair = "(n1.n_name = 'NATION_1' and n2.n_name = 'NATION_2' or n1.n_name = 'NATION_2' and n2.n_name = 'NATION_1')"
    return (
        Rel.of(t.supplier, "s").join("l", t.lineitem, "s.s_suppkey = l.l_suppkey").join("o", t.orders, "o.o_orderkey = l.l_orderkey")
        .join("c", t.customer, "c.c_custkey = o.o_custkey").join("n1", t.nation, "n1.n_nationkey = s.s_nationkey").join("n2", t.nation, "n2.n_nationkey = c.c_nationkey")
        .when(pair)
        .group({"supp_nation": "n1.n_name", "cust_nation": "n2.n_name", "year": "year(l.l_shipdate)"}, revenue=money(NET)).order("supp_nation", "cust_nation", "year")
    )


@query("""SELECT year(o_orderdate)::INT AS year, round(sum(CASE WHEN n2.n_name = 'NATION_1' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN region ON r_regionkey = n1.n_regionkey JOIN nation n2 ON n2.n_nationkey = s_nationkey
WHERE r_regionkey = 1 AND p_type = 'ECONOMY' GROUP BY 1""")
def tpch_q08(t: Tables) -> Rel:
    return (
        Rel.of(t.part, "p").when("p.p_type = 'ECONOMY'").join("l", t.lineitem, "p.p_partkey = l.l_partkey").join("s", t.supplier, "s.s_suppkey = l.l_suppkey")
        .join("o", t.orders, "o.o_orderkey = l.l_orderkey").join("c", t.customer, "c.c_custkey = o.o_custkey").join("n1", t.nation, "n1.n_nationkey = c.c_nationkey")
        .join("r", t.region, "r.r_regionkey = n1.n_regionkey").when("r.r_regionkey = 1").join("n2", t.nation, "n2.n_nationkey = s.s_nationkey")
        .let(volume=NET, year="year(o.o_orderdate)", nation="n2.n_name")
        .group({"year": "year"}, share="round(sum(if(nation = 'NATION_1', volume, 0D)) / sum(volume), 6)").order("year")
    )


@query(f"""WITH {PS} SELECT n_name AS nation, year(o_orderdate)::INT AS year, round(sum(l_extendedprice * (1 - l_discount) - ps_cost * l_quantity), 2) AS profit
FROM lineitem JOIN ps ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey WHERE p_name LIKE '%ring%' GROUP BY 1, 2""")
def tpch_q09(t: Tables) -> Rel:
    return (
        Rel.of(t.part, "p").when(F.col("p.p_name").contains("ring")).join("l", t.lineitem, "p.p_partkey = l.l_partkey")
        .join("ps", _partsupp(t, Rel.of(t.part).when(F.col("p_name").contains("ring"))), "ps.ps_partkey = l.l_partkey and ps.ps_suppkey = l.l_suppkey").join("s", t.supplier, "s.s_suppkey = l.l_suppkey")
        .join("o", t.orders, "o.o_orderkey = l.l_orderkey").join("n", t.nation, "n.n_nationkey = s.s_nationkey")
        .group({"nation": "n.n_name", "year": "year(o.o_orderdate)"}, profit=money(f"{NET} - ps.ps_cost * l.l_quantity")).order("nation", "year desc")
    )


@query("""SELECT c_custkey AS custkey, c_name AS name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal AS acctbal, n_name AS nation
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' GROUP BY 1, 2, 4, 5 ORDER BY revenue DESC, custkey LIMIT 20""")
def tpch_q10(t: Tables) -> Rel:
    return (
        Rel.of(t.customer, "c").join("o", t.orders, "c.c_custkey = o.o_custkey").when("o.o_orderdate >= timestamp'1997-10-01' and o.o_orderdate < timestamp'1998-01-01'")
        .join("l", t.lineitem, "l.l_orderkey = o.o_orderkey").when("l.l_returnflag = 'R'").join("n", t.nation, "n.n_nationkey = c.c_nationkey")
        .group({"custkey": "c.c_custkey", "name": "c.c_name", "acctbal": "c.c_acctbal", "nation": "n.n_name"}, revenue=money(NET))
        .order("revenue desc", "custkey").limit(20)
    )


@query(f"""WITH {PS}, v AS (SELECT ps_partkey AS partkey, sum(ps_cost * ps_qty) AS value FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey
WHERE n_name = 'NATION_7' GROUP BY 1) SELECT partkey, round(value, 2) AS value FROM v WHERE value > (SELECT sum(value) * 0.001 FROM v)""")
def tpch_q11(t: Tables) -> Rel:
    here = Rel.of(t.supplier).semi_join("n", Rel.of(t.nation).when("n_name = 'NATION_7'"), "n.n_nationkey = s_nationkey")
    held = _partsupp(t, suppliers=here).group({"partkey": "ps_partkey"}, value="sum(ps_cost * ps_qty)")
    bound = held.select(bound="sum(value) * 0.001D").df.scalar()
    return held.when(F.col("value") > bound).select("partkey", value="round(value, 2)").order("value desc")


@query("""SELECT l_linestatus AS status, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high,
sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate < o_orderdate AND year(l_shipdate) = 1998 GROUP BY 1""")
def tpch_q12(t: Tables) -> Rel:
    """Priorities of returned lines shipped before the order's date."""
    return (
        Rel.of(t.lineitem, "l").when("l.l_returnflag in ('A', 'R')", "l.l_shipdate >= timestamp'1998-01-01' and l.l_shipdate < timestamp'1999-01-01'").join("o", t.orders, "o.o_orderkey = l.l_orderkey").when("l.l_shipdate < o.o_orderdate")
        .let(urgent="o.o_orderpriority in ('1-URGENT', '2-HIGH')")
        .group({"status": "l.l_linestatus"}, high="sum(if(urgent, 1, 0))", low="sum(if(urgent, 0, 1))").order("status")
    )


@query("""SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY 1) GROUP BY 1""")
def tpch_q13(t: Tables) -> Rel:
    return (
        Rel.of(t.customer, "c").left_join("o", t.orders, "c.c_custkey = o.o_custkey and o.o_orderpriority <> '1-URGENT'")
        .group({"custkey": "c.c_custkey"}, c_count="count(o.o_orderkey)").group({"c_count": "c_count"}, custdist="count(*)").order("custdist desc", "c_count desc")
    )


@query("""SELECT round(100 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'""")
def tpch_q14(t: Tables) -> Rel:
    return (
        Rel.of(t.lineitem, "l").when("l.l_shipdate >= timestamp'1995-09-01' and l.l_shipdate < timestamp'1995-10-01'").join("p", t.part, "p.p_partkey = l.l_partkey")
        .select(promo=f"round(100 * sum(if(p.p_type = 'PROMO', {NET}, 0D)) / sum({NET}), 6)")
    )


@query("""WITH r AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1)
SELECT s_suppkey AS suppkey, s_name AS name, total FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r)""")
def tpch_q15(t: Tables) -> Rel:
    revenue = Rel.of(t.lineitem, "l").when("l.l_shipdate >= timestamp'1996-01-01' and l.l_shipdate < timestamp'1996-04-01'").group({"suppkey": "l.l_suppkey"}, total=money(NET))
    most = revenue.select(most="max(total)").df.scalar()
    return Rel.of(t.supplier, "s").join("r", revenue.when(F.col("total") == most), "s.s_suppkey = r.suppkey").select("r.suppkey", name="s.s_name", total="r.total")


@query(f"""WITH {PS} SELECT p_brand AS brand, p_type AS type, p_size AS size, count(DISTINCT ps_suppkey) AS suppliers FROM ps JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#3' AND p_type NOT IN ('PROMO') AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3""")
def tpch_q16(t: Tables) -> Rel:
    """Suppliers of parts; those in debt stand for those with complaints. Only lines of wanted parts are looked at."""
    return (
        Rel.of(t.lineitem, "l").join("p", Rel.of(t.part).when("p_brand <> 'Brand#3' and p_type <> 'PROMO' and p_size in (3, 9, 14, 19, 23, 36, 45, 49)"), "p.p_partkey = l.l_partkey")
        .anti_join("s", Rel.of(t.supplier).when("s_acctbal < 0"), "s.s_suppkey = l.l_suppkey")
        .group({"brand": "p.p_brand", "type": "p.p_type", "size": "p.p_size"}, suppliers="count(distinct l.l_suppkey)").order("suppliers desc", "brand", "type", "size")
    )


@query("""SELECT round(coalesce(sum(l_extendedprice), 0) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand IN ('Brand#23', 'Brand#12') AND l_quantity < (SELECT 0.4 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""")
def tpch_q17(t: Tables) -> Rel:
    """Lines of the wanted parts alone are grouped and joined."""
    wanted = Rel.of(t.part).when("p_brand in ('Brand#23', 'Brand#12')")
    usual = Rel.of(t.lineitem, "x").semi_join("p", wanted, "p.p_partkey = x.l_partkey").group({"partkey": "x.l_partkey"}, bound="0.4D * avg(x.l_quantity)")
    return (
        Rel.of(t.lineitem, "l").semi_join("p", wanted, "p.p_partkey = l.l_partkey").join("u", usual, "u.partkey = l.l_partkey")
        .when("l.l_quantity < u.bound").select(avg_yearly=F.round(sum0("l.l_extendedprice") / 7.0, 4))
    )


@query("""SELECT c_name AS name, c_custkey AS custkey, o_orderkey AS orderkey, o_orderdate AS orderdate, round(o_totalprice, 2) AS total, sum(l_quantity) AS qty FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 300) GROUP BY 1, 2, 3, 4, 5 ORDER BY total DESC, orderkey LIMIT 100""")
def tpch_q18(t: Tables) -> Rel:
    large = Rel.of(t.lineitem, "x").group({"orderkey": "x.l_orderkey"}, qty="sum(x.l_quantity)").when("qty > 300")
    return (
        Rel.of(t.orders, "o").join("b", large, "b.orderkey = o.o_orderkey").join("c", t.customer, "c.c_custkey = o.o_custkey")
        .select(name="c.c_name", custkey="c.c_custkey", orderkey="o.o_orderkey", orderdate="o.o_orderdate", total="round(o.o_totalprice, 2)", qty="b.qty").order("total desc", "orderkey").limit(100)
    )


@query("""SELECT round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE
(p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""")
def tpch_q19(t: Tables) -> Rel:
    any_of = """(p.p_brand = 'Brand#12' and l.l_quantity between 1 and 11 and p.p_size between 1 and 5)
        or (p.p_brand = 'Brand#23' and l.l_quantity between 10 and 20 and p.p_size between 1 and 10)
        or (p.p_brand = 'Brand#4' and l.l_quantity between 20 and 30 and p.p_size between 1 and 15)"""
    return Rel.of(t.lineitem, "l").join("p", t.part, "p.p_partkey = l.l_partkey").when(any_of).select(revenue=money(NET))


@query(f"""WITH {PS} SELECT s_name AS name, s_suppkey AS suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 3 AND s_suppkey IN (SELECT ps_suppkey FROM ps
WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%') AND ps_qty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND year(l_shipdate) = 1997))""")
def tpch_q20(t: Tables) -> Rel:
    wanted = Rel.of(t.part).when("p_name like 'small%'")
    shipped = (
        Rel.of(t.lineitem, "x").when("x.l_shipdate >= timestamp'1997-01-01' and x.l_shipdate < timestamp'1998-01-01'")
        .semi_join("p", wanted, "p.p_partkey = x.l_partkey").group({"partkey": "x.l_partkey"}, half="0.5D * sum(x.l_quantity)")
    )
    excess = _partsupp(t, wanted).join("h", shipped, "h.partkey = ps_partkey").when("ps_qty > h.half")
    return (
        Rel.of(t.supplier, "s").join("n", t.nation, "n.n_nationkey = s.s_nationkey").when("n.n_regionkey = 3").semi_join("e", excess.select("ps_suppkey"), "e.ps_suppkey = s.s_suppkey")
        .select(name="s.s_name", suppkey="s.s_suppkey").order("name")
    )


@query("""SELECT s_name AS name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON n_nationkey = s_nationkey
WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate AND n_regionkey = 3
AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate) GROUP BY 1 ORDER BY numwait DESC, name LIMIT 100""")
def tpch_q21(t: Tables) -> Rel:
    """Suppliers that alone kept an order waiting: the only late line of an order with several suppliers."""
    return (
        Rel.of(t.supplier, "s").join("l1", t.lineitem, "s.s_suppkey = l1.l_suppkey").join("o", t.orders, "o.o_orderkey = l1.l_orderkey").when("o.o_orderstatus = 'F' and l1.l_shipdate > o.o_orderdate")
        .join("n", t.nation, "n.n_nationkey = s.s_nationkey").when("n.n_regionkey = 3")
        .semi_join("l2", t.lineitem, "l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey")
        .anti_join("l3", t.lineitem, "l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_shipdate > o.o_orderdate")
        .group({"name": "s.s_name"}, numwait="count(*)").order("numwait desc", "name").limit(100)
    )


@query("""SELECT c_nationkey AS nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_nationkey IN (13, 17, 18, 23, 29, 30, 31)
AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (13, 17, 18, 23, 29, 30, 31))
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1""")
def tpch_q22(t: Tables) -> Rel:
    """Customers with money and without a recent order; nations stand for phone prefixes."""
    some = Rel.of(t.customer, "c").when("c.c_nationkey in (13, 17, 18, 23, 29, 30, 31)")
    usual = some.when("c.c_acctbal > 0").select(a="avg(c.c_acctbal)").df.scalar()
    return (
        some.when(F.col("c.c_acctbal") > usual).anti_join("o", Rel.of(t.orders).when("o_orderdate >= timestamp'2000-01-01'"), "o.o_custkey = c.c_custkey")
        .group({"nationkey": "c.c_nationkey"}, numcust="count(*)", totacctbal=money("c.c_acctbal")).order("nationkey")
    )
