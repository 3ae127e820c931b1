"""TPC-H 1 to 22 over the driver's tables.

Columns that these tables lack are left out or replaced by ones they have (partsupp by the parts and suppliers
of line items), and dates are moved into the tables' range. q1 and q6 are written with the DataFrame API; the
others are SQL that Spark and the checking engine read alike."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..sources.tables import TABLES, Tables, register_views

MONEY = "CAST({0} AS DECIMAL(15,2))"


def m(x: str) -> str:
    return MONEY.format(x)


#: A discounted price, within 18 digits, so that it stays a long; prices are below a million.
PRICE = "CAST(l_extendedprice AS DECIMAL(8,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))"


def ps(where: str = "true") -> str:
    """What stands for partsupp: the parts and suppliers of line items that a query wants, filtered before they are grouped."""
    return f"(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(CAST(l_extendedprice AS DECIMAL(15,2))) AS ps_supplycost, CAST(sum(l_quantity) AS BIGINT) AS ps_availqty FROM lineitem WHERE {where} GROUP BY l_partkey, l_suppkey)"


def parts(where: str) -> str:
    return f"l_partkey IN (SELECT p_partkey FROM part WHERE {where})"


day = lambda c: f"CAST({c} AS DATE)"
num = lambda x: f"CAST({x} AS DOUBLE)"

SQL = {
    "tpch_q02": f"""
        WITH ps AS {ps(parts("p_size = 15"))}
        SELECT s_acctbal, s_name, n_name, p_partkey, {num('ps_supplycost')} AS supplycost
        FROM part JOIN ps ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE p_size = 15 AND r_name = 'EUROPE'
          AND ps_supplycost = (SELECT min(b.ps_supplycost) FROM ps b, supplier s2, nation n2, region r2 WHERE b.ps_partkey = p_partkey AND s2.s_suppkey = b.ps_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q03": f"""
        SELECT l_orderkey, {num(f'sum({PRICE})')} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, CAST(o_orderdate AS DATE) ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q04": """
        SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-07-01' + INTERVAL '3' MONTH
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '30' DAY)
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q05": f"""
        SELECT n_name, {num(f'sum({PRICE})')} AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
        GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "tpch_q07": f"""
        SELECT supp_nation, cust_nation, l_year, {num('sum(volume)')} AS revenue
        FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS l_year, {PRICE} AS volume
              FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
              WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q08": f"""
        SELECT o_year, round({num("sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END)")} / {num('sum(volume)')}, 6) AS mkt_share
        FROM (SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, {PRICE} AS volume, n2.n_name AS nation
              FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
              WHERE r_name = 'AMERICA' AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND p_type = 'ECONOMY') AS all_nations
        GROUP BY o_year ORDER BY o_year""",
    "tpch_q09": f"""
        WITH ps AS {ps(parts("p_name LIKE '%widget%'"))}
        SELECT nation, o_year, {num('sum(amount)')} AS sum_profit
        FROM (SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, CAST({PRICE} - CAST(ps_supplycost * {m('l_quantity')} AS DECIMAL(38,4)) / 10 AS DECIMAL(38,6)) AS amount
              FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
              WHERE p_name LIKE '%widget%') AS profit
        GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "tpch_q10": f"""
        SELECT c_custkey, c_name, {num(f'sum({PRICE})')} AS revenue, c_acctbal, n_name
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R'
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
        WITH ps AS {ps("l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')")}, own AS (SELECT ps_partkey, sum(CAST(ps_supplycost * ps_availqty AS DECIMAL(38,2))) AS v FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' GROUP BY ps_partkey)
        SELECT ps_partkey, {num('v')} AS value FROM own WHERE {num('v')} > (SELECT 1.5 * avg({num('v')}) FROM own) ORDER BY value DESC, ps_partkey""",
    "tpch_q12": """
        SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'
        GROUP BY l_returnflag ORDER BY l_returnflag""",
    "tpch_q13": """
        SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": f"""
        SELECT round(100 * {num(f"sum(CASE WHEN p_type LIKE 'PROMO%' THEN {PRICE} ELSE 0 END)")} / {num(f'sum({PRICE})')}, 6) AS promo_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""",
    "tpch_q15": f"""
        WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({PRICE}) AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, {num('total_revenue')} AS total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": f"""
        WITH ps AS {ps(parts("p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)"))}
        SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON p_partkey = ps_partkey
        WHERE p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": f"""
        SELECT round({num(f"sum({m('l_extendedprice')})")} / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_brand = 'Brand#12' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": f"""
        SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, {num('qty')} AS sum_qty
        FROM (SELECT l_orderkey, sum({m('l_quantity')}) AS qty FROM lineitem GROUP BY l_orderkey HAVING sum({m('l_quantity')}) > 200) AS big
        JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
        SELECT {num(f'sum({PRICE})')} AS revenue FROM lineitem, part
        WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 25)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 40)""",
    "tpch_q20": f"""
        WITH ps AS {ps(parts("p_name LIKE '%widget%'"))}
        SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE n_regionkey = 1 AND s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%widget%')
              AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1998-01-01'))
        ORDER BY s_name, s_suppkey""",
    "tpch_q21": """
        SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY AND n_regionkey = 2
          AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate + INTERVAL '60' DAY)
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": f"""
        SELECT c_nationkey, count(*) AS numcust, {num(f"sum({m('c_acctbal')})")} AS totacctbal FROM customer
        WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND c_nationkey IN (1, 3, 5, 7, 9, 11, 13))
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
        GROUP BY c_nationkey ORDER BY c_nationkey""",
}


def sql_query(text: str):
    """A query of SQL text over the tables it names; the plan is bound to their folder when the query is made."""
    import re

    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark, sf_dir):
        register_views(spark, sf_dir, names)
        return spark.sql(text)

    return run


def exact(x, scale: int):
    """The sum of whole numbers that stand for decimals of this scale, as a double. Upper and lower bits are added up
    apart, so that both sums stay longs however many rows there are."""
    high, low = F.sum(F.shiftright(x, 20)).cast("decimal(22,0)"), F.sum(x.bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(22,0)")
    return ((high * F.lit(1 << 20).cast("decimal(7,0)") + low).cast("decimal(31,0)") * F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale},{scale})")).cast("double")


def q1(spark, sf_dir):
    """Pricing summary: one scan of seven columns, partial aggregates of longs before the only exchange."""
    cents = lambda x: F.round(F.col(x) * 100).cast("long")
    quantity, price, discount, tax = (cents(f"l_{x}") for x in ("quantity", "extendedprice", "discount", "tax"))
    disc = price * (100 - discount)
    n = F.count(F.lit(1))
    return (
        Tables(spark, sf_dir).lineitem.where("l_shipdate <= DATE '2001-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            exact(quantity, 2).alias("sum_qty"), exact(price, 2).alias("sum_base_price"), exact(disc, 4).alias("sum_disc_price"), exact(disc * (100 + tax), 6).alias("sum_charge"),
            F.round(exact(quantity, 2) / n, 4).alias("avg_qty"), F.round(exact(price, 2) / n, 4).alias("avg_price"), F.round(exact(discount, 2) / n, 4).alias("avg_disc"), n.alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def q6(spark, sf_dir):
    """Revenue change: every predicate reaches the scan."""
    li = Tables(spark, sf_dir).lineitem
    some = li.where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 24) & F.col("l_discount").between(0.045, 0.075))
    return some.agg(F.sum((F.col("l_extendedprice").cast("decimal(15,2)") * F.col("l_discount").cast("decimal(15,2)")).cast("decimal(38,4)")).cast("double").alias("revenue"))


QUERIES = {"tpch_q01": q1, "tpch_q06": q6} | {name: sql_query(text) for name, text in SQL.items()}
QUERIES = dict(sorted(QUERIES.items()))

ORACLE_SQL = SQL | {
    "tpch_q01": f"""
        SELECT l_returnflag, l_linestatus, {num(f"sum({m('l_quantity')})")} AS sum_qty, {num(f"sum({m('l_extendedprice')})")} AS sum_base_price, {num(f'sum({PRICE})')} AS sum_disc_price, {num(f"sum({PRICE} * (CAST(1 AS DECIMAL(3,2)) + CAST(l_tax AS DECIMAL(3,2))))")} AS sum_charge,
               round({num(f"sum({m('l_quantity')})")} / count(*), 4) AS avg_qty, round({num(f"sum({m('l_extendedprice')})")} / count(*), 4) AS avg_price, round({num(f"sum({m('l_discount')})")} / count(*), 4) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q06": f"SELECT {num(f'''sum(CAST({m('l_extendedprice')} * {m('l_discount')} AS DECIMAL(38,4)))''')} AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity < 24 AND l_discount BETWEEN 0.045 AND 0.075",
}
