"""A query for each item of the operator inventory, with SQL that gives the same rows.

Sums of money are exact decimals handed out as doubles, and rounded where the result isn't exact, so that two
engines agree to the last digit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import relational as R
from ..operators.vector_index import IvfFlat, knn, knn_join
from ..sources.tables import Tables
from .tpch import sql_query

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of Tables under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def same(name: str, sql: str) -> None:
    """Register SQL that both engines read alike."""
    QUERIES[name] = sql_query(sql)
    ORACLE_SQL[name] = sql


def money(x):
    return F.col(x).cast("decimal(15,2)")


# -- scans, projections, sources ------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_qty, l_returnflag AS flag FROM lineitem")
def scan_project(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("double_qty"), F.col("l_returnflag").alias("flag"))


@query("SELECT count(*) AS n FROM orders")
def scan_no_columns(t):
    return t.orders.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def scan_key_range(t):
    """The range reaches the scan, which skips row groups by their statistics."""
    return t.orders.where("o_orderkey >= 100 AND o_orderkey < 300").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def scan_sorted(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(500)


same("scan_values", "SELECT * FROM (VALUES (1, 'a', CAST(1.5 AS DOUBLE)), (2, 'b', CAST(NULL AS DOUBLE)), (3, NULL, CAST(2.5 AS DOUBLE))) AS v (id, name, x)")
same("scan_dummy", "SELECT 1 + 1 AS two, 'x' AS letter")
same("scan_empty", "SELECT n_nationkey, n_name FROM nation WHERE 1 = 0")


def _nation_csv(spark, sf_dir):
    """nation as delimited text in the shared folder, read back with an explicit schema."""
    from ..sources.tables import read_delimited, write_delimited

    nation = Tables(spark, sf_dir).nation
    path = shared_path(spark, "nation-csv")
    write_delimited(nation, path, delimiter="|")
    return read_delimited(spark, path, nation.schema, delimiter="|")


def shared_path(spark, label: str) -> str:
    """A new path in the folder that all executors see."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


QUERIES["scan_csv_roundtrip"] = _nation_csv
ORACLE_SQL["scan_csv_roundtrip"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


# -- predicates -----------------------------------------------------------------------------------------------

same("filter_compare", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag <> 'N' AND l_partkey < 500 AND l_linenumber != 3")
same("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 100 AND 5000")
same("filter_in_list", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#23') AND p_size NOT IN (1, 2, 3)")
same("filter_like", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%widget%' AND p_type NOT LIKE 'PRO%' AND p_brand LIKE 'Brand#_'")
same("filter_is_null", "SELECT o.o_orderkey, l.l_partkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45 WHERE l.l_partkey IS NULL")
same("filter_not_null", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL")
same("filter_and_or_null", "SELECT a, b, a AND b AS both_true, a OR b AS either, NOT a AS negated FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) AS x (a), (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) AS y (b)")
same("filter_common_predicate", "SELECT p_partkey, p_brand, p_size FROM part WHERE (p_size > 10 AND p_brand = 'Brand#12') OR (p_size > 10 AND p_type = 'PROMO')")
same("filter_contradiction", "SELECT o_orderkey FROM orders WHERE o_orderkey > 10 AND o_orderkey < 5")


@query("SELECT o_orderkey, o_orderstatus, (o_orderstatus = 'O') <> (o_totalprice > 100000) AS exclusive FROM orders")
def filter_xor(t):
    return t.orders.select("o_orderkey", "o_orderstatus", S.xor(F.col("o_orderstatus") == "O", F.col("o_totalprice") > 100000).alias("exclusive"))


# -- expressions ----------------------------------------------------------------------------------------------

same("expr_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
same("expr_case_operand", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders")
same("expr_cast_matrix", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS as_double, CAST(o_orderkey AS STRING) AS as_text, CAST(o_orderkey % 2 AS BOOLEAN) AS as_bool, CAST(CAST(o_orderkey AS STRING) AS INT) AS back, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day_text, CAST('2020-02-29' AS DATE) AS leap, CAST(o_orderkey AS DECIMAL(20,2)) AS as_decimal, CAST(true AS INT) AS one FROM orders")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_linenumber - 3, 0), 6) AS per_line FROM lineitem")
def expr_safe_div(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.safe_div("l_extendedprice", F.col("l_linenumber") - 3), 6).alias("per_line"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_partkey // nullif(l_linenumber - 1, 0) AS quotient FROM lineitem")
def expr_int_div(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", S.int_div("l_partkey", F.col("l_linenumber") - 1).alias("quotient"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_partkey % nullif(l_linenumber - 1, 0) AS remainder FROM lineitem")
def expr_mod(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", S.safe_mod("l_partkey", F.col("l_linenumber") - 1).alias("remainder"))


same("expr_neg", "SELECT c_custkey, -c_acctbal AS negated, +c_custkey AS same_key, - (c_custkey - 5) AS off FROM customer")
same("expr_arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS b, l_partkey * l_linenumber AS c, (l_partkey + 1) * (l_suppkey - 1) AS d FROM lineitem")
same("str_concat", "SELECT c_custkey, c_name || ' / ' || c_mktsegment AS label, c_name || CAST(NULL AS STRING) AS nothing FROM customer")


@query("SELECT p_partkey, substring(p_name, 1, 5) AS head, substring(p_name, 3, 1000000) AS tail, substring(p_name, -4, 3) AS near_end FROM part")
def str_substring(t):
    s = S.substring_from_for
    return t.part.select("p_partkey", s("p_name", 1, 5).alias("head"), s("p_name", 3, 1000000).alias("tail"), s("p_name", -4, 3).alias("near_end"))


STARTS, LENGTHS = (-7, -1, 0, 1, 3, 9), (-3, 0, 2, 8)


@query("SELECT s, a, b, substring(s, a, b) AS part FROM (VALUES ('hello'), (''), ('añ😀z')) AS x (s), (VALUES (-7), (-1), (0), (1), (3), (9)) AS y (a), (VALUES (-3), (0), (2), (8)) AS z (b)")
def str_substring_edges(t):
    spark = t._spark
    x = spark.createDataFrame([("hello",), ("",), ("añ\U0001f600z",)], "s string")
    rows = x.select("s", F.explode(F.array(*[F.lit(a) for a in STARTS])).alias("a")).select("s", "a", F.explode(F.array(*[F.lit(b) for b in LENGTHS])).alias("b"))
    return rows.withColumn("part", S.substring_from_for("s", F.col("a"), F.col("b")))


same("str_replace", "SELECT p_partkey, replace(p_name, 'a', 'AA') AS swapped, replace(p_type, 'O', '') AS dropped FROM part")
same("str_repeat", "SELECT p_partkey, repeat(p_type, 2) AS twice, repeat(p_type, 0) AS none FROM part")


@query("SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS INT) AS d FROM orders")
def date_extract(t):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))


same("date_plus_interval", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL '1' MONTH AS DATE) AS next_month, CAST(CAST(o_orderdate AS DATE) + INTERVAL '90' DAY AS DATE) AS later FROM orders")
same("date_minus_interval", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL '1' YEAR AS DATE) AS year_before, CAST(DATE '1970-03-31' - INTERVAL '1' MONTH AS DATE) AS clamped FROM orders")
same("ts_filter", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' OR ts < TIMESTAMP '2023-06-01 12:30:00'")

# -- joins ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return R.join(t.orders, t.customer, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_partkey FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 48) AS l ON o_orderkey = l_orderkey")
def join_left(t):
    return R.join(t.orders, t.lineitem.where("l_quantity > 48"), [("o_orderkey", "l_orderkey")], "left").select("o_orderkey", "l_partkey")


@query("SELECT l_partkey, o_orderkey FROM (SELECT * FROM lineitem WHERE l_quantity > 48) AS l RIGHT JOIN orders ON o_orderkey = l_orderkey")
def join_right(t):
    return R.join(t.lineitem.where("l_quantity > 48"), t.orders, [("l_orderkey", "o_orderkey")], "right").select("l_partkey", "o_orderkey")


@query("SELECT a.doc_id AS doc, b.doc_id AS labelled FROM (SELECT doc_id FROM documents WHERE lang = 'en') AS a FULL JOIN (SELECT doc_id FROM labels WHERE quality = 1) AS b ON a.doc_id = b.doc_id")
def join_full(t):
    a, b = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("doc")), t.labels.where("quality = 1").select(F.col("doc_id").alias("labelled"))
    return R.join(a, b, [("doc", "labelled")], "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return R.join(t.region, t.nation, how="cross").select("r_name", "n_name")


@query("SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey GROUP BY a.l_orderkey, a.l_linenumber")
def join_multi_key(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return t.lineitem.select(*keys).join(t.lineitem.select(*keys), keys).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")
def join_equi_residual(t):
    o, li = t.orders, t.lineitem
    return R.join(o, li, [("o_orderkey", "l_orderkey")], residual=li.l_extendedprice > o.o_totalprice / 2).select("o_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")
def join_left_residual(t):
    o, li = t.orders, t.lineitem
    return R.join(o, li, [("o_orderkey", "l_orderkey")], "left", residual=li.l_extendedprice > o.o_totalprice / 2).select("o_orderkey", "l_partkey")


@query("SELECT a.s_suppkey, b.n_nationkey FROM supplier a JOIN nation b ON a.s_nationkey < b.n_nationkey")
def join_theta(t):
    s, n = t.supplier, t.nation
    return R.join(s, n, residual=s.s_nationkey < n.n_nationkey).select("s_suppkey", "n_nationkey")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_nationkey < r_regionkey")
def join_left_theta(t):
    n, r = t.nation, t.region
    return R.join(n, r, how="left", residual=n.n_nationkey < r.r_regionkey).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation FULL JOIN region ON n_nationkey + 20 < r_regionkey * 10")
def join_full_theta(t):
    n, r = t.nation, t.region
    return R.join(n, r, how="full", residual=n.n_nationkey + 20 < r.r_regionkey * 10).select("n_name", "r_name")


@query("SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def join_semi(t):
    return R.join(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"], "semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(t):
    return R.join(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], "anti").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)")
def join_semi_residual(t):
    c, o = t.customer, t.orders
    return R.join(c, o, [("c_custkey", "o_custkey")], "semi", residual=o.o_totalprice > c.c_acctbal * 40).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti_residual(t):
    c, o = t.customer, t.orders
    return R.join(c, o, [("c_custkey", "o_custkey")], "anti", residual=o.o_orderpriority == "1-URGENT").select("c_custkey")


@query("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey * 5 > n_nationkey)")
def join_semi_theta(t):
    n, r = t.nation, t.region
    return R.join(n, r, how="semi", residual=r.r_regionkey * 5 > n.n_nationkey).select("n_name")


@query("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey * 5 > n_nationkey)")
def join_anti_theta(t):
    n, r = t.nation, t.region
    return R.join(n, r, how="anti", residual=r.r_regionkey * 5 > n.n_nationkey).select("n_name")


same("join_self", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_merge_hint(t):
    return R.join(t.orders, t.customer, [("o_custkey", "c_custkey")], hint="merge").select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_hash_hint(t):
    return R.join(t.orders, t.customer, [("o_custkey", "c_custkey")], hint="shuffle_hash").select("o_orderkey", "c_mktsegment")


@query("SELECT a.x AS ax, b.x AS bx FROM (VALUES (1), (NULL), (2)) AS a (x) JOIN (VALUES (1), (NULL), (3)) AS b (x) ON a.x IS NOT DISTINCT FROM b.x")
def join_null_safe(t):
    a, b = (t._spark.createDataFrame(rows, f"{n} int") for n, rows in (("ax", [(1,), (None,), (2,)]), ("bx", [(1,), (None,), (3,)])))
    return R.join(a, b, [("ax", "bx")], null_safe=True)


# -- aggregates -----------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS first_day, max(l_quantity) AS most, round(avg(l_linenumber), 4) AS mean FROM lineitem")
def agg_simple(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"), F.min("l_shipdate").alias("first_day"), F.max("l_quantity").alias("most"), F.round(A.average("l_linenumber"), 4).alias("mean"))


@query("SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_suppkey")
def agg_hash(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("total"))


@query("SELECT o_custkey, min(o_orderpriority) AS least, max(o_orderstatus) AS most FROM orders GROUP BY o_custkey")
def agg_sort(t):
    """Text in the aggregate makes Spark sort and stream the groups."""
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("least"), F.max("o_orderstatus").alias("most"))


same("agg_count_star", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
same("agg_count_column", "SELECT d.lang, count(l.toxic) AS labelled, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
same("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")


@query("SELECT count(DISTINCT x) + max(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS n FROM (VALUES (1), (NULL), (2), (1)) AS v (x)")
def agg_count_distinct_with_null(t):
    return t._spark.createDataFrame([(1,), (None,), (2,), (1,)], "x int").agg(A.count_distinct_with_null("x").alias("n"))


@query("SELECT p_brand, round(avg(p_size), 4) AS mean_size, round(avg(CAST(p_retailprice AS DECIMAL(15,2))), 4) AS mean_price FROM part GROUP BY p_brand")
def agg_avg(t):
    return t.part.groupBy("p_brand").agg(F.round(A.average("p_size"), 4).alias("mean_size"), F.round(F.avg(money("p_retailprice")).cast("double"), 4).alias("mean_price"))


same("agg_min_max", "SELECT lang, min(source) AS a, max(source) AS b, min(n_chars) AS c, max(n_chars) AS d FROM documents GROUP BY lang")
same("agg_sum_distinct", "SELECT p_type, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part GROUP BY p_type")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority, arg_max(o_orderpriority, o_orderkey) AS last_priority FROM orders GROUP BY o_custkey")
def agg_first_last(t):
    return t.orders.groupBy("o_custkey").agg(A.first_by("o_orderpriority", "o_orderkey").alias("first_priority"), A.last_by("o_orderpriority", "o_orderkey").alias("last_priority"))


same("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 50000")
same("agg_having_global", "SELECT count(*) AS n FROM orders HAVING count(*) > 1")
same("agg_group_expr", "SELECT o_orderkey % 7 AS bucket, count(*) AS n FROM orders GROUP BY o_orderkey % 7")
same("agg_group_alias", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY y")
same("agg_empty_input", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
same("agg_null_group", "SELECT l.toxic, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic")
same("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t):
    return R.distinct_on(t.orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag")
def agg_salted(t):
    return A.salted_sum(t.lineitem.select("l_returnflag", money("l_quantity").alias("v")), ["l_returnflag"], "v", "q").select("l_returnflag", F.col("q").cast("double").alias("q"))


# -- windows, orders ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def win_row_number(t):
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("rn"))


@query("SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders")
def win_running_sum(t):
    o = t.orders.select("o_custkey", "o_orderkey", money("o_totalprice").alias("v"))
    return R.running(o, "v", "running", [F.col("o_orderkey")], ["o_custkey"]).select("o_custkey", "o_orderkey", F.col("running").cast("double").alias("running"))


same("win_partition_total", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last_key FROM orders")
same("win_expr_over", "SELECT o_orderkey, o_orderkey * 10 - min(o_orderkey) OVER (PARTITION BY o_custkey) AS gap FROM orders")
same("win_after_group", "SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS place FROM orders GROUP BY o_custkey")
same("win_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before_it FROM orders")
same("sort_multi", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey DESC")
same("sort_nulls", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS FIRST, d.doc_id")
same("limit_offset", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def topn(t):
    return R.top_n(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 5)


same("sort_alias", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC, o_orderkey LIMIT 15")

# -- sub-queries, CTEs, views, set operations -----------------------------------------------------------------

same("cte", "WITH big (k, v) AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT count(*) AS n, max(v) AS most FROM big")
same("cte_chain", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS customers FROM a GROUP BY n) SELECT x.n, x.customers FROM b x JOIN b y ON x.n = y.n")
same("derived_alias", "SELECT q.a, q.b FROM (SELECT n_nationkey, n_name FROM nation) AS q (a, b) WHERE q.a > 10")
same("sub_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
same("sub_scalar_corr", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
same("sub_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
same("sub_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
same("sub_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
same("sub_not_in", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
same("sub_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 1500.0 * 1.5 FROM orders)")
same("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
same("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
same("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
same("set_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
same("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
same("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")


def _view_shared(spark, sf_dir):
    """A view used twice: its exchange is computed once and reused."""
    Tables(spark, sf_dir).lineitem.groupBy("l_suppkey").agg(F.sum(money("l_extendedprice")).alias("total")).createOrReplaceTempView("lode_revenue")
    return spark.sql("SELECT l_suppkey, CAST(total AS DOUBLE) AS total FROM lode_revenue WHERE total = (SELECT max(total) FROM lode_revenue)")


QUERIES["view_shared"] = _view_shared
ORACLE_SQL["view_shared"] = "WITH r AS (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS total FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, CAST(total AS DOUBLE) AS total FROM r WHERE total = (SELECT max(total) FROM r)"

# -- vectors --------------------------------------------------------------------------------------------------

ORIGIN = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _with_origin(t):
    e = t.embeddings
    return e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("origin"))))  # one row


@query("SELECT e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), 6) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS o")
def vec_l2(t):
    return _with_origin(t).select("vec_id", F.round(S.l2_distance("embedding", "origin"), 6).alias("d"))


@query("SELECT e.vec_id, round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), 6) + 0.0 AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS o WHERE e.vec_id <> 0")
def vec_cosine(t):
    return _with_origin(t).where("vec_id <> 0").select("vec_id", (F.round(S.cosine_distance("embedding", "origin"), 6) + F.lit(0.0)).alias("d"))


@query("SELECT e.vec_id, round(list_negative_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), 6) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS o")
def vec_neg_ip(t):
    return _with_origin(t).select("vec_id", F.round(S.negative_inner_product("embedding", "origin"), 6).alias("d"))


QUERY_VECTOR = [round(((7 * k) % 11 - 5) / 10, 1) for k in range(64)]


@query(f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
def vec_knn(t):
    return knn(t.embeddings.select("vec_id", "embedding"), "embedding", QUERY_VECTOR, 10, "l2", "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT q.vec_id AS query_id, e.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) <= 5")
def vec_knn_join(t):
    e = t.embeddings
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return knn_join(queries, e, "query_id", "qv", "vec_id", "embedding", 5).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT vec_id FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])), vec_id LIMIT 10")
def vec_ivfflat(t):
    """With all lists probed the index gives the exact answer; tests measure the recall of fewer."""
    return IvfFlat.build(t.embeddings.select("vec_id", "embedding"), "embedding", 8).search(QUERY_VECTOR, 10, 8, "vec_id").select("vec_id")


# -- the statement engine -------------------------------------------------------------------------------------


def engine_query(name: str, statements: str, tables: tuple[str, ...], oracle: str | None) -> None:
    """Statements of the dialect over the driver's tables; the last one's rows are the result."""

    def run(spark, sf_dir):
        from ..engine import Column, Engine, Table

        e = Engine(spark, shared_path(spark, "engine"))
        for n in tables:
            df = getattr(Tables(spark, sf_dir), n)
            df.createOrReplaceTempView(n)
            e.tables[n] = Table("postgres", n, [Column(f.name, "text") for f in df.schema.fields], "", True)
        return [e.run(line) for line in statements.splitlines()][-1][-1]

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle


engine_query("udf_positional", "create function lode_add_p(int, int) returns int language sql as 'select $1 + $2'; select o_orderkey, lode_add_p(cast(o_orderkey as int), 5) as v from orders", ("orders",), "SELECT o_orderkey, CAST(o_orderkey + 5 AS INT) AS v FROM orders")
engine_query("udf_named", "create function lode_scale(x double, f double) returns double language sql as $$ select x * f $$; select o_orderkey, lode_scale(o_totalprice, 2) as v from orders", ("orders",), "SELECT o_orderkey, o_totalprice * 2 AS v FROM orders")
engine_query("udf_nested", "create function lode_inc(a int) returns int language sql return a + 1; create function lode_inc2(a int) returns int language sql return lode_inc(lode_inc($1)); select n_nationkey, lode_inc2(n_nationkey) as v from nation", ("nation",), "SELECT n_nationkey, n_nationkey + 2 AS v FROM nation")
engine_query("dml_insert_select", "create table t (a bigint primary key, b text, c int); insert into t select n_nationkey, n_name, n_regionkey from nation; select a, b, c from t", ("nation",), "SELECT CAST(n_nationkey AS BIGINT) AS a, n_name AS b, n_regionkey AS c FROM nation")
engine_query("dml_insert_partial", "create table t (a int, b text, c int); insert into t (c, a) values (1, 2), (3, 4); select a, b, c from t", (), "SELECT * FROM (VALUES (2, CAST(NULL AS STRING), 1), (4, CAST(NULL AS STRING), 3)) AS v (a, b, c)")
engine_query("dml_delete", "create table t (a int, b int); insert into t select n_nationkey, n_regionkey from nation; delete from t where b = 1 or a > 20; select a, b from t", ("nation",), "SELECT n_nationkey AS a, n_regionkey AS b FROM nation WHERE NOT (n_regionkey = 1 OR n_nationkey > 20)")
engine_query("sql_division", "select l_orderkey, l_partkey, l_suppkey, l_partkey / l_linenumber as whole, l_linenumber / 0 as nothing, l_partkey % 7 as rest from lineitem", ("lineitem",), "SELECT l_orderkey, l_partkey, l_suppkey, l_partkey // l_linenumber AS whole, CAST(NULL AS INT) AS nothing, l_partkey % 7 AS rest FROM lineitem")
# Types decide on a division, not names: `lode_a` is a whole number in one table and a double in another.
engine_query("sql_division_ambiguous", "create table t (lode_a int, lode_b int); create table u (lode_a double, lode_b double); insert into t select o_orderkey, 7 from orders; insert into u select o_orderkey, 7 from orders; select t.lode_a, t.lode_a / t.lode_b as whole, u.lode_a / u.lode_b as part, t.lode_a / u.lode_b as mixed from t join u on t.lode_a = u.lode_a", ("orders",), "SELECT CAST(o_orderkey AS INT) AS lode_a, CAST(o_orderkey // 7 AS BIGINT) AS whole, o_orderkey / 7.0::DOUBLE AS part, o_orderkey / 7.0::DOUBLE AS mixed FROM orders")
engine_query("sql_division_derived", "select a, p / q as w, p / q / 2 as w2, r / q as d from (select o_orderkey as a, o_orderkey / 3 as p, 2 as q, o_totalprice as r from orders) as x", ("orders",), "SELECT o_orderkey AS a, CAST(o_orderkey // 3 // 2 AS BIGINT) AS w, CAST(o_orderkey // 3 // 2 // 2 AS BIGINT) AS w2, o_totalprice / 2 AS d FROM orders")
engine_query("sql_division_grouped", "select o_custkey / 10 as k, count(*) / 2 as n, sum(o_custkey) / count(*) as m from orders group by o_custkey / 10", ("orders",), "SELECT CAST(o_custkey // 10 AS BIGINT) AS k, CAST(count(*) // 2 AS BIGINT) AS n, CAST(sum(o_custkey) // count(*) AS BIGINT) AS m FROM orders GROUP BY 1")
engine_query("sql_two_vector_indexes", "create table t (id int, p vector(2), q vector(2)); create index ip on t using ivfflat (p) with (distfn = '<->', nlists = 4, nprobe = 2); create index iq on t using ivfflat (q) with (distfn = '<->', nlists = 4, nprobe = 2); insert into t select n_nationkey, concat('[', n_nationkey, ',0]'), concat('[', 100 - n_nationkey, ',0]') from nation; select id from t order by q <-> '[0,0]' limit 3", ("nation",), "SELECT CAST(n_nationkey AS INT) AS id FROM nation ORDER BY n_nationkey DESC LIMIT 3")
engine_query("sql_index_nulls", "create table t (id int, p vector(1)); create index ip on t using ivfflat (p) with (distfn = '<->', nlists = 3, nprobe = 1); insert into t select n_nationkey, case when n_nationkey = 4 then null else concat('[', n_nationkey * n_nationkey, ']') end from nation; select id from t order by p <-> '[0]' limit 3", ("nation",), "SELECT * FROM (VALUES (4), (0), (1)) AS v (id)")
engine_query("cat_indexes", "create table t (id int, p vector(2)); create index ip on t using ivfflat (p); create index ib on t (id); select index_name, on_table, method, columns from pg_catalog.pg_indexes", (), "SELECT * FROM (VALUES ('ip', 't', 'ivfflat', 'p'), ('ib', 't', 'btree', 'id')) AS v (index_name, on_table, method, columns)")
engine_query("ddl_drop", "create table t (a int); create table u (a int); create view v as select a from t; drop view v; drop table if exists t, nothing_here; select table_name from pg_catalog.pg_tables", (), "SELECT 'u' AS table_name")
engine_query("cmd_tables", "create table t (a int, b text)\n\\d t", (), "SELECT 'postgres' AS schema_name, 't' AS table_name, k AS column_id, n AS column_name, y AS column_type, false AS column_not_null FROM (VALUES (0, 'a', 'int'), (1, 'b', 'text')) AS v (k, n, y)")
engine_query("set_mock_rowcount", "create table t (a int); insert into t values (1), (2); set mock_rowcount_t = 600; pragma disable_optimizer; pragma enable_optimizer; select n_row, n_distinct from pg_catalog.pg_stat", (), "SELECT CAST(600 AS BIGINT) AS n_row, CAST(2 AS BIGINT) AS n_distinct")


def _copy_round_trip(spark, sf_dir):
    """COPY TO and COPY FROM by statements: what is written is read back."""
    from ..engine import Column, Engine, Table

    e = Engine(spark, shared_path(spark, "engine"))
    Tables(spark, sf_dir).nation.createOrReplaceTempView("nation")
    e.tables["nation"] = Table("postgres", "nation", [Column("n_nationkey", "text")], "", True)
    at = shared_path(spark, "copied")
    e.run(f"copy (select n_nationkey, n_name, n_regionkey from nation) to '{at}' (delimiter '|', header true); create table back (k int, name text, r int); copy back from '{at}' (delimiter '|', header true)")
    return e.run("select k, name, r from back")[-1]


QUERIES["copy_round_trip"] = _copy_round_trip
ORACLE_SQL["copy_round_trip"] = "SELECT CAST(n_nationkey AS INT) AS k, n_name AS name, CAST(n_regionkey AS INT) AS r FROM nation"


def _explain_analyze(spark, sf_dir):
    """The rows that EXPLAIN ANALYZE counts at its aggregate."""
    from ..engine import Column, Engine, Table

    e = Engine(spark, shared_path(spark, "engine"))
    Tables(spark, sf_dir).nation.createOrReplaceTempView("nation")
    e.tables["nation"] = Table("postgres", "nation", [Column("n_nationkey", "text")], "", True)
    got = e.run("explain analyze select n_regionkey, count(*) as n from nation group by n_regionkey")[-1]
    return got.where("node LIKE '%HashAggregate%'").select("rows").distinct().orderBy("rows").limit(1)


QUERIES["explain_analyze"] = _explain_analyze
ORACLE_SQL["explain_analyze"] = "SELECT count(DISTINCT n_regionkey) AS rows FROM nation"

engine_query("sql_distinct_on", "select distinct on (o_custkey) o_custkey, o_orderkey from orders order by o_custkey, o_orderkey desc", ("orders",), "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
engine_query("sql_vector_order", f"select vec_id from embeddings order by embedding <-> '{QUERY_VECTOR}' limit 5", ("embeddings",), f"SELECT vec_id FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) LIMIT 5")
engine_query("cat_tables", "create table t1 (a int primary key, b text); create table t2 (c int); create view v (x) as select a from t1; select table_name, table_type from pg_catalog.pg_tables", (), "SELECT * FROM (VALUES ('t1', 'table'), ('t2', 'table'), ('v', 'view')) AS x (table_name, table_type)")
engine_query("cat_attributes", "create table t1 (a int primary key, b text); select column_id, column_name, column_type, column_not_null from pg_catalog.pg_attribute where table_name = 't1'", (), "SELECT * FROM (VALUES (0, 'a', 'int', true), (1, 'b', 'text', false)) AS x (column_id, column_name, column_type, column_not_null)")
engine_query("cat_stat", "create table t1 (a int, b int); insert into t1 values (1, 1), (2, 1), (3, 1); select column_name, n_row, n_distinct from pg_catalog.pg_stat", (), "SELECT column_name, CAST(n_row AS BIGINT) AS n_row, CAST(n_distinct AS BIGINT) AS n_distinct FROM (VALUES ('a', 3, 3), ('b', 3, 1)) AS x (column_name, n_row, n_distinct)")


# -- streams --------------------------------------------------------------------------------------------------


def _stream(spark, sf_dir):
    from ..streaming.windows import tumbling_counts

    return tumbling_counts(spark, sf_dir)


QUERIES["stream_tumbling"] = _stream
ORACLE_SQL["stream_tumbling"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
