"""Named queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import operators as ops
from sparkloom.functions import exact_sum, money, n_rows
from sparkloom.operators.index import ClusteredIndex
from sparkloom.plans.engine import Engine
from sparkloom.sources.catalog import Catalog
from sparkloom.sources.csv import read_typed_csv, write_typed_csv
from sparkloom.workspace import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str):
    """Register a DataFrame query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


def sql_query(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """Register SQL that Spark answers over views of *tables*; the oracle is the same text unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables.split()})

    QUERIES[name] = run
    ORACLE[name] = oracle or text.replace("{", "").replace("}", "")


# ---- scans and sources


@query("SELECT * FROM nation")
def scan_table(spark, d):
    return table(spark, d, "nation")


@query("SELECT * FROM supplier")
def csv_roundtrip(spark, d):
    path = fresh_path(spark, "supplier-csv")
    write_typed_csv(table(spark, d, "supplier"), path)
    return read_typed_csv(spark, path)


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN '' ELSE n_name END AS n_name, NULLIF(n_regionkey, 2) AS n_regionkey FROM nation")
def csv_null_strings(spark, d):
    path = fresh_path(spark, "nation-csv")
    name = F.when(F.col("n_regionkey") == 0, None).when(F.col("n_regionkey") == 1, "").otherwise(F.col("n_name"))
    write_typed_csv(table(spark, d, "nation").select("n_nationkey", name.alias("n_name"), F.nullif("n_regionkey", F.lit(2)).alias("n_regionkey")), path)
    return read_typed_csv(spark, path, null_strings=True)


@query("SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name")
def catalog_tables(spark, d):
    return spark.createDataFrame([(n,) for n in Catalog.names_in(spark, d)], "name string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey, o_totalprice LIMIT 100")
def page_by_key(spark, d):
    return ops.page_by_key(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", after=1000, rows=100)


@query("SELECT count(*) AS n FROM lineitem")
def record_count(spark, d):
    return table(spark, d, "lineitem").agg(n_rows().alias("n"))


# ---- projection


@query("SELECT l_partkey, l_orderkey AS order_id FROM lineitem")
def project_columns(spark, d):
    return ops.project(table(spark, d, "lineitem"), "l_partkey", order_id="l_orderkey")


@query("SELECT l_orderkey, l_quantity + l_tax AS a, l_quantity - 1 AS b, l_quantity * 2 AS c, l_quantity / 8 AS d FROM lineitem")
def project_arithmetic(spark, d):
    return ops.project(table(spark, d, "lineitem"), "l_orderkey", a="l_quantity + l_tax", b="l_quantity - 1", c="l_quantity * 2", d="l_quantity / 8")


@query("SELECT n_nationkey AS k, 'x' AS s, CAST(7 AS INTEGER) AS i, TRUE AS t FROM nation")
def project_literal_alias(spark, d):
    return ops.project(table(spark, d, "nation"), k="n_nationkey", s=F.lit("x"), i=F.lit(7), t=F.lit(True))


# ---- filters

sql_query("filter_range", "lineitem", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey > 100 AND l_orderkey < 150")
sql_query("filter_ge_le", "lineitem", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity >= 10 AND l_quantity <= 11")
sql_query("filter_eq_string", "orders", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F'")
sql_query("filter_or_not", "orders", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE NOT (o_orderstatus = 'F') AND (o_orderkey < 200 OR o_orderkey > 14000)")
sql_query("filter_arithmetic", "lineitem", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity * 2 - 1 > l_orderkey / 100 + 5")
sql_query("filter_const_expr", "lineitem", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity > 8 * 1.5 + 20")
sql_query("filter_true", "region", "SELECT * FROM {region} WHERE true")
sql_query("filter_compare_columns", "customer", "SELECT c_custkey FROM {customer} WHERE 100 < c_acctbal AND c_custkey > c_acctbal")
sql_query("filter_is_true", "customer", "SELECT c_custkey, (c_acctbal > 0) IS TRUE AS t, (NULLIF(c_nationkey, 3) > 5) IS NOT FALSE AS f FROM {customer} WHERE (NULLIF(c_nationkey, 3) > 5) IS NOT TRUE")
sql_query("filter_in_between_like_null", "part", "SELECT p_partkey, p_brand FROM {part} WHERE p_size IN (1, 5, 9, 14) AND p_retailprice BETWEEN 900 AND 1500 AND p_type LIKE '%S%' AND p_name IS NOT NULL AND p_size <> 9")


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05 AND l_tax > 0.02 AND l_returnflag = 'R'")
def filter_three_conjuncts(spark, d):
    return ops.project_filter(table(spark, d, "lineitem"), "l_quantity > 10 AND l_discount < 0.05 AND l_tax > 0.02 AND l_returnflag = 'R'", "l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (NULLIF(o_orderstatus, 'F') = 'O')")
def filter_null_logic(spark, d):
    return ops.apply_filter(table(spark, d, "orders"), ~(F.nullif("o_orderstatus", F.lit("F")) == "O")).select("o_orderkey")


@query("SELECT a + 1 AS b FROM (SELECT l_orderkey * 2 AS a FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 5) s WHERE l_orderkey > 50) t WHERE a < 5000")
def nested_project_filter(spark, d):
    inner = ops.project_filter(table(spark, d, "lineitem"), "l_quantity > 5", "l_orderkey")
    middle = ops.project_filter(inner, "l_orderkey > 50", "l_orderkey * 2 AS a")
    return ops.project_filter(middle, "a < 5000", "a + 1 AS b")


# ---- joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return ops.join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey = c_custkey").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left(spark, d):
    return ops.join(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey = l_orderkey", "left").select("o_orderkey", "l_linenumber")


@query("SELECT l_linenumber, o_orderkey FROM (SELECT * FROM lineitem WHERE l_quantity > 40) l RIGHT JOIN orders ON l_orderkey = o_orderkey")
def join_right(spark, d):
    some = ops.apply_filter(table(spark, d, "lineitem"), "l_quantity > 40")
    return ops.join(some, table(spark, d, "orders"), "l_orderkey = o_orderkey", "right").select("l_linenumber", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal < 5000) c FULL JOIN supplier s ON c_custkey = s_suppkey")
def join_full(spark, d):
    return ops.join(table(spark, d, "customer").filter("c_acctbal < 5000"), table(spark, d, "supplier"), "c_custkey = s_suppkey", "full").select("c_custkey", "s_suppkey")


sql_query("join_multi_key", "lineitem orders customer", "SELECT l_orderkey, l_linenumber, c_name FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey AND l_linenumber = length(o_orderstatus) AND l_returnflag <> o_orderstatus JOIN {customer} ON c_custkey = o_custkey")
sql_query("join_using", "nation customer", "SELECT k, n_name, c_name FROM (SELECT n_nationkey AS k, n_name FROM {nation}) JOIN (SELECT c_nationkey AS k, c_name FROM {customer}) USING (k)")
sql_query("join_natural", "nation region", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM {region}) b")
sql_query("join_comma", "nation region", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
sql_query("join_self", "nation", "SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_theta", "supplier region", "SELECT s_suppkey, r_regionkey FROM {supplier} JOIN {region} ON s_nationkey < r_regionkey * 2")
sql_query("join_cross", "nation region", "SELECT n_nationkey, r_regionkey FROM {nation} CROSS JOIN {region}")


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def join_flipped_on(spark, d):
    return ops.join(table(spark, d, "nation"), table(spark, d, "region"), "r_regionkey = n_regionkey").select("n_name", "r_name")


@query("SELECT a.k, b.v FROM (SELECT NULLIF(n_regionkey, 1) AS k FROM nation) a LEFT JOIN (SELECT NULLIF(r_regionkey, 1) AS k, r_name AS v FROM region) b ON a.k = b.k")
def join_null_keys(spark, d):
    a = table(spark, d, "nation").select(F.nullif("n_regionkey", F.lit(1)).alias("k"))
    b = table(spark, d, "region").select(F.nullif("r_regionkey", F.lit(1)).alias("k"), F.col("r_name").alias("v"))
    return ops.join(a, b, ["k"], "left")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_semi(spark, d):
    return ops.semi_join(table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_quantity > 45"), "o_orderkey = l_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, d):
    return ops.anti_join(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey = l_orderkey").select("o_orderkey")


# ---- aggregation


@query("SELECT count(*) AS n, count(o_orderstatus) AS c, CAST(sum(o_custkey) AS BIGINT) AS s, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_custkey) AS a FROM orders")
def agg_global(spark, d):
    return ops.aggregate(table(spark, d, "orders"), n=n_rows(), c=F.count("o_orderstatus"), s=F.sum("o_custkey"), p=exact_sum("o_totalprice"), lo=F.min("o_totalprice"), hi=F.max("o_totalprice"), a=F.avg("o_custkey"))


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_custkey) AS a FROM orders WHERE o_orderkey < 0")
def agg_empty(spark, d):
    return ops.aggregate(table(spark, d, "orders").filter("o_orderkey < 0"), n=n_rows(), s=F.sum("o_custkey"), lo=F.min("o_totalprice"), hi=F.max("o_totalprice"), a=F.avg("o_custkey"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS p, avg(o_custkey) AS a FROM orders GROUP BY o_orderstatus, o_orderpriority")
def agg_group(spark, d):
    return ops.aggregate(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], n=n_rows(), p=exact_sum("o_totalprice"), a=F.avg("o_custkey"))


@query("SELECT k, count(*) AS n FROM (SELECT NULLIF(n_regionkey, 2) AS k FROM nation) GROUP BY k")
def agg_null_group(spark, d):
    return ops.aggregate(table(spark, d, "nation").select(F.nullif("n_regionkey", F.lit(2)).alias("k")), ["k"], n=n_rows())


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS e, min(l_quantity) AS q_lo, min(l_tax) AS t_lo FROM lineitem GROUP BY l_returnflag")
def agg_multi_same_fn(spark, d):
    return ops.aggregate(table(spark, d, "lineitem"), ["l_returnflag"], q=exact_sum("l_quantity"), e=exact_sum("l_extendedprice"), q_lo=F.min("l_quantity"), t_lo=F.min("l_tax"))


sql_query("agg_distinct_global", "orders", "SELECT count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, avg(DISTINCT o_custkey) AS a FROM {orders}")
sql_query("agg_distinct_multi", "orders", "SELECT count(DISTINCT o_custkey, o_orderstatus) AS n FROM {orders}", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
sql_query("agg_distinct_grouped", "orders", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, count(*) AS m FROM {orders} GROUP BY o_orderstatus")


@query("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS r FROM lineitem GROUP BY l_returnflag")
def agg_expression(spark, d):
    return ops.aggregate(table(spark, d, "lineitem"), ["l_returnflag"], r=F.sum(money("l_extendedprice") * money("l_discount")).cast("double"))


@query("SELECT c_nationkey, max(c_acctbal) AS hi FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey")
def agg_negative_max(spark, d):
    return ops.aggregate(table(spark, d, "customer").filter("c_acctbal < 0"), ["c_nationkey"], hi=F.max("c_acctbal"))


@query("SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY p_brand")
def agg_string_minmax(spark, d):
    return ops.aggregate(table(spark, d, "part"), ["p_brand"], lo=F.min("p_name"), hi=F.max("p_name"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(spark, d):
    return ops.aggregate(table(spark, d, "orders"), ["o_custkey"], having="n > 12", n=n_rows())


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, d):
    return ops.distinct(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


sql_query("grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
sql_query("agg_filter_clause", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM {orders} GROUP BY o_orderpriority")

sql_query("agg_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query("agg_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS g FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS TINYINT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql_query("agg_ordered", "nation", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_statistics", "lineitem", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v, median(l_quantity) AS m FROM {lineitem} GROUP BY l_returnflag")

# ---- sorts and limits


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 200")
def sort_multi(spark, d):
    return ops.top(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), 200, "o_orderstatus desc", "o_totalprice", "o_orderkey")


@query("SELECT k, n_name FROM (SELECT NULLIF(n_regionkey, 2) AS k, n_name FROM nation) ORDER BY k DESC NULLS FIRST, n_name LIMIT 12")
def sort_nulls(spark, d):
    return ops.top(table(spark, d, "nation").select(F.nullif("n_regionkey", F.lit(2)).alias("k"), "n_name"), 12, "k desc nulls first", "n_name")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 30")
def limit_offset(spark, d):
    return ops.top(table(spark, d, "part").select("p_partkey", "p_retailprice"), 20, "p_retailprice desc", "p_partkey", offset=30)


@query("SELECT o_orderkey, o_orderdate, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate ORDER BY cnt DESC, o_orderkey")
def join_agg_sort(spark, d):
    joined = ops.join(table(spark, d, "lineitem").select("l_orderkey"), table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "l_orderkey = o_orderkey")
    return ops.sort(ops.aggregate(joined, ["o_orderkey", "o_orderdate"], cnt=n_rows()), "cnt desc", "o_orderkey")


# ---- derived tables, set operations, subqueries

sql_query("derived_join_count", "orders lineitem", "SELECT count(*) AS n FROM (SELECT o_orderkey, l_linenumber FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey) t")
sql_query("derived_filter_sort", "part", "SELECT p_name, p_size FROM (SELECT p_name, p_size, p_partkey FROM {part} WHERE p_brand = 'Brand#12' OR p_size > 40) t WHERE p_size < 45 ORDER BY p_name DESC, p_partkey")
sql_query("with_clause", "orders", "WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000) SELECT o_custkey, max(o_totalprice) AS hi FROM big GROUP BY o_custkey")
sql_query("union_all", "nation region", "SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name AS name FROM {region}")
sql_query("union_distinct", "customer supplier", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
sql_query("intersect_rows", "customer supplier", "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT s_suppkey AS k FROM {supplier}")
sql_query("except_rows", "customer supplier", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT s_suppkey AS k FROM {supplier}")
sql_query("intersect_all_rows", "customer supplier", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}")
sql_query("except_all_rows", "customer supplier", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}")
sql_query("subquery_correlated", "part lineitem", "SELECT l_orderkey, l_linenumber FROM {lineitem} JOIN {part} p ON l_partkey = p_partkey WHERE l_quantity < (SELECT avg(l.l_quantity) / 5 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey)")
sql_query("subquery_exists", "orders lineitem", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
sql_query("subquery_not_exists", "customer orders", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
sql_query("subquery_not_in_null", "nation", "SELECT n_name FROM {nation} WHERE n_nationkey NOT IN (SELECT NULLIF(n_regionkey, 2) FROM {nation})")
sql_query("window_frame", "orders", "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM {orders}", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM orders")
sql_query("window_lag_lead", "orders", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM {orders}")
sql_query("subquery_scalar", "part", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_size) * 30 FROM {part})")
sql_query("subquery_in", "orders customer", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)")
sql_query("window_rank", "orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) AS rn FROM {orders}", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) AS INTEGER) AS rn FROM orders")
sql_query("values_table", "region", "SELECT * FROM VALUES (1, 'a'), (2, NULL) AS t(k, v)", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(k, v)")


# ---- lookups on a clustered copy


def _orders_index(spark: SparkSession, d: str) -> ClusteredIndex:
    return ClusteredIndex.create(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "orders", "o_orderkey")


def _lookup(op: str, value: int) -> Query:
    return lambda spark, d: _orders_index(spark, d).lookup(op, value, "o_orderkey", "o_custkey")


for _name, _op, _value in (("index_eq", "=", 777), ("index_gt", ">", 14900), ("index_ge", ">=", 14900), ("index_lt", "<", 100), ("index_le", "<=", 100)):
    QUERIES[_name] = _lookup(_op, _value)
    ORACLE[_name] = f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey {_op} {_value}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey <> 777")
def index_delete(spark, d):
    return _orders_index(spark, d).delete(777).scan()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 120")
def index_between(spark, d):
    return _orders_index(spark, d).between(100, 120).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 14900")
def index_insert(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    some = ClusteredIndex.create(rows.filter("o_orderstatus = 'F'"), "orders", "o_orderkey")
    return some.insert(rows.filter("o_orderstatus <> 'F'")).lookup(">", 14900)


@query("SELECT TRUE AS made, FALSE AS again, TRUE AS there, FALSE AS elsewhere, FALSE AS no_table")
def index_exists(spark, d):
    e = Engine(spark)
    e.catalog.register("sparkloom_orders", table(spark, d, "orders"))
    name = ("sparkloom_orders", "o_orderkey")
    flags = (e.create_index(*name), e.create_index(*name), e.index_exists(*name), e.index_exists("sparkloom_orders", "o_custkey"), e.create_index("none", "x"))
    e.close()
    return spark.createDataFrame([flags], "made boolean, again boolean, there boolean, elsewhere boolean, no_table boolean")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 14900")
def index_by_sql(spark, d):
    e = Engine(spark)
    e.catalog.register("sparkloom_orders", table(spark, d, "orders"))
    e.create_index("sparkloom_orders", "o_orderkey")
    return e.sql("SELECT o_orderkey, o_custkey FROM sparkloom_orders WHERE o_orderkey >= 14900")


@query("SELECT DISTINCT o_custkey FROM orders")
def index_keys(spark, d):
    return ClusteredIndex.create(table(spark, d, "orders").select("o_custkey"), "orders", "o_custkey").keys()
