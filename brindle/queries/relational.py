"""One query per relational operator: scans, projection, joins, subqueries, aggregates, windows, order, sets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import table, tables
from ..operators import joins
from ..operators.relational import asc, desc, rollup, rows_frame, set_operation, top_k
from ..plans.sqlfront import Engine
from ..session import shared_dir
from ..sources import io
from .registry import query


def by_sql(name: str, sql: str, oracle: str | None = None) -> None:
    """A query that goes through the SQL front end; the oracle is the same text unless dialects differ."""
    query(name, oracle or sql)(lambda spark, d: Engine(spark, d).sql(sql))


# -- scans, sources, sinks -----------------------------------------------------------------------------------


@query("scan_base_table", "SELECT * FROM nation")
def scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation")


@query("values_relation", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(k, v)")
def values(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")


by_sql("values_without_from", "SELECT 1 AS one, 'x' AS x")


def _stored(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/brindle-{tag}-{uuid.uuid4().hex}"


@query("csv_import", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_import(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    path = _stored(spark, "csv")
    io.write_csv(o, path, delimiter="|")
    return io.read_csv(spark, path, o.schema, delimiter="|")


@query("create_table_insert", "SELECT CAST(s_suppkey AS INTEGER) AS k, s_name AS name, CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS bal, CAST(NULL AS VARCHAR) AS note FROM supplier UNION ALL SELECT 7, 'x', NULL, 'seven'")
def create_insert(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.createDataFrame([], "k int, name string, bal decimal(12,2), note string").schema
    path = _stored(spark, "table")
    io.insert_into(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, schema, ["k", "name", "bal"])
    io.insert_into(spark.createDataFrame([("7", "x", "seven")], "a string, b string, c string"), path, schema, ["k", "name", "note"])
    return spark.read.schema(schema).parquet(path).withColumn("bal", F.col("bal").cast("double"))


@query("arrow_round_trip", "SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def arrow(spark: SparkSession, d: str) -> DataFrame:
    return io.from_arrow(spark, io.to_arrow(table(spark, d, "region"))).withColumn("r_name", F.upper("r_name"))


@query("engine_append_table", "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT -1 - o_orderkey, 'again' FROM orders")
def append(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, d)
    e.create_table("appended", "o_orderkey bigint, o_orderstatus string")
    e.append_table("appended", table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))
    e.append_table("appended", e.sql("SELECT -1 - o_orderkey, 'again' FROM orders"))
    return spark.table("appended")


@query("statements_create_insert", "SELECT CAST(s_suppkey AS INTEGER) AS k, s_name AS name, CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS bal, CAST(NULL AS DATE) AS since FROM supplier UNION ALL SELECT * FROM (VALUES (-1, 'one', 2.5, DATE '1997-03-01'), (-2, 'it''s; two', NULL, NULL)) t")
def statements_insert(spark: SparkSession, d: str) -> DataFrame:
    """Through SQL text alone: a table with keys, rows from a query, rows from VALUES."""
    e = Engine(spark, d)
    e.script("""SET persist = 0;
        CREATE TABLE kept_suppliers (k integer not null, name varchar(25), bal numeric(12,2), since date, primary key (k));
        INSERT INTO kept_suppliers (k, name, bal) SELECT s_suppkey, s_name, s_acctbal FROM supplier;
        INSERT INTO kept_suppliers VALUES (-1, 'one', 2.5, '1997-03-01'), (-2, 'it''s; two', NULL, NULL);""")
    return e.sql("SELECT k, name, CAST(bal AS DOUBLE) AS bal, since FROM kept_suppliers")


@query("statements_copy", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def statements_copy(spark: SparkSession, d: str) -> DataFrame:
    path = _stored(spark, "copied")
    io.write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path, delimiter="|")
    e = Engine(spark, d)
    e.script(f"CREATE TABLE copied_orders (o_orderkey bigint primary key, o_custkey bigint, o_orderstatus char(1), o_totalprice double precision); COPY copied_orders FROM '{path}' DELIMITER '|' ESCAPE '\\'")
    return e.sql("SELECT * FROM copied_orders")


@query("statements_persist", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def statements_persist(spark: SparkSession, d: str) -> DataFrame:
    """SET persist=1 puts new tables in the warehouse, where other sessions see them."""
    name = f"persisted_{uuid.uuid4().hex}"
    e = Engine(spark, d)
    e.script(f"SET persist=1; CREATE TABLE {name} (r int, n bigint); INSERT INTO {name} SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey")
    kept = [tuple(r) for r in spark.newSession().table(name).collect()]  # one row a region
    e.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(kept, "n_regionkey int, n bigint")


@query("arrow_file", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def arrow_file(spark: SparkSession, d: str) -> DataFrame:
    path = _stored(spark, "arrow")
    io.write_arrow(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), path)
    return io.read_arrow(spark, path)


@query("tuple_tracking", "SELECT count(*) AS joined, (SELECT count(*) FROM orders) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 5")
def tracking(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of two places in one plan, observed while it runs."""
    orders, seen_orders = io.tracked(table(spark, d, "orders"), f"orders {uuid.uuid4().hex}")
    joined, seen_joined = io.tracked(orders.join(table(spark, d, "customer").where("c_nationkey < 5"), F.col("o_custkey") == F.col("c_custkey")), f"joined {uuid.uuid4().hex}")
    joined.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen_joined.get["rows"], seen_orders.get["rows"])], "joined bigint, orders bigint")


@query("value_dump", "SELECT r_regionkey, r_name FROM region")
def dumped(spark: SparkSession, d: str) -> DataFrame:
    return io.dump_values(table(spark, d, "region").select("r_regionkey", "r_name"), "r_name")


@query("scalar_extension", "SELECT l_orderkey, l_linenumber, 2 * l_quantity + 1 AS q FROM lineitem")
def scalar_extension(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, d)
    e.add_scalar("twice_and_one", "x double", "double", "2 * x + 1")
    return e.sql("SELECT l_orderkey, l_linenumber, twice_and_one(l_quantity) AS q FROM lineitem")


@query("result_hash", "SELECT md5(concat(count(*), ':', CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', n_name, n_nationkey, n_regionkey)), 1, 15)) AS BIGINT)) AS VARCHAR))) AS md5 FROM nation")
def hashed(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(io.result_hash(table(spark, d, "nation")),)], "md5 string")


# -- projection, filter, rename --------------------------------------------------------------------------------


@query("selection", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def selection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_totalprice > 200000 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("map_columns", "SELECT o_orderkey, o_orderkey * 2 + 1 AS odd, o_orderpriority || '/' || o_orderstatus AS tag FROM orders")
def map_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 2 + 1).alias("odd"), F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("tag"))


@query("projection_all", "SELECT o_orderstatus, o_orderpriority FROM orders")
def projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority")


@query("projection_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("renaming", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def renaming(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = (n.select(*(F.col(c).alias(f"{p}_{c[2:]}") for c in n.columns)) for p in "ab")
    return a.join(b, (F.col("a_regionkey") == F.col("b_regionkey")) & (F.col("a_nationkey") < F.col("b_nationkey"))).select("a_name", "b_name")


by_sql("tmp_shared_cte", "WITH t(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) SELECT a.k, a.n FROM t a, (SELECT max(n) AS m FROM t) b WHERE a.n = b.m")


@query("nested_plan", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def nested(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").transform(lambda x: x.where("n_nationkey > 3")).transform(lambda x: x.groupBy("n_regionkey").agg(F.count("*").alias("n")))


by_sql("select_star_join", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")

# -- joins -------------------------------------------------------------------------------------------------------


@query("join_cross", "SELECT r_name, c_mktsegment FROM region, (SELECT DISTINCT c_mktsegment FROM customer) s")
def cross(spark: SparkSession, d: str) -> DataFrame:
    r, c = tables(spark, d, "region", "customer")
    return r.select("r_name").crossJoin(c.select("c_mktsegment").distinct())


@query("join_inner_equi", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def inner(spark: SparkSession, d: str) -> DataFrame:
    o, c = tables(spark, d, "orders", "customer")
    return o.join(c.where("c_mktsegment = 'MACHINERY'"), o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("join_inner_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal > b.s_acctbal + 9000")
def theta(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x")), s.select(F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("y"))
    return a.join(b, F.col("x") > F.col("y") + 9000).select("a", "b")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def semi(spark: SparkSession, d: str) -> DataFrame:
    c, o = tables(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 250000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark: SparkSession, d: str) -> DataFrame:
    o, li = tables(spark, d, "orders", "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey")


@query("join_left_outer", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 48")
def left(spark: SparkSession, d: str) -> DataFrame:
    o, li = tables(spark, d, "orders", "lineitem")
    return o.join(li.where("l_quantity > 48"), o.o_orderkey == li.l_orderkey, "left").select("o_orderkey", "l_linenumber")


@query("join_right_outer", "SELECT l_linenumber, o_orderkey FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey AND l_discount > 0.09")
def right(spark: SparkSession, d: str) -> DataFrame:
    o, li = tables(spark, d, "orders", "lineitem")
    return li.where("l_discount > 0.09D").join(o, o.o_orderkey == li.l_orderkey, "right").select("l_linenumber", "o_orderkey")


@query("join_full_outer", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50")
def full(spark: SparkSession, d: str) -> DataFrame:
    c, s = tables(spark, d, "customer", "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey + 50, "full").select("c_custkey", "s_suppkey")


by_sql("join_full_outer_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a FULL JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("join_single", "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = n_nationkey) AS r_name FROM nation")
def single(spark: SparkSession, d: str) -> DataFrame:
    n, r = tables(spark, d, "nation", "region")
    return joins.single_join(n.select("n_nationkey"), r.select(F.col("r_regionkey").alias("n_nationkey"), "r_name"), ["n_nationkey"], "r_name")


MARK = "CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE n_nationkey END"


@query("join_mark", f"SELECT n_nationkey, {MARK} IN (SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey END FROM region) AS mark FROM nation")
def mark(spark: SparkSession, d: str) -> DataFrame:
    n, r = tables(spark, d, "nation", "region")
    x = n.select("n_nationkey", F.expr(MARK).alias("x"))
    y = r.select(F.expr("case when r_regionkey = 4 then null else r_regionkey end").alias("y"))
    return joins.mark_join(x, y, "x", "y").select("n_nationkey", "mark")


@query("join_collection", "SELECT r_name, coalesce((SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 9), '') AS names FROM region")
def collection(spark: SparkSession, d: str) -> DataFrame:
    r, n = tables(spark, d, "region", "nation")
    got = joins.collection_join(r, n.where("n_nationkey > 9").select(F.col("n_regionkey").alias("r_regionkey"), "n_name"), ["r_regionkey"], ["n_name"], "names")
    return got.select("r_name", F.array_join(F.col("names.n_name"), ",").alias("names"))


@query("join_group", "SELECT c_custkey, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) o ON c_custkey = o_custkey")
def group_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = tables(spark, d, "customer", "orders")
    return joins.group_join(c.select("c_custkey"), o.where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], [F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("total")])


@query("join_null_safe", "SELECT a.k AS a, b.k AS b FROM (VALUES (1), (2), (NULL)) a(k) JOIN (VALUES (2), (NULL), (NULL)) b(k) ON a.k IS NOT DISTINCT FROM b.k")
def null_safe(spark: SparkSession, d: str) -> DataFrame:
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "a int"), spark.createDataFrame([(2,), (None,), (None,)], "b int")
    return joins.null_safe_join(a, b, [("a", "b")])


# -- subqueries ------------------------------------------------------------------------------------------------------

by_sql("subquery_derived_table", "SELECT t.s, t.n FROM (SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus) t(s, n) WHERE t.n > 10")
by_sql("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
by_sql("subquery_scalar_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > 1.6 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
by_sql("subquery_count_empty", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")
by_sql("subquery_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
by_sql("subquery_not_exists", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
by_sql("subquery_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
by_sql("subquery_not_in", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
by_sql("subquery_not_in_null", "SELECT count(*) AS n FROM region WHERE r_regionkey NOT IN (SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END FROM nation WHERE n_nationkey BETWEEN 2 AND 3)")
by_sql("subquery_any", "SELECT o_orderkey FROM orders WHERE o_totalprice = ANY (SELECT max(o_totalprice) FROM orders GROUP BY o_custkey)")
by_sql("subquery_some_correlated", "SELECT o_orderkey FROM orders WHERE o_totalprice / 10 > SOME (SELECT l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey)", "SELECT o_orderkey FROM orders WHERE o_totalprice / 10 > ANY (SELECT l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey)")
by_sql("subquery_all", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier)")
by_sql("subquery_all_correlated", "SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey)")


@query("subquery_any_value", f"SELECT n_nationkey, {MARK} > ANY (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END FROM region) AS v FROM nation")
def any_value(spark: SparkSession, d: str) -> DataFrame:
    n, r = tables(spark, d, "nation", "region")
    x, y = n.select("n_nationkey", F.expr(MARK).alias("x")), r.select(F.expr("case when r_regionkey = 0 then null else r_regionkey end").alias("y"))
    return joins.quantified_value(x, y, ["n_nationkey"], ">", "x", "y", "ANY", "v").select("n_nationkey", "v")


@query("subquery_all_value", f"SELECT n_nationkey, {MARK} > ALL (SELECT r_regionkey FROM region) AS v FROM nation")
def all_value(spark: SparkSession, d: str) -> DataFrame:
    n, r = tables(spark, d, "nation", "region")
    x = n.select("n_nationkey", F.expr(MARK).alias("x"))
    return joins.quantified_value(x, r.select(F.col("r_regionkey").alias("y")), ["n_nationkey"], ">", "x", "y", "ALL", "v").select("n_nationkey", "v")


# quantified comparisons in every position, with names that both scopes have
NULLS = "(SELECT CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_nationkey END AS i, n_regionkey AS g FROM nation)"
by_sql("subquery_any_same_name", "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY (SELECT n_regionkey FROM nation)")
by_sql("subquery_all_same_name", "SELECT n_nationkey FROM nation WHERE n_nationkey >= ALL (SELECT n_regionkey FROM nation)")
by_sql("subquery_all_self", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice / 2 FROM orders) OR o_orderkey <= ANY (SELECT o_custkey FROM orders)")
by_sql("subquery_not_all_null", "SELECT n_nationkey FROM nation WHERE NOT (n_nationkey > ALL (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey + 2 END FROM region))")
by_sql("subquery_quantified_values", f"SELECT n_nationkey AS k, n_nationkey = ANY (SELECT i FROM {NULLS} b) AS a, n_nationkey <> ALL (SELECT i FROM {NULLS} b) AS b, n_nationkey > ANY (SELECT i FROM {NULLS} b) AS c, n_nationkey <= ALL (SELECT i FROM {NULLS} b) AS d, n_nationkey <> ANY (SELECT i FROM {NULLS} b WHERE i = 3) AS e, n_nationkey = ALL (SELECT i FROM {NULLS} b WHERE i = 3) AS f, -n_nationkey < ALL (SELECT i FROM {NULLS} b WHERE i > 100) AS g FROM nation")
by_sql("subquery_correlated_values", f"SELECT i, i = ANY (SELECT i FROM {NULLS} b WHERE b.g = a.g) AS p, i = ANY (SELECT i FROM {NULLS} b WHERE 1 = 0 AND a.i = b.i) AS q, i > ALL (SELECT i - 1 FROM {NULLS} b WHERE b.g = a.g AND i IS NOT NULL) AS r, i <> ALL (SELECT i FROM {NULLS} b WHERE b.i = a.i) AS s FROM {NULLS} a")
by_sql("subquery_correlated_any_filter", f"SELECT i FROM {NULLS} a WHERE i = ANY (SELECT i FROM {NULLS} b WHERE b.g = a.g) AND NOT i < ANY (SELECT i FROM {NULLS} b WHERE b.g = a.g)")

by_sql("subquery_correlated_limit", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer")

# -- aggregates ----------------------------------------------------------------------------------------------------


@query("agg_all_functions", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS mn, max(l_shipdate) AS mx, round(avg(l_linenumber), 6) AS a, count(l_linenumber) AS c, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def aggs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("s"), F.min("l_quantity").alias("mn"), F.max("l_shipdate").alias("mx"), F.round(F.avg("l_linenumber"), 6).alias("a"), F.count("l_linenumber").alias("c"), F.count("*").alias("n"))


@query("agg_no_group", "SELECT count(*) AS n, max(o_totalprice) AS m, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
def agg_empty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey < 0").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m"), F.sum("o_custkey").alias("s"))


@query("agg_null_skipping", "SELECT k % 3 AS g, count(v) AS c, CAST(sum(v) AS BIGINT) AS s, min(v) AS mn FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS v FROM nation) t GROUP BY k % 3")
def agg_nulls(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.expr("case when n_nationkey % 3 = 0 or n_nationkey % 5 = 0 then null else n_nationkey end").alias("v"))
    return t.groupBy((F.col("k") % 3).alias("g")).agg(F.count("v").alias("c"), F.sum("v").alias("s"), F.min("v").alias("mn"))


@query("agg_any", "SELECT c_nationkey % 5 AS g, max(r) AS a FROM (SELECT c_nationkey, (c_nationkey % 5) * 10 AS r FROM customer) t GROUP BY c_nationkey % 5")
def agg_any(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("g"), ((F.col("c_nationkey") % 5) * 10).alias("r"))
    return t.groupBy("g").agg(F.any_value("r").alias("a"))


@query("agg_stddev_var", "SELECT o_orderstatus, round(stddev_samp(o_custkey), 4) AS sd, round(var_samp(o_custkey), 2) AS va FROM orders GROUP BY o_orderstatus")
def stddev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.stddev_samp("o_custkey"), 4).alias("sd"), F.round(F.var_samp("o_custkey"), 2).alias("va"))


@query("agg_distinct", "SELECT l_linestatus, count(DISTINCT l_suppkey) AS c, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_distinct("l_suppkey").alias("c"), F.sum_distinct("l_linenumber").alias("s"), F.count("*").alias("n"))


@query("agg_group_expression", "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, o_custkey % 4 AS k, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_expr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), (F.col("o_custkey") % 4).alias("k")).agg(F.count("*").alias("n"))


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14")
def having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 14")


by_sql("agg_having_subquery", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT 1.5 * count(*) / count(DISTINCT o_custkey) FROM orders)")


@query("agg_rollup_grouping", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g_l_returnflag, CAST(grouping(l_linestatus) AS BIGINT) AS g_l_linestatus FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rolled(spark: SparkSession, d: str) -> DataFrame:
    return rollup(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [F.count("*").alias("n")])


by_sql("agg_standalone", "SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l")
by_sql("extra_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")

# -- windows -------------------------------------------------------------------------------------------------------



def by_date() -> list[Column]:
    return [asc("o_orderdate"), asc("o_orderkey")]



@query("window_whole_partition", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders")
def whole(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", F.count("*").over(w).alias("n"), F.max("o_totalprice").over(w).alias("m"))


@query("window_running", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER w AS BIGINT) AS s, min(o_totalprice) OVER w AS mn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running(spark: SparkSession, d: str) -> DataFrame:
    w = rows_frame(["o_custkey"], by_date())
    return table(spark, d, "orders").select("o_orderkey", F.sum("o_orderkey").over(w).alias("s"), F.min("o_totalprice").over(w).alias("mn"))


@query("window_moving", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER w AS BIGINT) AS s, min(o_totalprice) OVER w AS mn, max(o_totalprice) OVER w AS mx, count(*) OVER w AS n, round(avg(o_orderkey) OVER w, 6) AS a FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def moving(spark: SparkSession, d: str) -> DataFrame:
    w = rows_frame(["o_orderstatus"], by_date(), -2, 1)
    return table(spark, d, "orders").select("o_orderkey", F.sum("o_orderkey").over(w).alias("s"), F.min("o_totalprice").over(w).alias("mn"), F.max("o_totalprice").over(w).alias("mx"), F.count("*").over(w).alias("n"), F.round(F.avg("o_orderkey").over(w), 6).alias("a"))


@query("window_following", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM orders")
def following(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.count("*").over(rows_frame(["o_custkey"], [asc("o_orderkey")], 1, None)).alias("n"))


@query("window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS r FROM orders")
def rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(Window.partitionBy("o_orderstatus").orderBy(asc("o_orderdate"))).cast("bigint").alias("r"))


by_sql("extra_row_number_lag", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, lag(o_orderkey) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")

# -- order, limit, top-k -------------------------------------------------------------------------------------------


@query("sort_nulls", "SELECT k, v FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS v FROM nation) t ORDER BY v DESC NULLS FIRST, k LIMIT 12")
def sort_nulls(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.expr("case when n_nationkey % 4 = 0 then null else n_regionkey end").alias("v"))
    return top_k(t, 12, desc("v"), asc("k"))


by_sql("sort_default_null_order", "SELECT k, v FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS v FROM nation) t ORDER BY v, k DESC LIMIT 15", "SELECT k, v FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS v FROM nation) t ORDER BY v NULLS LAST, k DESC LIMIT 15")


@query("sort_full", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_full(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(desc("o_totalprice"), asc("o_orderkey"))


@query("limit_rows", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 7) t")
def limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").limit(7).agg(F.count("*").alias("n"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, desc("o_totalprice"), asc("o_orderkey"))


# -- set operations --------------------------------------------------------------------------------------------------

_A, _B = "SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 10", "SELECT l_partkey FROM lineitem WHERE l_discount > 0.08"
for _kind in ("union", "union all", "intersect", "intersect all", "except", "except all"):

    @query(f"set_{_kind.replace(' ', '_')}", f"{_A} {_kind.upper()} {_B}")
    def _set(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        li = table(spark, d, "lineitem")
        return set_operation(kind, li.where("l_quantity < 10").select(F.col("l_partkey").alias("k")), li.where("l_discount > 0.08D").select("l_partkey"))


@query("set_mixed_types", "SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation UNION SELECT CAST(r_regionkey + 0.5 AS DOUBLE) FROM region")
def mixed(spark: SparkSession, d: str) -> DataFrame:
    n, r = tables(spark, d, "nation", "region")
    out = set_operation("union", n.select(F.col("n_nationkey").alias("k")), r.select((F.col("r_regionkey") + F.lit(0.5).cast("decimal(2,1)")).alias("v")))
    return out.select(F.col("k").cast("double").alias("k"))
