"""One query per predicate and scalar function, the looping programs, and the extras."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table, tables
from ..functions import scalars
from ..plans.iterate import kmeans, pagerank
from ..streaming.windows import windowed_counts
from .registry import query
from .relational import by_sql

N = "SELECT n_nationkey AS k, n_name AS s, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE n_regionkey END AS v FROM nation"

by_sql("pred_comparisons", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 300000 AND o_orderstatus <> 'F' AND o_orderkey != 5 AND o_orderpriority <= '3' AND o_custkey > 20")
by_sql("pred_three_valued", f"SELECT k, (v > 1 AND k > 5) AS a, (v > 1 OR k > 5) AS o, NOT (v > 1) AS n FROM ({N}) t")
by_sql("pred_filter_null", f"SELECT k FROM ({N}) t WHERE v > 1 OR NOT (v > 1)")
by_sql("pred_is_null", f"SELECT k, v IS NULL AS a, v IS NOT NULL AS b FROM ({N}) t")
by_sql("pred_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_custkey NOT BETWEEN 10 AND 90")
by_sql("pred_in_list", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment NOT IN ('BUILDING', 'FURNITURE')")
by_sql("pred_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%wid_et' AND p_name NOT LIKE 'cold%' AND p_type LIKE '%O%'")
by_sql("pred_case", f"SELECT k, CASE WHEN v > 2 THEN 'high' WHEN v IS NULL THEN 'none' END AS a, CASE k % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'two' END AS b FROM ({N}) t")
by_sql("pred_coalesce", f"SELECT k, coalesce(v, k, 0) AS a FROM ({N}) t")
by_sql("pred_cast", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(o_totalprice AS BIGINT) AS i, CAST('12' AS INTEGER) AS t, '1997-03-01'::date AS d FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_orderkey < 10", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST('12' AS INTEGER) AS t, '1997-03-01'::date AS d FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_orderkey < 10")


@query("pred_is_a", f"SELECT k, v IS NOT DISTINCT FROM 2 AS a, v IS NOT DISTINCT FROM NULL AS b FROM ({N}) t")
def is_a(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.expr("case when n_nationkey % 4 = 1 then null else n_regionkey end").alias("v"))
    return t.select("k", scalars.is_a(F.col("v"), F.lit(2)).alias("a"), scalars.is_a(F.col("v"), F.lit(None)).alias("b"))


@query("fn_date_diff", "SELECT l_orderkey, l_linenumber, date_diff('second', o_orderdate, l_shipdate) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_diff(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", scalars.date_diff_seconds(F.col("o_orderdate"), F.col("l_shipdate")).alias("s"))


by_sql("fn_date_diff_text", "SELECT o_orderkey, date_diff('second', TIMESTAMP '1995-01-01', o_orderdate) AS s FROM orders WHERE date_diff('second', TIMESTAMP '1997-01-01', o_orderdate) > 0")


@query("fn_extract", "SELECT event_id, CAST(extract(year FROM ts) AS BIGINT) AS y, CAST(extract(month FROM ts) AS BIGINT) AS m, CAST(extract(day FROM ts) AS BIGINT) AS dd, CAST(extract(hour FROM ts) AS BIGINT) AS h FROM events")
def extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", *(scalars.date_part(f, F.col("ts")).alias(n) for f, n in (("year", "y"), ("month", "m"), ("day", "dd"), ("hour", "h"))))


by_sql("fn_substring", "SELECT c_custkey, substring(c_name, 10, 4) AS a, substr(c_name, 12) AS b, substring(c_mktsegment FROM 1 FOR 3) AS c FROM customer")
by_sql("fn_abs_upper", "SELECT s_suppkey, abs(s_acctbal) AS a, abs(s_suppkey - 50) AS b, upper(s_name) AS u FROM supplier")


@query("fn_round", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS a, CAST(round(CAST(l_orderkey AS BIGINT), 0) AS BIGINT) AS b FROM lineitem")
def rounding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice").cast("decimal(12,2)"), 1).cast("double").alias("a"), F.round("l_orderkey", 0).cast("bigint").alias("b"))


@query("fn_hash", "SELECT count(DISTINCT (c_mktsegment, c_nationkey)) AS n FROM customer")
def hashing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.count_distinct(scalars.hash_of(F.col("c_mktsegment"), F.col("c_nationkey"))).alias("n"))


by_sql("fn_concat", "SELECT c_custkey, c_name || ':' || c_mktsegment AS a, c_name || NULL AS b FROM customer", "SELECT c_custkey, c_name || ':' || c_mktsegment AS a, CAST(c_name || NULL AS VARCHAR) AS b FROM customer")


@query("fn_date_interval", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS a, o_orderdate - INTERVAL 90 DAY AS b, o_orderdate + INTERVAL 1 YEAR AS c FROM orders")
def interval(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", scalars.add_interval(o, months=3).alias("a"), scalars.add_interval(o, days=-90).alias("b"), scalars.add_interval(o, months=12).alias("c"))


@query("fn_arithmetic", "SELECT o_orderkey, o_orderkey + 7 AS a, o_orderkey - o_custkey AS b, o_orderkey * 3 AS c, o_orderkey // 7 AS dv, o_orderkey % 7 AS m, o_totalprice / 4 AS f FROM orders")
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (k + 7).alias("a"), (k - F.col("o_custkey")).alias("b"), (k * 3).alias("c"), F.expr("o_orderkey div 7").alias("dv"), (k % 7).alias("m"), (F.col("o_totalprice") / 4).alias("f"))


@query("fn_decimal", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS a, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) - CAST(l_tax AS DECIMAL(4,2)) AS DOUBLE) AS b FROM lineitem")
def decimals(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice").cast("decimal(12,2)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (x * F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("a"), (x - F.col("l_tax").cast("decimal(4,2)")).cast("double").alias("b"))


@query("fn_string_find_length", "SELECT p_partkey, CAST(instr(p_name, 'w') AS BIGINT) AS f, CAST(length(p_name) AS BIGINT) AS n FROM part")
def find(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.instr("p_name", "w").cast("bigint").alias("f"), F.length("p_name").cast("bigint").alias("n"))


@query("fn_math", "SELECT n_nationkey, round(sqrt(n_nationkey), 9) AS a, round(sin(n_nationkey), 9) AS b, round(cos(n_nationkey), 9) AS c, round(asin(n_nationkey / 30.0), 9) AS dd, round(ln(n_nationkey + 1), 9) AS e, round(exp(n_nationkey / 10.0), 9) AS f FROM nation")
def maths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", *(F.round(x, 9).alias(n) for x, n in ((F.sqrt(k), "a"), (F.sin(k), "b"), (F.cos(k), "c"), (F.asin(k / 30.0), "dd"), (F.log(k + 1), "e"), (F.exp(k / 10.0), "f"))))


@query("fn_erf", "SELECT n_nationkey, e FROM nation JOIN (VALUES " + ", ".join(f"({k}, {round(math.erf(k / 10), 9)!r}::DOUBLE)" for k in range(25)) + ") t(k, e) ON n_nationkey = k")
def erf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.round(scalars.erf(F.col("n_nationkey") / 10.0), 9).alias("e"))


@query("fn_random_in_range", "SELECT count(*) AS n, true AS inside FROM nation")
def random(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "nation").select(scalars.random_in_range(3, 9, 1).alias("r"))
    return r.agg(F.count("*").alias("n"), F.every((F.col("r") >= 3) & (F.col("r") < 9)).alias("inside"))


# -- loops ------------------------------------------------------------------------------------------------------------



ROUNDS, DAMPING = 10, 0.85


def _pagerank_sql() -> str:
    """The rounds written out, each a table expression."""
    rounds = [f"""r{k} AS MATERIALIZED (SELECT nodes.id, {1 - DAMPING} / n + {DAMPING} * coalesce(got, 0) AS rank FROM nodes CROSS JOIN size
        LEFT JOIN (SELECT dst, sum(rank / d) AS got FROM e JOIN out ON e.src = out.src JOIN r{k - 1} ON e.src = r{k - 1}.id GROUP BY dst) s ON nodes.id = s.dst)""" for k in range(1, ROUNDS + 1)]  # every node has an edge out
    return f"""WITH bought AS MATERIALIZED (SELECT DISTINCT 'c' || o_custkey AS c, 'p' || l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
        e AS MATERIALIZED (SELECT c AS src, p AS dst FROM bought UNION ALL SELECT p, c FROM bought), out AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY src),
        nodes AS MATERIALIZED (SELECT src AS id FROM out), size AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes CROSS JOIN size),
        {", ".join(rounds)} SELECT id, round(rank, 12) AS rank FROM r{ROUNDS}"""


@query("loop_pagerank", _pagerank_sql())
def ranks(spark: SparkSession, d: str) -> DataFrame:
    """Customers and the parts they ordered, linked both ways; ids are the real keys behind c or p."""
    o, li = tables(spark, d, "orders", "lineitem")
    bought = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).dropna().distinct()
    e = bought.unionByName(bought.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pagerank(e, rounds=ROUNDS, damping=DAMPING).select("id", F.round("rank", 12).alias("rank"))


CENTERS, LLOYD = [(0.0, 0.0), (25.0, 20.0), (50.0, 40.0)], 8


def _kmeans_sql() -> str:
    near = lambda c: f"(SELECT px, py, cluster FROM (SELECT px, py, cluster, row_number() OVER (PARTITION BY id ORDER BY (px - x) * (px - x) + (py - y) * (py - y), cluster) AS place FROM points CROSS JOIN {c}) t WHERE place = 1)"
    rounds = [f"c{k} AS MATERIALIZED (SELECT o.cluster, coalesce(avg(px), any_value(o.x)) AS x, coalesce(avg(py), any_value(o.y)) AS y FROM c{k - 1} o LEFT JOIN {near(f'c{k - 1}')} m ON o.cluster = m.cluster GROUP BY o.cluster)" for k in range(1, LLOYD + 1)]
    first = ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in enumerate(CENTERS))
    return f"WITH points AS MATERIALIZED (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS px, p_retailprice / 50 AS py FROM part), c0 AS (SELECT * FROM (VALUES {first}) t(cluster, x, y)), {', '.join(rounds)} SELECT CAST(cluster AS INTEGER) AS cluster, round(avg(px), 6) AS x, round(avg(py), 6) AS y, count(*) AS n FROM {near(f'c{LLOYD}')} f GROUP BY cluster"


@query("loop_kmeans", _kmeans_sql())
def clusters(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 50).alias("y"))
    return kmeans(p, CENTERS, rounds=LLOYD).select("cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


# -- extra: event-time windows ------------------------------------------------------------------------------------------


@query("extra_event_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 6) AS total FROM events GROUP BY 1, 2")
def windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"))
