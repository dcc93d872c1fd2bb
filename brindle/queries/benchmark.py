"""Benchmark shapes over the local tables (constants chosen so that they select rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import tables
from ..operators.relational import asc, desc, top_k
from ..plans.iterate import cut
from .registry import query
from .relational import by_sql


def units(c: str) -> Column:
    """Money, quantities and rates are stored as doubles of two decimals; as whole hundredths their sums are exact and stay in long arithmetic."""
    return F.round(F.col(c) * 100).cast("bigint")


def revenue() -> Column:
    """Extended price less discount, in ten-thousandths."""
    return units("l_extendedprice") * (F.lit(100) - units("l_discount"))


#: Bits that exact_sum splits off: with values below 2**40, 2**43 rows a group can't overflow either sum.
LOW_BITS = 20


def exact_sum(v: Column, digits: int) -> Column:
    """Sum of a long that counts 10**-digits, as decimal; high and low bits are summed apart, so that no sum overflows."""
    high, low = F.sum(F.shiftright(v, LOW_BITS)), F.sum(v.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("bigint")))
    whole = (high.cast("decimal(20,0)") * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + low.cast("decimal(20,0)")).cast("decimal(32,0)")
    return whole * F.lit(f"0.{'0' * (digits - 1)}1").cast(f"decimal({digits},{digits})")


def total(v: Column, digits: int) -> Column:
    return exact_sum(v, digits).cast("double")


REV = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
SUM_REV = f"CAST(sum({REV}) AS DOUBLE)"


@query(
    "q1_pricing_summary",
    f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price, {SUM_REV} AS sum_disc_price,
    CAST(sum({REV} * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS sum_charge,
    round(CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*), 6) AS avg_qty,
    round(CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def q1(spark: SparkSession, d: str) -> DataFrame:
    (li,) = tables(spark, d, "lineitem")
    n = F.count("*")
    return (
        li.where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            total(units("l_quantity"), 2).alias("sum_qty"), total(units("l_extendedprice"), 2).alias("sum_base_price"), total(revenue(), 4).alias("sum_disc_price"), total(revenue() * (F.lit(100) + units("l_tax")), 6).alias("sum_charge"),
            F.round(total(units("l_quantity"), 2) / n, 6).alias("avg_qty"), F.round(total(units("l_discount"), 2) / n, 6).alias("avg_disc"), n.alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("q3_shipping_priority", f"SELECT l_orderkey, {SUM_REV} AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
def q3(spark: SparkSession, d: str) -> DataFrame:
    c, o, li = tables(spark, d, "customer", "orders", "lineitem")
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    j = li.where(F.col("l_shipdate") > day).join(o.where(F.col("o_orderdate") < day), F.col("l_orderkey") == F.col("o_orderkey")).join(c.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return top_k(j.groupBy("l_orderkey", "o_orderdate").agg(total(revenue(), 4).alias("revenue")), 10, desc("revenue"), asc("o_orderdate"), asc("l_orderkey"))


@query("q5_local_supplier_volume", f"SELECT n_name, {SUM_REV} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name")
def q5(spark: SparkSession, d: str) -> DataFrame:
    c, o, li, s, n, r = tables(spark, d, "customer", "orders", "lineitem", "supplier", "nation", "region")
    o = o.where("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1998-01-01'")
    sup = s.join(n, s.s_nationkey == n.n_nationkey).join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(sup, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(total(revenue(), 4).alias("revenue"))


@query("q6_forecast_revenue", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6(spark: SparkSession, d: str) -> DataFrame:
    (li,) = tables(spark, d, "lineitem")
    return li.where("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1998-01-01' and l_discount between 0.05D and 0.07D and l_quantity < 24").agg(total(units("l_extendedprice") * units("l_discount"), 4).alias("revenue"))


@query("q7_volume_shipping", f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, {SUM_REV} AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) GROUP BY 1, 2, 3")
def q7(spark: SparkSession, d: str) -> DataFrame:
    s, li, o, c, n = tables(spark, d, "supplier", "lineitem", "orders", "customer", "nation")
    two = n.where("n_name in ('NATION_1', 'NATION_2')")
    a = s.join(two.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supp_nation")), "s_nationkey")
    b = c.join(two.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cust_nation")), "c_nationkey")
    j = li.join(a, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(b, F.col("o_custkey") == F.col("c_custkey")).where("supp_nation <> cust_nation")
    return j.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").cast("bigint").alias("l_year")).agg(total(revenue(), 4).alias("revenue"))


@query("q8_market_share", f"SELECT o_year, round(CAST(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE), 6) AS mkt_share FROM (SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, {REV} AS volume, n2.n_name AS nation FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') t GROUP BY o_year")
def q8(spark: SparkSession, d: str) -> DataFrame:
    p, s, li, o, c, n, r = tables(spark, d, "part", "supplier", "lineitem", "orders", "customer", "nation", "region")
    home = n.join(r.where("r_name = 'AMERICA'"), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"))
    j = li.join(p.where("p_type = 'ECONOMY'"), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c.join(home, "c_nationkey", "left_semi"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("nation")), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("volume", revenue())
    share = total(F.when(F.col("nation") == "NATION_3", F.col("volume")).otherwise(F.lit(0).cast("bigint")), 4) / total(F.col("volume"), 4)
    return j.groupBy(F.year("o_orderdate").cast("bigint").alias("o_year")).agg(F.round(share, 6).alias("mkt_share"))


@query("q10_returned_items", f"SELECT c_custkey, c_name, {SUM_REV} AS revenue, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
def q10(spark: SparkSession, d: str) -> DataFrame:
    c, o, li, n = tables(spark, d, "customer", "orders", "lineitem", "nation")
    o = o.where("o_orderdate >= timestamp_ntz'1997-10-01' and o_orderdate < timestamp_ntz'1998-01-01'")
    j = li.where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return top_k(j.groupBy("c_custkey", "c_name", "n_name").agg(total(revenue(), 4).alias("revenue")), 20, desc("revenue"), asc("c_custkey"))


@query("q13_customer_distribution", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) t GROUP BY c_count")
def q13(spark: SparkSession, d: str) -> DataFrame:
    c, o = tables(spark, d, "customer", "orders")
    per = c.join(o.where("o_orderpriority <> '1-URGENT'"), c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return per.groupBy("c_count").agg(F.count("*").alias("custdist"))


@query("q14_promotion_effect", f"SELECT round(100.0 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REV} ELSE 0 END) AS DOUBLE) / {SUM_REV}, 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'")
def q14(spark: SparkSession, d: str) -> DataFrame:
    li, p = tables(spark, d, "lineitem", "part")
    j = li.where("l_shipdate >= timestamp_ntz'1997-09-01' and l_shipdate < timestamp_ntz'1997-10-01'").join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("v", revenue())
    promo = total(F.when(F.col("p_type").like("PROMO%"), F.col("v")).otherwise(F.lit(0).cast("bigint")), 4)
    return j.agg(F.round(100.0 * promo / total(F.col("v"), 4), 6).alias("promo_revenue"))


@query("q15_top_supplier", f"WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({REV}) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, CAST(total_revenue AS DOUBLE) AS total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)")
def q15(spark: SparkSession, d: str) -> DataFrame:
    li, s = tables(spark, d, "lineitem", "supplier")
    r = li.where("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1996-04-01'").groupBy(F.col("l_suppkey").alias("supplier_no")).agg(exact_sum(revenue(), 4).alias("total_revenue"))
    r = cut(r)  # one pass over lineitem; a row a supplier is read twice
    best = r.agg(F.max("total_revenue").alias("best"))
    top = r.join(F.broadcast(best), F.col("total_revenue") == F.col("best"))  # one row
    return s.join(top, s.s_suppkey == top.supplier_no).select("s_suppkey", "s_name", F.col("total_revenue").cast("double").alias("total_revenue"))


@query("q17_small_quantity_revenue", "SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / 7.0, 6) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)")
def q17(spark: SparkSession, d: str) -> DataFrame:
    li, p = tables(spark, d, "lineitem", "part")
    p = p.where("p_brand = 'Brand#23'").select("p_partkey")
    own = li.join(p, li.l_partkey == p.p_partkey, "left_semi").select("l_partkey", "l_quantity", "l_extendedprice")
    low = own.groupBy("l_partkey").agg((0.4 * F.avg("l_quantity")).alias("low"))
    return own.join(low, "l_partkey").where("l_quantity < low").agg(F.round(total(units("l_extendedprice"), 2) / 7.0, 6).alias("avg_yearly"))


@query("q18_large_orders", "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 230) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100")
def q18(spark: SparkSession, d: str) -> DataFrame:
    c, o, li = tables(spark, d, "customer", "orders", "lineitem")
    # the HAVING set already holds the sum that the outer query asks for: one pass over lineitem
    big = li.groupBy("l_orderkey").agg(F.sum(units("l_quantity")).alias("q")).where("q > 23000")
    j = o.join(big, o.o_orderkey == big.l_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", (F.col("q") / 100).alias("sum_qty"))
    return top_k(j, 100, desc("o_totalprice"), asc("o_orderdate"), asc("o_orderkey"))


# -- further shapes, through SQL text; where the local tables lack a column, the nearest one stands in -----------------

by_sql("q4_order_priority", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01' AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY) GROUP BY o_orderpriority")
by_sql("q12_status_priority", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_line_count, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_linestatus")
by_sql("q19_discounted_revenue", f"SELECT {SUM_REV} AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_partkey = l_partkey AND p_type = 'ECONOMY' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 10 AND 40)")
by_sql("q21_waiting_suppliers", "SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL 60 DAY AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o_orderdate + INTERVAL 60 DAY) AND s_nationkey = n_nationkey AND n_name IN ('NATION_3', 'NATION_4') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100")
by_sql("q22_sales_opportunity", "SELECT c_nationkey, count(*) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS totacctbal FROM customer c WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND c_nationkey IN (1, 3, 5, 7, 9, 11, 13)) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01') GROUP BY c_nationkey")
by_sql("star_discount_by_year", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem, orders WHERE l_orderkey = o_orderkey AND extract(year FROM o_orderdate) = 1996 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25")
by_sql("star_brand_by_year", f"SELECT {SUM_REV} AS revenue, CAST(extract(year FROM o_orderdate) AS BIGINT) AS d_year, p_brand FROM lineitem, orders, part, supplier, nation, region WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND p_type = 'PROMO' AND r_name = 'AMERICA' GROUP BY extract(year FROM o_orderdate), p_brand")
by_sql("star_nations_by_year", f"SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS d_year, {SUM_REV} AS revenue FROM customer, lineitem, supplier, orders, nation cn, nation sn, region cr, region sr WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND cn.n_regionkey = cr.r_regionkey AND sn.n_regionkey = sr.r_regionkey AND cr.r_name = 'ASIA' AND sr.r_name = 'ASIA' AND extract(year FROM o_orderdate) BETWEEN 1996 AND 1999 GROUP BY cn.n_name, sn.n_name, extract(year FROM o_orderdate)")
by_sql("star_profit_by_segment", f"SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS d_year, c_mktsegment, {SUM_REV} - CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS profit FROM lineitem, orders, customer, supplier, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name IN ('AMERICA', 'EUROPE') GROUP BY extract(year FROM o_orderdate), c_mktsegment")
