"""Queries of group 10: general relational capability on the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.operators import intervals, relational
from sievework.plans.registry import query
from sievework.sources.files import table

REV = "l_extendedprice * (1 - l_discount)"


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("g_q1", f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({REV}), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL")
def g_q1(s, d):
    r = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return r.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(revenue()), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("g_q3", f"SELECT l_orderkey, round(sum({REV}), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
def g_q3(s, d):
    at = F.lit("1998-03-15").cast("timestamp_ntz")
    o = table(s, d, "orders").where(F.col("o_orderdate") < at).join(table(s, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    j = table(s, d, "lineitem").where(F.col("l_shipdate") > at).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("g_q5", f"SELECT n_name, round(sum({REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def g_q5(s, d):
    n = table(s, d, "nation").join(table(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = table(s, d, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


@query("g_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24")
def g_q6(s, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    t = F.col("l_shipdate")
    r = table(s, d, "lineitem").where((t >= at("1996-01-01")) & (t < at("1998-01-01")) & F.col("l_discount").between(0.045, 0.075) & (F.col("l_quantity") < 24))
    return r.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("g_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def g_cube(s, d):
    return table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("g_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def g_grouping_sets(s, d):
    t = table(s, d, "orders")
    return t.groupingSets([[t.o_orderstatus], [t.o_orderpriority]], t.o_orderstatus, t.o_orderpriority).agg(F.count(F.lit(1)).alias("n"))


@query("g_theta_join", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def g_theta_join(s, d):
    n = table(s, d, "nation")
    a, b = n.select(F.col("n_name").alias("left_name"), "n_regionkey", F.col("n_nationkey").alias("k")), n.select(F.col("n_name").alias("right_name"), "n_regionkey", F.col("n_nationkey").alias("m"))
    return a.join(b, "n_regionkey").where("k < m").select("left_name", "right_name")


@query("g_asof_join", "SELECT p.event_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def g_asof_join(s, d):
    e = table(s, d, "events")
    return relational.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'"), "user_id", "ts", "value", "last_view", width=6 * 3600).select("event_id", "last_view")


@query("g_lag_ntile", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id)::INTEGER AS quarter FROM events")
def g_lag_ntile(s, d):
    w = Window.partitionBy("user_id")
    return table(s, d, "events").select("event_id", F.lag("value").over(w.orderBy("ts", "event_id")).alias("before"), F.ntile(4).over(w.orderBy("value", "event_id")).alias("quarter"))


@query("g_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def g_range_frame(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp")).alias("t"))
    return e.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-86400, 0)).alias("n"))


@query("g_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def g_intersect(s, d):
    o = table(s, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("g_correlated", "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey)")
def g_correlated(s, d):
    """Spark SQL with a correlated subquery over a view."""
    table(s, d, "customer").createOrReplaceTempView("sievework_customer")
    return s.sql("SELECT c_custkey FROM sievework_customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM sievework_customer x WHERE x.c_nationkey = c.c_nationkey)")


@query("g_cte", "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT count(*) AS n, round(max(total), 2) AS most FROM t WHERE total > (SELECT avg(total) FROM t)")
def g_cte(s, d):
    table(s, d, "orders").createOrReplaceTempView("sievework_orders")
    return s.sql("WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM sievework_orders GROUP BY 1) SELECT count(*) AS n, round(max(total), 2) AS most FROM t WHERE total > (SELECT avg(total) FROM t)")


@query("g_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 500 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def g_full_outer(s, d):
    a = table(s, d, "customer").where("c_acctbal < 500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("g_distinct_agg", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def g_distinct_agg(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("g_date_parts", "SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, count(*) AS n FROM orders GROUP BY ALL")
def g_date_parts(s, d):
    return table(s, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))


SPANS = "SELECT event_id AS {0}_id, epoch_us(ts) AS {0}_from, epoch_us(ts) + 1000000 * (60 + (user_id % 7) * {1}) AS {0}_to FROM events WHERE event_type = '{2}'"


@query("g_interval_join", f"SELECT error_id, click_id FROM ({SPANS.format('error', 600, 'error')}) JOIN ({SPANS.format('click', 30, 'click')}) ON error_from < click_to AND click_from < error_to")
def g_interval_join(s, d):
    """Errors and clicks whose spans overlap, without any key that is equal."""
    def spans(name, step):
        e = table(s, d, "events").where(F.col("event_type") == name)
        begin = F.unix_micros(F.col("ts").cast("timestamp"))
        return e.select(F.col("event_id").alias(f"{name}_id"), begin.alias(f"{name}_from"), (begin + 1_000_000 * (60 + F.col("user_id") % 7 * step)).alias(f"{name}_to"))

    return intervals.overlap_join(spans("error", 600), spans("click", 30), ("error_from", "error_to"), ("click_from", "click_to")).select("error_id", "click_id")


@query("g_interval_join_key", """WITH o AS (SELECT o_custkey, o_orderkey, datediff('day', TIMESTAMP '1970-01-01', o_orderdate) AS lo, datediff('day', TIMESTAMP '1970-01-01', o_orderdate) + 1 + o_orderkey % 90 AS hi FROM orders)
SELECT a.o_custkey, a.o_orderkey AS one, b.o_orderkey AS other FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.lo < b.hi AND b.lo < a.hi""")
def g_interval_join_key(s, d):
    """Orders of one customer that are open at the same time."""
    def open_orders(name):
        lo = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
        return table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias(name), lo.alias(f"{name}_lo"), (lo + 1 + F.col("o_orderkey") % 90).alias(f"{name}_hi"))

    out = intervals.overlap_join(open_orders("one"), open_orders("other"), ("one_lo", "one_hi"), ("other_lo", "other_hi"), ["o_custkey"])
    return out.where("one < other").select("o_custkey", "one", "other")
