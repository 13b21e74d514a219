"""Projections, joins, aggregates, windows, sorts and set operations in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators.chart import chart_series
from burnish.operators.relations import keep_in, keep_not_in, over_groups
from burnish.sources.catalog import register
from burnish.sql import quick_preview, run_sql, save_result
from workload.registry import query, same_sql

same_sql(
    "sql_projection_arithmetic",
    "P17 F1 F2 L1",
    """SELECT l_orderkey, l_linenumber, 'x' AS tag, 7 AS seven,
              round(l_extendedprice * (1 - l_discount), 4) AS net,
              abs(l_discount - l_tax) > 0.05 AS wide_gap
       FROM {lineitem}""",
)
same_sql(
    "sql_star_of_two_tables",
    "P17 J1",
    """SELECT a.*, b.* FROM {nation} a INNER JOIN {region} b ON a.n_regionkey = b.r_regionkey""",
)
same_sql(
    "sql_where_connectives",
    "P18",
    """SELECT event_id, event_type, value FROM {events}
       WHERE (value > 50 AND NOT event_type = 'click') OR (value <= 1 AND user_id <> 8)""",
)
same_sql(
    "sql_null_tests",
    "P19 F6",
    """SELECT count(*) AS n,
              sum(CASE WHEN d IS NULL THEN 1 ELSE 0 END) AS missing,
              sum(CASE WHEN d IS NOT NULL THEN 1 ELSE 0 END) AS present,
              round(sum(coalesce(d, t, 0)), 4) AS filled
       FROM (SELECT nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS t FROM {lineitem}) v""",
)
same_sql(
    "sql_in_between_like",
    "P20",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM {orders}
       WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW')
         AND o_totalprice BETWEEN 50000 AND 200000 AND o_orderpriority LIKE '%-%I%'""",
)
same_sql(
    "sql_in_subquery",
    "P20 J4",
    """SELECT c_custkey, c_name FROM {customer}
       WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000)""",
)

@query(
    "sql_not_in_subquery",
    "P20 J4",
    """SELECT c_custkey, c_mktsegment FROM {customer}
       WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)""",
)
def _(t):
    rich = t("orders").filter("o_totalprice > 300000").select("o_custkey")
    return keep_not_in(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", rich)


@query(
    "sql_not_in_with_null",
    "P20 J4",
    """SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM {orders})
       UNION ALL SELECT s_suppkey FROM {supplier}
       WHERE s_suppkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice < 0)""",
)
def _(t):
    orders = t("orders")
    some = orders.selectExpr("nullif(o_custkey, 1)")
    none = orders.filter("o_totalprice < 0").select("o_custkey")
    kept = keep_not_in(t("customer").select("c_custkey"), "c_custkey", some)
    return kept.unionAll(keep_not_in(t("supplier").select("s_suppkey"), "s_suppkey", none))


@query(
    "in_list_of_rows",
    "P20 J4",
    """SELECT c_custkey, c_nationkey FROM {customer}
       WHERE c_nationkey IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal < 0)""",
)
def _(t):
    nations = t("supplier").filter("s_acctbal < 0").select("s_nationkey")
    return keep_in(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", nations)


same_sql(
    "sql_case",
    "P21",
    """SELECT c_custkey,
              CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END
                AS band,
              CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS building
       FROM {customer}""",
)
same_sql(
    "sql_cte",
    "P22 A1 A6",
    """WITH monthly AS (
         SELECT o_custkey, year(o_orderdate) AS y, month(o_orderdate) AS m,
                sum(o_totalprice) AS spent
         FROM {orders} GROUP BY o_custkey, year(o_orderdate), month(o_orderdate)),
       best AS (SELECT o_custkey, max(spent) AS top FROM monthly GROUP BY o_custkey)
       SELECT o_custkey, round(top, 4) AS top FROM best WHERE top > 300000""",
)
same_sql(
    "sql_inner_join",
    "J1 A6",
    """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 4) AS revenue
       FROM {customer} JOIN {orders} ON c_custkey = o_custkey
       JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name""",
)
same_sql(
    "sql_left_join",
    "J2 A5",
    """SELECT c_custkey, count(o_orderkey) AS orders
       FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F'
       GROUP BY c_custkey""",
)
same_sql(
    "sql_right_join",
    "J3",
    """SELECT c_custkey, c_mktsegment, o_orderkey
       FROM (SELECT * FROM {orders} WHERE o_totalprice > 450000) o
       RIGHT JOIN {customer} ON c_custkey = o_custkey""",
)
same_sql(
    "sql_group_by",
    "A1 A4 A5 A6 A7 A8",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(nullif(l_tax, 0)) AS taxed,
              round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
              min(l_discount) AS min_disc, max(l_discount) AS max_disc
       FROM {lineitem} GROUP BY l_returnflag, l_linestatus""",
)
same_sql(
    "sql_group_by_null_key",
    "A1",
    """SELECT nullif(l_discount, 0) AS discount, count(*) AS n
       FROM {lineitem} GROUP BY nullif(l_discount, 0)""",
)
same_sql(
    "sql_global_aggregate",
    "A2 A4 A8",
    """SELECT count(*) AS n, min(p_name) AS first_name, max(p_name) AS last_name,
              round(avg(p_retailprice), 4) AS avg_price FROM {part}""",
)
_HAVING = """SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 4) AS total
       FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 5 AND avg(l_discount) > 0.05"""
_EXACT = "try_cast(l_discount AS DECIMAL(38, 18))"


@query("sql_having", "A3", _HAVING)
def _(t):
    # Sums of doubles depend on the order of the rows, which decides for means of 0.05 exactly.
    mean = f"""coalesce(if(count({_EXACT}) = count(l_discount), try_avg({_EXACT}), NULL),
                        avg(l_discount))"""
    return t.sql(_HAVING.replace("avg(l_discount)", mean))


same_sql(
    "sql_distinct",
    "A9",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}",
)
same_sql(
    "sql_row_number",
    "W1",
    """SELECT o_custkey, o_orderkey, rn FROM (
         SELECT o_custkey, o_orderkey,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)
                  AS rn
         FROM {orders}) v WHERE rn <= 3""",
)

@query(
    "sql_window_partition_aggregate",
    "W3",
    """SELECT p_partkey, p_brand, p_size,
              round(sum(p_retailprice) OVER (PARTITION BY p_brand, p_size), 4) AS peer_total,
              count(*) OVER (PARTITION BY p_brand, p_size) AS peers
       FROM {part}""",
)
def _(t):
    peers = {"peer_total": F.round(F.sum("p_retailprice"), 4), "peers": F.count("*")}
    part = t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return over_groups(part, peers, ["p_brand", "p_size"]).drop("p_retailprice")


@query(
    "window_over_null_key",
    "W3",
    """SELECT l_orderkey, l_partkey, l_suppkey, discount,
              count(*) OVER (PARTITION BY discount) AS peers
       FROM (SELECT *, nullif(l_discount, 0) AS discount FROM {lineitem}) v""",
)
def _(t):
    rows = t.sql(
        "SELECT l_orderkey, l_partkey, l_suppkey, nullif(l_discount, 0) AS discount FROM {lineitem}"
    )
    return over_groups(rows, {"peers": F.count("*")}, ["discount"])


@query(
    "sql_deviation_from_mean",
    "W2 F1",
    """SELECT event_id, round(abs(value - avg(value) OVER ()), 4) AS deviation FROM {events}""",
)
def _(t):
    events = over_groups(t("events").select("event_id", "value"), {"mean": F.avg("value")})
    deviation = F.round(F.abs(F.col("value") - F.col("mean")), 4)
    return events.select("event_id", deviation.alias("deviation"))


same_sql(
    "sql_order_by_limit",
    "O1 O2",
    """SELECT l_orderkey, l_partkey, l_extendedprice FROM {lineitem}
       ORDER BY l_extendedprice DESC, l_orderkey ASC, l_partkey ASC LIMIT 25""",
)
same_sql(
    "sql_limit_offset",
    "O1 O2",
    """SELECT c_custkey, c_acctbal AS balance FROM {customer}
       ORDER BY balance DESC NULLS LAST, 1 LIMIT 20 OFFSET 15""",
)
same_sql(
    "sql_union",
    "U1",
    """SELECT n_nationkey AS k, n_name AS name FROM {nation}
       UNION SELECT c_nationkey AS k, n_name AS name FROM {customer}
       JOIN {nation} ON c_nationkey = n_nationkey""",
)
same_sql(
    "sql_union_all",
    "U2",
    """SELECT c_nationkey AS k, c_acctbal AS balance FROM {customer}
       UNION ALL SELECT s_nationkey AS k, s_acctbal AS balance FROM {supplier}""",
)
same_sql(
    "sql_scalar_functions",
    "F1 F2 F3 F4 F5 F6",
    """SELECT p_partkey, abs(500 - p_size) AS away, round(p_retailprice / 7, 3) AS share,
              upper(p_name) AS up, lower(p_brand) AS low, length(p_type) AS n,
              coalesce(nullif(p_type, 'ECONOMY'), 'none') AS kind
       FROM {part}""",
)


@query(
    "sql_example_top_revenue",
    "A1 A6 A7 A4 O1 O2 L1",
    """SELECT l_returnflag AS region, l_linenumber AS category,
              round(sum(l_extendedprice), 4) AS revenue, round(avg(l_tax), 4) AS avg_profit,
              count(*) AS orders
       FROM {lineitem} GROUP BY l_returnflag, l_linenumber ORDER BY revenue DESC LIMIT 20""",
)
def _(t):
    register(t("lineitem"), "line items.csv")
    return run_sql(
        t.spark,
        """SELECT l_returnflag AS region, l_linenumber AS category,
                  round(sum(l_extendedprice), 4) AS revenue, round(avg(l_tax), 4) AS avg_profit,
                  count(*) AS orders
           FROM line_items GROUP BY l_returnflag, l_linenumber ORDER BY revenue DESC LIMIT 20""",
    )


@query(
    "sql_quick_preview",
    "L2 P16 S5",
    """SELECT least(50, (SELECT count(*) FROM {orders})) AS shown,
              (SELECT count(*) FROM (SELECT DISTINCT * FROM {orders} LIMIT 50) v) AS own""",
)
def _(t):
    # which rows are shown is open; they must be different rows of the table
    register(t("orders"), "orders")
    columns = t("orders").columns
    known = t("orders").distinct().withColumn("__own", F.lit(True))
    marked = quick_preview(t.spark, "orders").join(known, columns, "left")
    own = F.count_distinct(F.when(F.col("__own"), F.struct(*columns)))
    return marked.agg(F.count("*").alias("shown"), own.alias("own"))


@query(
    "sql_result_to_chart",
    "L3 S12 A16",
    """SELECT o_orderpriority AS label, CAST(max(n) AS DOUBLE) AS value FROM (
         SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n
         FROM {orders} GROUP BY o_orderpriority, year(o_orderdate)) v GROUP BY 1""",
)
def _(t):
    result = t.sql(
        """SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n
           FROM {orders} GROUP BY o_orderpriority, year(o_orderdate)"""
    )
    name = save_result(result, "orders per year")
    return chart_series(t.spark.table(name), "o_orderpriority", "n", "max")
