"""Grid filters, search, sort and export views; chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.functions.nulls import NARROW_TOKENS, WIDE_TOKENS, null_token
from burnish.functions.numbers import num_prefix, num_whole
from burnish.operators.chart import chart_series, detect_axes, raw_series, scatter_series
from burnish.operators.grid import grid_filter, grid_sort, grid_view, preview, search, visible
from burnish.operators.typing import infer_types, numeric_by_sample
from workload.registry import query, rounded

# Dirt is derived from the given tables, the same way on both sides.
DIRTY_EVENTS = """SELECT event_id, user_id,
    CASE event_id % 10 WHEN 0 THEN 'N/A' WHEN 3 THEN '  ' WHEN 7 THEN ' Unknown '
         ELSE event_type END AS kind,
    CASE event_id % 9 WHEN 0 THEN concat(CAST(CAST(floor(value) AS BIGINT) AS STRING), 'abc')
         WHEN 4 THEN 'n/a' WHEN 5 THEN 'abc' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING)
         END AS reading
    FROM {events}"""

# Fixed values shared with the oracle: the pattern of a leading number.
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def sql_prefix(c: str) -> str:
    return f"TRY_CAST(regexp_extract({c}, '^\\s*({NUMBER})', 1) AS DOUBLE)"


def sql_whole(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '^\\s*{NUMBER}\\s*$') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    )


def sql_null(c: str, tokens=NARROW_TOKENS) -> str:
    words = ", ".join(f"'{t}'" for t in tokens)
    return f"({c} IS NULL OR lower(trim({c})) IN ({words}))"


def _filter(name: str, ids: str, column: str, expression: str, where: str) -> None:
    @query(name, ids, f"SELECT * FROM ({DIRTY_EVENTS}) v WHERE {where}")
    def _(t):
        return grid_filter(t.sql(DIRTY_EVENTS), {column: expression})


_filter("grid_filter_null", "P2 P14", "kind", "null", sql_null("kind"))
_filter("grid_filter_not_empty", "P3 P14", "kind", "!Empty", f"NOT {sql_null('kind')}")
_filter("grid_filter_at_least", "P4 F7", "reading", ">=80", f"{sql_prefix('reading')} >= 80")
_filter("grid_filter_at_most", "P5", "reading", "<= 12.5", f"{sql_prefix('reading')} <= 12.5")
_filter("grid_filter_greater", "P6", "reading", ">200", f"{sql_prefix('reading')} > 200")
_filter("grid_filter_less", "P7", "reading", "<3", f"{sql_prefix('reading')} < 3")
_filter("grid_filter_not_contains", "P8", "kind", "!=IC", "NOT contains(lower(kind), 'ic')")
_filter("grid_filter_equals", "P9", "kind", "=ERROR", "lower(kind) = 'error'")
_filter("grid_filter_contains", "P10", "kind", " Urch ", "contains(lower(kind), 'urch')")


@query(
    "grid_filter_conjunction",
    "P11 P12",
    """SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM {lineitem}
       WHERE l_quantity >= 48 AND l_discount < 0.02 AND lower(l_returnflag) = 'r'""",
)
def _(t):
    filters = {"l_quantity": ">=48", "l_discount": "<0.02", "l_returnflag": "=R",
               "no_such_column": "x", "l_tax": ""}
    return grid_filter(t("lineitem"), filters).select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag"
    )


@query(
    "grid_search_all_columns",
    "P13",
    """SELECT * FROM {part} WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')
       OR contains(lower(p_type), 'red')""",
)
def _(t):
    return search(t("part"), "RED")


@query(
    "grid_null_tokens",
    "P14",
    f"""SELECT event_id, {sql_null('kind')} AS narrow, {sql_null('kind', WIDE_TOKENS)} AS wide
        FROM ({DIRTY_EVENTS}) v""",
)
def _(t):
    kind = F.col("kind")
    return t.sql(DIRTY_EVENTS).select(
        "event_id",
        null_token(kind, NARROW_TOKENS).alias("narrow"),
        null_token(kind, WIDE_TOKENS).alias("wide"),
    )


@query(
    "numeric_parsers",
    "F7 F8",
    f"""SELECT event_id, {sql_prefix('reading')} AS prefix, {sql_whole('reading')} AS whole
        FROM ({DIRTY_EVENTS}) v""",
)
def _(t):
    reading = F.col("reading")
    return t.sql(DIRTY_EVENTS).select(
        "event_id", num_prefix(reading).alias("prefix"), num_whole(reading).alias("whole")
    )


@query(
    "typed_view",
    "N1 N2 P15",
    f"""SELECT event_id, user_id,
               CASE WHEN NOT {sql_null('kind', WIDE_TOKENS)} THEN kind END AS kind,
               CASE WHEN share >= 0.8 THEN num END AS amount,
               CASE WHEN NOT {sql_null('reading', WIDE_TOKENS)} THEN reading END AS reading
        FROM (SELECT *, {sql_whole('amount')} AS num,
                     count({sql_whole('amount')}) OVER () * 1.0 /
                     count(CASE WHEN NOT {sql_null('amount', WIDE_TOKENS)} THEN 1 END) OVER ()
                       AS share
              FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'bad' WHEN event_id % 7 = 0
                    THEN 'NULL' ELSE CAST(event_id AS STRING) END AS amount
                    FROM ({DIRTY_EVENTS}) d) v) w""",
)
def _(t):
    dirty = t.sql(
        f"""SELECT *, CASE WHEN event_id % 13 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN 'NULL'
            ELSE CAST(event_id AS STRING) END AS amount FROM ({DIRTY_EVENTS}) d"""
    )
    return infer_types(dirty).select("event_id", "user_id", "kind", "amount", "reading")


@query(
    "numeric_by_first_rows",
    "P15",
    """SELECT 'event_id' AS "column", true AS grid, true AS chart UNION ALL
       SELECT 'kind', false, false UNION ALL SELECT 'reading', false, false UNION ALL
       SELECT 'user_id', true, true""",
)
def _(t):
    events = t.sql(DIRTY_EVENTS)
    grid = numeric_by_sample(events, 30, ["event_id"])
    chart = numeric_by_sample(events, 20, ["event_id"], need_values=False)
    return t.spark.createDataFrame(
        [(c, grid[c], chart[c]) for c in grid], "column string, grid boolean, chart boolean"
    )


@query(
    "grid_hidden_columns",
    "P1",
    "SELECT c_custkey, c_name, c_mktsegment FROM {customer}",
)
def _(t):
    return visible(t("customer"), hidden=["c_nationkey", "c_acctbal"])


@query(
    "grid_view_export",
    "P1 P12 P13 O3 S10",
    """SELECT p_partkey, p_name, p_size FROM {part}
       WHERE p_size >= 40 AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')
             OR contains(lower(p_type), 'ring'))""",
)
def _(t):
    return grid_view(
        t("part"), {"p_size": ">=40"}, "ring", "p_size", False,
        ["p_brand", "p_type", "p_retailprice"], ["p_partkey"],
    )


@query(
    "grid_sort_numeric_first",
    "O3 P16",
    f"""SELECT event_id, reading FROM (
          SELECT event_id, reading, {sql_prefix('reading')} AS num FROM ({DIRTY_EVENTS}) v) w
        ORDER BY num ASC NULLS LAST, reading, event_id LIMIT 2000""",
)
def _(t):
    ordered = grid_sort(t.sql(DIRTY_EVENTS), "reading", order_by=["event_id"])
    # Equal numbers are ordered by their text, as 5 and 5abc.
    return preview(ordered, 2000).select("event_id", "reading")


@query(
    "grid_sort_natural",
    "O3 P16",
    """SELECT p_brand FROM (SELECT DISTINCT p_brand FROM {part}) b
       ORDER BY CAST(substr(p_brand, 7) AS INT) DESC LIMIT 10""",
)
def _(t):
    brands = t("part").select("p_brand").distinct()
    return grid_sort(brands, "p_brand", ascending=False).limit(10)


@query(
    "grid_first_rows",
    "P16",
    "SELECT * FROM {customer} ORDER BY c_custkey LIMIT 10",
)
def _(t):
    return preview(t("customer"), 10, ["c_custkey"])


PRICES = """SELECT l_orderkey, l_partkey, l_suppkey,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE concat(l_returnflag, l_linenumber) END AS grp,
    CASE l_linenumber WHEN 1 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS STRING), ' units')
         WHEN 2 THEN 'none' WHEN 3 THEN 'A' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END
      AS qty
    FROM {lineitem}"""
_POINTS = f"SELECT coalesce(grp, '') AS label, {sql_prefix('qty')} AS y FROM ({PRICES}) v"


def _chart(agg: str, ids: str, value: str) -> None:
    @query(
        f"chart_{agg}",
        ids,
        f"SELECT label, {value} AS value FROM ({_POINTS}) p GROUP BY label",
    )
    def _(t):
        return rounded(chart_series(t.sql(PRICES), "grp", "qty", agg, max_groups=5000))


_chart("sum", "A10 A16", "round(coalesce(sum(y), 0), 4)")
_chart("avg", "A11", "round(coalesce(avg(y), 0), 4)")
_chart("count", "A12", "count(y)")
_chart("min", "A14", "coalesce(min(y), 0)")
_chart("max", "A15", "coalesce(max(y), 0)")


@query(
    "chart_median",
    "A13 G6",
    """WITH r AS (SELECT o_orderpriority AS label, o_totalprice AS y,
                 row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn,
                 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM {orders})
       SELECT label, y AS value FROM r WHERE rn = floor(n / 2) + 1""",
)
def _(t):
    return chart_series(t("orders"), "o_orderpriority", "o_totalprice", "median")


@query(
    "chart_median_many_groups",
    "A13 O5",
    f"""WITH p AS ({_POINTS}),
        g AS (SELECT label, round(coalesce(sum(y), 0), 4) AS total FROM p GROUP BY label
              ORDER BY total DESC, label LIMIT 12),
        r AS (SELECT label, y, row_number() OVER (PARTITION BY label ORDER BY y) AS rn,
                     count(*) OVER (PARTITION BY label) AS n FROM p WHERE y IS NOT NULL)
        SELECT g.label, coalesce(r.y, 0) AS value FROM g
        LEFT JOIN r ON g.label = r.label AND r.rn = floor(r.n / 2) + 1""",
)
def _(t):
    return chart_series(t.sql(PRICES), "grp", "qty", "median", "desc", 12)


@query(
    "chart_top_groups_by_sum",
    "O4 O5 A16",
    """SELECT CAST(l_suppkey AS VARCHAR) AS label, round(avg(l_extendedprice), 4) AS value
       FROM {lineitem} GROUP BY l_suppkey
       ORDER BY round(sum(l_extendedprice), 4) DESC, CAST(l_suppkey AS VARCHAR) LIMIT 50""",
)
def _(t):
    return chart_series(t("lineitem"), "l_suppkey", "l_extendedprice", "avg", "desc")


@query(
    "chart_smallest_groups",
    "O4 O5",
    """SELECT CAST(o_custkey AS VARCHAR) AS label, count(*) AS value FROM {orders}
       GROUP BY o_custkey ORDER BY round(sum(o_totalprice), 4), CAST(o_custkey AS VARCHAR) LIMIT 30""",
)
def _(t):
    return chart_series(t("orders"), "o_custkey", "o_totalprice", "count", "asc", 30)


@query(
    "chart_first_seen_groups",
    "A16 O5",
    """SELECT CAST(o_custkey AS VARCHAR) AS label, round(sum(o_totalprice), 4) AS value
       FROM {orders} GROUP BY o_custkey ORDER BY min(o_orderkey), 1 LIMIT 50""",
)
def _(t):
    return chart_series(t("orders"), "o_custkey", "o_totalprice", order_by=["o_orderkey"])


@query(
    "chart_raw_series",
    "A17",
    f"""SELECT kind AS label, coalesce({sql_prefix('reading')}, 0) AS value
        FROM ({DIRTY_EVENTS}) v ORDER BY event_id LIMIT 50""",
)
def _(t):
    return raw_series(t.sql(DIRTY_EVENTS), "kind", "reading", order_by=["event_id"])


@query(
    "chart_scatter",
    "A18",
    f"""SELECT CAST(user_id AS DOUBLE) AS x, coalesce({sql_prefix('reading')}, 0) AS y
        FROM ({DIRTY_EVENTS}) v ORDER BY event_id LIMIT 500""",
)
def _(t):
    return scatter_series(t.sql(DIRTY_EVENTS), "user_id", "reading", 500, ["event_id"])


@query(
    "chart_axes",
    "A19",
    """SELECT CASE WHEN a THEN 'c_name' ELSE 'c_custkey' END AS x,
              CASE WHEN a THEN 'c_custkey' WHEN b THEN 'c_name' END AS y
       FROM (SELECT count(*) = count(try_cast(c_custkey AS DOUBLE)) AS a,
                    count(*) = count(try_cast(c_name AS DOUBLE)) AS b
             FROM (SELECT * FROM {customer} ORDER BY c_custkey LIMIT 20) h) v""",
)
def _(t):
    x, y = detect_axes(t("customer"), ["c_custkey"])
    return t.spark.createDataFrame([(x, y)], "x string, y string")
