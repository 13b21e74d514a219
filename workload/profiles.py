"""Table quality, column profiles, quick statistics, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.functions.nulls import WIDE_TOKENS
from burnish.operators.column_stats import column_stats, grid_histogram, top_prefixes
from burnish.operators.compare import (
    compare_columns,
    compare_first_rows,
    compare_shape,
    compare_stats,
)
from burnish.operators.frequency import duplicate_rows, modes, top_values
from burnish.operators.profile import profile
from burnish.operators.quality import profile_summary, table_quality
from burnish.plans.fused import small_table
from burnish.plans.quantiles import exact_quantiles
from burnish.sources.catalog import list_tables, register
from burnish.sources.sinks import compare_report, profile_report
from workload.grid_and_chart import DIRTY_EVENTS, sql_null, sql_prefix
from workload.registry import query, rounded

GAPPY = """SELECT l_orderkey, l_partkey, l_suppkey, nullif(l_discount, 0) AS discount,
    nullif(l_tax, 0) AS tax, l_extendedprice AS price, l_quantity AS quantity,
    l_returnflag AS flag FROM {lineitem}"""


def per_column(columns: list[str], select: str, source: str) -> str:
    """One SELECT per column; ``$c`` is the column."""
    parts = [
        f"SELECT '{c}' AS \"column\", " + select.replace("$c", c) + f" FROM ({source}) v"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


@query(
    "table_quality",
    "Q1 Q2 Q3 Q4",
    f"""SELECT rows, 4 AS cols, nulls, CAST(floor((1 - nulls / (rows * 4.0)) * 100 + 0.5) AS BIGINT)
               AS completeness, duplicates
        FROM (SELECT count(*) AS rows,
                     CAST(sum(CASE WHEN {sql_null('kind')} THEN 1 ELSE 0 END
                         + CASE WHEN {sql_null('reading')} THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
                     count(*) - (SELECT count(*) FROM (SELECT DISTINCT u, kind, reading, o FROM
                       (SELECT user_id % 5 AS u, kind, reading, 1 AS o FROM ({DIRTY_EVENTS}) a) b) c)
                       AS duplicates
              FROM ({DIRTY_EVENTS}) v) w""",
)
def _(t):
    events = t.sql(f"SELECT user_id % 5 AS u, kind, reading, 1 AS o FROM ({DIRTY_EVENTS}) v")
    return table_quality(events).withColumn("cols", F.col("cols").cast("int"))


@query(
    "duplicate_documents",
    "Q4 R26",
    """SELECT count(*) AS rows, count(DISTINCT text) AS distinct_rows,
              count(*) - count(DISTINCT text) AS duplicates FROM {documents}""",
)
def _(t):
    return duplicate_rows(t("documents"), ["text"])


@query(
    "list_tables_with_shape",
    "S9 S4 S5",
    """SELECT 'nation' AS "table", (SELECT count(*) FROM {nation}) AS rows, 3 AS cols, 0 AS nulls,
              100 AS completeness, 0 AS duplicates
       UNION ALL SELECT 'customer', (SELECT count(*) FROM {customer}), 5, 0, 100, 0
       UNION ALL SELECT 'part_brands', (SELECT count(*) FROM {part}), 2, 0, 100,
         (SELECT count(*) FROM {part}) -
         (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type FROM {part}) d)""",
)
def _(t):
    register(t("nation"), "nation")
    register(t("customer"), "customer")
    register(t("part").select("p_brand", "p_type"), "part brands.csv")
    out = list_tables(t.spark, ["nation", "customer", "part_brands"])
    return out.select(
        "table", "rows", "duplicates",
        *[F.col(c).cast("int").alias(c) for c in ("cols", "nulls", "completeness")],
    )


_CORE = """count(*) AS total, count($c) AS non_null, count(*) - count($c) AS null_count,
    round((count(*) - count($c)) * 100.0 / count(*), 2) AS null_pct,
    count(DISTINCT $c) AS "unique", 'numeric' AS type,
    round(count($c) * 100.0 / count(*), 2) AS completeness,
    CAST(min($c) AS DOUBLE) AS min, CAST(max($c) AS DOUBLE) AS max,
    round(round(avg($c), 6), 4) AS mean, round(quantile_cont($c, 0.5), 4) AS median,
    round(round(stddev_samp($c), 6), 4) AS std, round(round(var_samp($c), 6), 4) AS variance,
    round(quantile_cont($c, 0.25), 4) AS q1, round(quantile_cont($c, 0.75), 4) AS q3,
    round(round(quantile_cont($c, 0.75) - quantile_cont($c, 0.25), 6), 4) AS iqr"""
CORE = ("column type total non_null null_count null_pct unique completeness min max mean median "
        "std variance q1 q3 iqr").split()


@query(
    "profile_numeric_core",
    "R1 R2 R3 R4 R5 R6 R7 R8 R9 R10 R11 R12 R13",
    per_column(["discount", "tax", "quantity"], _CORE, GAPPY),
)
def _(t):
    found = profile(t.sql(GAPPY), ["discount", "tax", "quantity"])
    return rounded(found.select(*CORE))


_SHAPE = """round(skewness($c), 4) AS skewness, round(kurtosis($c), 4) AS kurtosis,
    (SELECT count(*) FROM ($src) s, (SELECT quantile_cont($c, 0.25) AS a, quantile_cont($c, 0.75) AS b
       FROM ($src) q) f WHERE s.$c < a - 1.5 * (b - a) OR s.$c > b + 1.5 * (b - a)) AS outliers_iqr,
    (SELECT count(*) FROM ($src) s, (SELECT avg($c) AS m, stddev_pop($c) AS sd FROM ($src) q) f
       WHERE abs((s.$c - m) / sd) > 3) AS outliers_z,
    round(sum($c), 4) AS sum, CAST(sum(CASE WHEN $c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros,
    CAST(sum(CASE WHEN $c < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
    round(quantile_cont($c, 0.05), 4) AS p5, round(quantile_cont($c, 0.95), 4) AS p95"""
SHAPE = "column skewness kurtosis outliers_iqr outliers_z sum zeros negatives p5 p95".split()


@query(
    "profile_numeric_shape",
    "R14 R15 R16 R17 R18 R19 R20 R21",
    per_column(["value"], _SHAPE.replace("$src", "SELECT value FROM {events}"), "SELECT value FROM {events}")
    + " UNION ALL "
    + per_column(["c_acctbal"], _SHAPE.replace("$src", "SELECT c_acctbal FROM {customer}"),
                 "SELECT c_acctbal FROM {customer}"),
)
def _(t):
    a = profile(t("events"), ["value"])
    b = profile(t("customer"), ["c_acctbal"])
    return rounded(a.unionByName(b).select(*SHAPE))


@query(
    "profile_histogram",
    "R22",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM {events}),
       b AS (SELECT value, lo, (hi - lo) / 20 AS w,
                    least(19, CAST(floor((value - lo) / (hi - lo) * 20) AS INT)) AS i
             FROM {events}, e),
       c AS (SELECT CASE WHEN value < lo + i * w THEN i - 1
                         WHEN i < 19 AND value >= lo + (i + 1) * w THEN i + 1 ELSE i END AS bin
             FROM b)
       SELECT s.bin, count(c.bin) AS n FROM (SELECT unnest(range(20)) AS bin) s
       LEFT JOIN c ON s.bin = c.bin GROUP BY s.bin""",
)
def _(t):
    found = profile(t("events"), ["value"])
    bins = found.select(F.posexplode("histogram.counts").alias("bin", "n"))
    return bins.select(F.col("bin").cast("bigint").alias("bin"), "n")


_TEXT = """count(*) AS total, count($c) AS non_null, count(DISTINCT $c) AS "unique",
    'text' AS type, round(avg(length($c)), 1) AS avg_length"""


@query(
    "profile_text",
    "R5 R24 R25 R4",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + _TEXT.replace("$c", c)
        + f", (SELECT {c} FROM {{part}} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode"
        + " FROM {part}"
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def _(t):
    found = profile(t("part"), ["p_name", "p_brand", "p_type"])
    return found.select("column", "total", "non_null", "unique", "type", "avg_length", "mode")


@query(
    "profile_mixed_raw_text",
    "N1 N2 P15 R2 R5",
    f"""SELECT 'kind' AS "column", 'text' AS type,
              sum(CASE WHEN {sql_null('kind', WIDE_TOKENS)} THEN 1 ELSE 0 END)::BIGINT AS null_count,
              count(DISTINCT CASE WHEN NOT {sql_null('kind', WIDE_TOKENS)} THEN kind END) AS "unique"
        FROM ({DIRTY_EVENTS}) v
        UNION ALL
        SELECT 'reading', CASE WHEN count(TRY_CAST(reading AS DOUBLE)) >= 0.7 *
                 count(CASE WHEN NOT {sql_null('reading', WIDE_TOKENS)} THEN 1 END)
               THEN 'numeric' ELSE 'text' END,
               sum(CASE WHEN {sql_null('reading', WIDE_TOKENS)} THEN 1 ELSE 0 END)::BIGINT,
               count(DISTINCT CASE WHEN NOT {sql_null('reading', WIDE_TOKENS)} THEN reading END)
        FROM ({DIRTY_EVENTS}) v""",
)
def _(t):
    found = profile(t.sql(DIRTY_EVENTS), ["kind", "reading"])
    return found.select("column", "type", "null_count", "unique")


@query(
    "top_values",
    "R23 O6",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", value, n, rank FROM (SELECT {c} AS value, count(*) AS n,
            row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {{orders}} GROUP BY {c}) v
            WHERE rank <= 10"""
        for c in ("o_orderpriority", "o_orderstatus")
    ),
)
def _(t):
    found = top_values(t("orders"), ["o_orderpriority", "o_orderstatus"])
    return found.select("column", "value", "n", F.col("rank").cast("bigint").alias("rank"))


@query(
    "top_long_texts",
    "R23 O6",
    """SELECT value, n FROM (SELECT text AS value, count(*) AS n FROM {documents} GROUP BY text) v
       ORDER BY n DESC, value LIMIT 10""",
)
def _(t):
    return top_values(t("documents"), ["text"]).select("value", "n")


@query(
    "mode_of_long_texts",
    "R24 M6",
    """SELECT g, value FROM (SELECT doc_id % 3 AS g, text AS value, row_number() OVER
         (PARTITION BY doc_id % 3 ORDER BY count(*) DESC, text) AS r
       FROM (SELECT doc_id, concat(repeat('one opening for every text ', 4), text) AS text
             FROM {documents} WHERE text IS NOT NULL) d GROUP BY doc_id % 3, text) v WHERE r = 1""",
)
def _(t):
    docs = t.sql(
        """SELECT doc_id % 3 AS g, concat(repeat('one opening for every text ', 4), text) AS text
           FROM {documents} WHERE text IS NOT NULL"""
    )
    found = modes(docs, {str(g): F.when(F.col("g") == g, F.col("text")) for g in range(3)})
    return small_table(t.spark, [(int(g), v) for g, v in found.items()], "g bigint, value string")


_ENDLESS = """SELECT CASE l_partkey % 10 WHEN 0 THEN CAST('Infinity' AS DOUBLE)
         WHEN 1 THEN CAST('-Infinity' AS DOUBLE) ELSE l_extendedprice END AS price,
       CASE WHEN l_suppkey % 5 > 1 THEN CAST('Infinity' AS DOUBLE)
         ELSE l_quantity * 1.0 END AS quantity FROM {lineitem}"""


@query(
    "quantiles_with_infinite_values",
    "R9 R12 G6",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.2), 4) AS low,
            round(quantile_cont({c}, 0.3), 4) AS middle FROM ({_ENDLESS}) v"""
        for c in ("price", "quantity")
    ),
)
def _(t):
    rows = t.sql(_ENDLESS)
    found = exact_quantiles(rows, {c: F.col(c) for c in rows.columns}, (0.2, 0.3))
    return rounded(
        small_table(
            t.spark,
            [(c, *v) for c, v in found.items()],
            "column string, low double, middle double",
        )
    )


@query(
    "profile_quality_summary",
    "Q5 Q6",
    """SELECT round((round(count(discount) * 100.0 / count(*), 2)
                     + round(count(quantity) * 100.0 / count(*), 2)
                     + round(count(flag) * 100.0 / count(*), 2)) / 3, 1) AS avg_completeness,
              2 AS numeric_columns, 1 AS text_columns
       FROM ("""
    + GAPPY
    + ") v",
)
def _(t):
    summary = profile_summary(profile(t.sql(GAPPY), ["discount", "quantity", "flag"]))
    return summary.select(
        "avg_completeness",
        F.col("numeric_columns").cast("int").alias("numeric_columns"),
        F.col("text_columns").cast("int").alias("text_columns"),
    )


def _index_quantiles(num: str, source: str) -> str:
    """Elements at floor(n * q) of the sorted numbers."""
    picks = ", ".join(
        f"max(CASE WHEN rn = floor(n * {q}) + 1 THEN x END) AS {name}"
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    )
    return f"""(SELECT {picks} FROM (SELECT x, row_number() OVER (ORDER BY x) AS rn,
        count(*) OVER () AS n FROM (SELECT {num} AS x FROM ({source}) s) a WHERE x IS NOT NULL) b)"""


_READINGS = f"SELECT * FROM ({DIRTY_EVENTS}) d WHERE TRUE"
_NUM = f"CASE WHEN NOT {sql_null('reading')} THEN {sql_prefix('reading')} END"


@query(
    "column_stats_numeric",
    "G1 G2 G3 G4 G5 G6 G7 G8",
    f"""SELECT 'reading' AS "column", 'numeric' AS type, total, non_null, total - non_null AS nulls,
               CAST(floor((total - non_null) * 100.0 / total + 0.5) AS BIGINT) AS null_pct, "unique",
               min, max, round(mean, 4) AS mean, f.median, round(std, 4) AS std, f.q1, f.q3,
               (SELECT count(*) FROM (SELECT {_NUM} AS x FROM ({_READINGS}) o) p
                WHERE x < f.q1 - 1.5 * (f.q3 - f.q1) OR x > f.q3 + 1.5 * (f.q3 - f.q1)) AS outliers,
               round(sum, 4) AS sum, round(third / (std * std * std), 4) AS skew
        FROM (SELECT count(*) AS total, count(CASE WHEN NOT {sql_null('reading')} THEN 1 END) AS non_null,
                     count(DISTINCT CASE WHEN NOT {sql_null('reading')} THEN lower(reading) END)
                       AS "unique",
                     min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_pop(x) AS std, sum(x) AS sum,
                     avg((x - m) * (x - m) * (x - m)) AS third
              FROM (SELECT reading, {_NUM} AS x, avg({_NUM}) OVER () AS m FROM ({_READINGS}) r) v) w,
             {_index_quantiles(_NUM, _READINGS)} f""",
)
def _(t):
    return rounded(column_stats(t.sql(DIRTY_EVENTS), ["reading"]).drop("mode"))


@query(
    "column_stats_text",
    "G1 G2 G11",
    """SELECT 'p_name' AS "column", 'text' AS type, count(*) AS total, count(*) AS non_null,
              0::BIGINT AS nulls, 0::BIGINT AS null_pct, count(DISTINCT lower(p_name)) AS "unique",
              (SELECT p_name FROM {part} GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 1) AS mode
       FROM {part}""",
)
def _(t):
    found = column_stats(t("part"), ["p_name"])
    return found.select("column", "type", "total", "non_null", "nulls", "null_pct", "unique", "mode")


@query(
    "grid_histogram",
    "G9",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {orders}),
       b AS (SELECT least(9, CAST(floor((o_totalprice - lo) / (hi - lo) * 10) AS INT)) AS bin
             FROM {orders}, e)
       SELECT 'o_totalprice' AS "column", s.bin, count(b.bin) AS n
       FROM (SELECT CAST(unnest(range(10)) AS INT) AS bin) s LEFT JOIN b ON s.bin = b.bin
       GROUP BY s.bin""",
)
def _(t):
    return grid_histogram(t("orders"), ["o_totalprice"]).select("column", "bin", "n")


@query(
    "top_value_prefixes",
    "G10",
    """SELECT 'text' AS "column", value, n, CAST(floor(n * 100.0 / total + 0.5) AS BIGINT) AS pct
       FROM (SELECT value, count(*) AS n, sum(count(*)) OVER () AS total,
                    row_number() OVER (ORDER BY count(*) DESC, value) AS rank
             FROM (SELECT substr(text, 1, 20) AS value FROM {documents}) a GROUP BY value) v
       WHERE rank <= 8""",
)
def _(t):
    return top_prefixes(t("documents"), ["text"]).select("column", "value", "n", "pct")


@query(
    "profile_report",
    "S14 G2",
    """WITH r AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) - 1 AS i,
                    count(*) OVER () AS n FROM {lineitem}),
       q AS (SELECT max(CASE WHEN i = floor(n * 0.25) THEN v END) AS q1,
                    max(CASE WHEN i = floor(n * 0.5) THEN v END) AS median,
                    max(CASE WHEN i = floor(n * 0.75) THEN v END) AS q3 FROM r)
       SELECT 'quantity' AS "column", 'numeric' AS type, count(*) AS non_null, 0::BIGINT AS null_pct,
              count(DISTINCT v) AS "unique", min(v) AS min, max(v) AS max, max(median) AS median,
              round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std,
              count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END)
                AS outliers
       FROM r, q
       UNION ALL SELECT 'flag', 'text', count(*), 0, count(DISTINCT l_returnflag), NULL, NULL, NULL,
              NULL, NULL, NULL FROM {lineitem}""",
)
def _(t):
    return profile_report(t.sql(GAPPY).select("quantity", "flag"))


A = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM {customer}"
B = """SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END
       AS balance, s_nationkey AS nation, 1 AS active FROM {supplier}"""


@query(
    "compare_shape",
    "V7 V8 U3 U4",
    """SELECT rows_a, rows_b, rows_a - rows_b AS row_delta, 4 AS cols_a, 5 AS cols_b, -1 AS col_delta,
              3 AS shared_columns, 1 AS only_a, 2 AS only_b
       FROM (SELECT count(*) AS rows_a FROM {customer}) a, (SELECT count(*) AS rows_b FROM {supplier}) b""",
)
def _(t):
    found = compare_shape(t.sql(A), t.sql(B))
    return found.select(
        "rows_a", "rows_b", "row_delta",
        *[F.col(c).cast("int").alias(c) for c in found.columns if c[:3] not in ("row",)],
    )


@query(
    "compare_first_rows",
    "V11",
    f"""SELECT a.i AS row, a.id AS id_a, a.name AS name_a, a.balance AS balance_a, a.segment,
               b.id AS id_b, b.name AS name_b, b.balance AS balance_b, b.nation, b.active
        FROM (SELECT *, CAST(row_number() OVER (ORDER BY id) AS INT) AS i FROM ({A}) v
              ORDER BY id LIMIT 10) a
        FULL JOIN (SELECT *, CAST(row_number() OVER (ORDER BY balance, id) AS INT) AS i
                   FROM (SELECT * FROM ({B}) w WHERE balance > 9000) u
                   ORDER BY balance, id LIMIT 10) b ON a.i = b.i""",
)
def _(t):
    few = t.sql(B).where("balance > 9000")
    both = compare_first_rows(t.sql(A), few, ["id"], ["balance", "id"])
    return both.selectExpr(
        "row", "a.id AS id_a", "a.name AS name_a", "a.balance AS balance_a", "a.segment",
        "b.id AS id_b", "b.name AS name_b", "b.balance AS balance_b", "b.nation", "b.active",
    )


@query(
    "compare_columns",
    "V8 U3 U4",
    """SELECT * FROM (VALUES ('id', 'shared'), ('name', 'shared'), ('balance', 'shared'),
       ('segment', 'only_a'), ('nation', 'only_b'), ('active', 'only_b')) v("column", side)""",
)
def _(t):
    return compare_columns(t.sql(A), t.sql(B))


def _side(c: str, table: str) -> str:
    return f"""(SELECT CAST(floor((count(*) - count({c})) * 100.0 / count(*) + 0.5) AS BIGINT) AS pct,
                round(avg({c}), 4) AS mean FROM ({table}) s)"""


@query(
    "compare_shared_columns",
    "V9 V10",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", a.pct AS null_pct_a, b.pct AS null_pct_b, a.mean AS mean_a,
            b.mean AS mean_b, round(a.mean - b.mean, 4) AS mean_delta
            FROM {_side(c, A)} a, {_side(c, B)} b"""
        for c in ("id", "balance")
    )
    + """ UNION ALL SELECT 'name', 0, 0, NULL, NULL, NULL""",
)
def _(t):
    return rounded(compare_stats(t.sql(A), t.sql(B)))


@query(
    "compare_report",
    "S15",
    """SELECT 'A' AS item, concat(count(*), ' rows x 4 cols') AS value FROM {customer}
       UNION ALL SELECT 'B', concat(count(*), ' rows x 5 cols') FROM {supplier}
       UNION ALL SELECT 'only_a', 'segment' UNION ALL SELECT 'only_b', 'nation'
       UNION ALL SELECT 'only_b', 'active'""",
)
def _(t):
    return compare_report(t.sql(A), t.sql(B))
