"""String repair, coercion, duplicates, outliers, missing values, the whole cleaning run."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from burnish.operators.clean import (
    CleanConfig,
    ColumnConfig,
    clean,
    fill_or_median,
    round_output,
)
from burnish.operators.coerce import coerce_columns
from burnish.operators.dedup import drop_duplicate_rows
from burnish.operators.impute import (
    drop_nulls,
    fill_values,
    impute_fill,
    impute_mean,
    impute_median,
    impute_mode,
    impute_zero,
)
from burnish.operators.isolation import anomaly_scores
from burnish.operators.iterative import impute_mice, impute_random_forest
from burnish.operators.nearest import impute_knn
from burnish.operators.outliers import handle_outliers
from burnish.operators.strings import changed_cells, clean_strings
from burnish.plans.fused import small_table
from burnish.sources.catalog import save_anomalies, save_cleaned
from workload.grid_and_chart import DIRTY_EVENTS
from workload.profiles import GAPPY
from workload.registry import query, rounded

# A mis-decoded tail, an accent and an apostrophe, put behind part names.
DIRTY_PART = """SELECT p_partkey, concat('  ', upper(p_name), '   ', lower(p_type), CASE p_size % 4
      WHEN 0 THEN ' cafÃ© ' WHEN 1 THEN ' itâ€™s ' WHEN 2 THEN ' 3rd (x|y) ' ELSE ' ' END) AS name,
    concat('$', CAST(p_size AS STRING), ',000') AS price,
    CASE p_size % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' ELSE 'ON' END AS active,
    CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'maybe' END AS doubtful,
    p_brand AS brand FROM {part}"""


def _string(name: str, ids: str, expression: str, **options) -> None:
    settings = {"trim": False, "collapse": False, "encoding": False} | options

    @query(name, ids, f"SELECT p_partkey, {expression} AS name FROM ({DIRTY_PART}) v")
    def _(t):
        part = t.sql(DIRTY_PART).select("p_partkey", "name")
        return clean_strings(part, ["name"], **settings)


_string("trim_text", "C1", "trim(name)", trim=True)
_string("collapse_spaces", "C2", r"regexp_replace(name, '\s+', ' ', 'g')", collapse=True)
_string("fix_mojibake", "C3", "replace(replace(name, 'â€™', ''''), 'Ã©', 'é')", encoding=True)
_string("lower_text", "C4", "lower(name)", transform="lower")
_string("upper_text", "C5", "upper(name)", transform="upper")
_string(
    "title_case_text",
    "C6",
    r"""array_to_string(list_transform(regexp_extract_all(lower(name), '(\p{L}+|[^\p{L}]+)'),
        lambda x: concat(upper(substr(x, 1, 1)), substr(x, 2))), '')""",
    transform="title",
)
_string("strip_special_characters", "C7", r"regexp_replace(name, '[^\p{L}\p{N}_\s.,!?@#\-]', '', 'g')",
        transform="strip_special")
_string(
    "all_string_steps",
    "C1 C2 C3 C4",
    r"lower(replace(replace(regexp_replace(trim(name), '\s+', ' ', 'g'), 'â€™', ''''), 'Ã©', 'é'))",
    trim=True, collapse=True, encoding=True, transform="lower",
)


@query(
    "per_column_transform",
    "C15 C4 C5",
    f"SELECT p_partkey, upper(trim(name)) AS name, lower(trim(brand)) AS brand FROM ({DIRTY_PART}) v",
)
def _(t):
    part = t.sql(DIRTY_PART).select("p_partkey", "name", "brand")
    return clean_strings(
        part, collapse=False, encoding=False, transform="lower", per_column={"name": "upper"}
    )


@query(
    "count_changed_cells",
    "C8",
    f"""SELECT CAST(sum(CASE WHEN lower(trim(name)) <> name THEN 1 ELSE 0 END
                 + CASE WHEN lower(trim(brand)) <> brand THEN 1 ELSE 0 END) AS BIGINT) AS changed
        FROM ({DIRTY_PART}) v""",
)
def _(t):
    part = t.sql(DIRTY_PART)
    before = {c: F.col(c) for c in ("name", "brand")}
    after = {c: F.lower(F.trim(c)) for c in before}
    return part.agg(changed_cells(before, after).alias("changed"))


@query(
    "coerce_numbers_and_booleans",
    "C9 C10",
    f"""SELECT p_partkey, CAST(replace(substr(price, 2), ',', '') AS DOUBLE) AS price,
               CASE WHEN lower(trim(active)) IN ('yes', 'true', 'y', 'on') THEN 1.0::DOUBLE
                    ELSE 0.0::DOUBLE END AS active,
               doubtful, 2 * count(*) OVER () AS coerced FROM ({DIRTY_PART}) v""",
)
def _(t):
    part = t.sql(DIRTY_PART).select("p_partkey", "price", "active", "doubtful")
    done, coerced = coerce_columns(part)
    return done.withColumn("coerced", F.lit(coerced).cast("bigint"))


def _keep(rank: str) -> str:
    return f"""SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER
        (PARTITION BY text ORDER BY doc_id {rank}) AS rn FROM {{documents}}) v WHERE rn = 1"""


_DOC = ("doc_id", "lang", "source", "n_chars")


@query("dedup_keep_first", "C11 C14 W6", _keep("ASC"))
def _(t):
    return drop_duplicate_rows(t("documents"), "keep_first", ["text"], ["doc_id"]).select(*_DOC)


@query("dedup_keep_last", "C12 C14 W6", _keep("DESC"))
def _(t):
    return drop_duplicate_rows(t("documents"), "keep_last", ["text"], ["doc_id"]).select(*_DOC)


@query(
    "dedup_drop_all",
    "C13 C14",
    """SELECT doc_id, lang, source, n_chars FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n
       FROM {documents}) v WHERE n = 1""",
)
def _(t):
    return drop_duplicate_rows(t("documents"), "drop_all", ["text"], ["doc_id"]).select(*_DOC)


@query(
    "dedup_whole_rows",
    "C11",
    "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, nullif(l_tax, 0) AS tax FROM {lineitem}",
)
def _(t):
    rows = t.sql("SELECT l_orderkey, l_linenumber, l_returnflag, nullif(l_tax, 0) AS tax FROM {lineitem}")
    return drop_duplicate_rows(rows)


@query(
    "dedup_subset_of_columns",
    "C14 W6",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER
       (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn
       FROM {lineitem}) v WHERE rn = 1""",
)
def _(t):
    kept = drop_duplicate_rows(
        t("lineitem"), "keep_first", ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]
    )
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


_VALUES = "SELECT event_id, user_id, value FROM {events}"
_FENCES = {
    "iqr": """SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, m, med FROM (
        SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, avg(value) AS m,
        median(value) AS med FROM {events}) q""",
    "zscore": """SELECT m - 3 * s AS lo, m + 3 * s AS hi, m, med FROM (SELECT avg(value) AS m,
        stddev_samp(value) AS s, median(value) AS med FROM {events}) q""",
    "modified_z": """SELECT med - 3.5 * d AS lo, med + 3.5 * d AS hi, m, med FROM (
        SELECT median(value) AS med, mad(value) AS d, avg(value) AS m FROM {events}) q""",
}


def _outlier(method: str, action: str, ids: str, value: str, where: str = "TRUE") -> None:
    extra = ", CAST(value < lo OR value > hi AS INT) AS _outlier_flag" if action == "flag" else ""

    @query(
        f"outliers_{method}_{action}",
        ids,
        f"""SELECT event_id, round({value}, 4) AS value{extra}
            FROM {{events}}, ({_FENCES[method]}) f WHERE {where}""",
    )
    def _(t):
        done = handle_outliers(t.sql(_VALUES), method, action, ["value"])
        return rounded(done.df.drop("user_id"))


_CAP = "least(hi, greatest(lo, value))"
_OUT = "value < lo OR value > hi"
_outlier("iqr", "cap", "X1 X5", _CAP)
_outlier("zscore", "cap", "X2 X5", _CAP)
_outlier("modified_z", "cap", "X3 X5", _CAP)
_outlier("iqr", "remove", "X1 X6", "value", f"NOT ({_OUT})")
_outlier("zscore", "replace_mean", "X2 X7", f"CASE WHEN {_OUT} THEN m ELSE value END")
_outlier("modified_z", "replace_median", "X3 X8", f"CASE WHEN {_OUT} THEN med ELSE value END")
_outlier("iqr", "nan", "X1 X9", f"CASE WHEN NOT ({_OUT}) THEN value END")
_outlier("iqr", "flag", "X1 X10", "value")
_outlier("iqr", "keep", "X11", "value")


@query(
    "outlier_counts",
    "X12",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS method, count(*) AS n FROM {{events}}, ({q}) f WHERE {_OUT}"""
        for m, q in _FENCES.items()
    ),
)
def _(t):
    events = t.sql(_VALUES)
    found = [(m, handle_outliers(events, m, "cap", ["value"]).total) for m in _FENCES]
    return small_table(t.spark, found, "method string, n bigint")


@query(
    "outliers_removed_one_after_the_other",
    "X6 X13",
    """WITH a AS (SELECT event_id, value, 1 / (value + 1) AS inverse FROM {events}),
       f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM a),
       k AS (SELECT a.* FROM a, f WHERE value BETWEEN f.a - 1.5 * (f.b - f.a)
             AND f.b + 1.5 * (f.b - f.a)),
       g AS (SELECT quantile_cont(inverse, 0.25) AS a, quantile_cont(inverse, 0.75) AS b FROM k)
       SELECT event_id, round(value, 4) AS value,
              round(least(greatest(inverse, g.a - 1.5 * (g.b - g.a)), g.b + 1.5 * (g.b - g.a)), 4)
                AS inverse FROM k, g""",
)
def _(t):
    events = t.sql("SELECT event_id, value, 1 / (value + 1) AS inverse FROM {events}")
    done = handle_outliers(
        events, "iqr", "cap", ["value", "inverse"], per_column={"value": "remove", "inverse": "global"}
    )
    return rounded(done.df)


def _impute(name: str, ids: str, expression: str, run) -> None:
    @query(
        name,
        ids,
        f"""SELECT l_orderkey, l_partkey, l_suppkey, round({expression.replace('$c', 'discount')}, 4)
            AS discount, round({expression.replace('$c', 'tax')}, 4) AS tax FROM ({GAPPY}) v""",
    )
    def _(t):
        rows = t.sql(GAPPY).select("l_orderkey", "l_partkey", "l_suppkey", "discount", "tax")
        return rounded(run(rows, ["discount", "tax"]))


_impute("impute_mean", "M1", "coalesce($c, avg($c) OVER ())", impute_mean)
_impute("impute_median", "M2", "coalesce($c, median($c) OVER ())", impute_median)
_impute(
    "impute_most_frequent",
    "M3",
    f"coalesce($c, (SELECT $c FROM ({GAPPY}) m WHERE $c IS NOT NULL GROUP BY $c "
    "ORDER BY count(*) DESC, $c LIMIT 1))",
    impute_mode,
)
_impute("impute_zero", "M4", "coalesce($c, 0)", impute_zero)
_impute(
    "leave_missing",
    "M10",
    "$c",
    lambda df, columns: clean(
        df,
        CleanConfig(missing_strategy="none", duplicates="none", outlier_action="keep"),
    ).df,
)


def _broken(df):
    """A model whose job fails on the first gap."""
    failed = F.raise_error(F.lit("no fit")).cast("double")
    return df.withColumns({c: F.coalesce(c, failed) for c in ("discount", "tax")})


_impute(
    "median_where_a_model_fails",
    "M14",
    "coalesce($c, median($c) OVER ())",
    lambda df, columns: fill_or_median(df, columns, _broken, []),
)
_impute(
    "impute_custom_value",
    "M9",
    "coalesce($c, 9.5)",
    lambda df, columns: fill_values(df, dict.fromkeys(columns, 9.5)),
)


@query(
    "drop_rows_with_missing",
    "M5",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, discount, tax FROM ({GAPPY}) v
        WHERE discount IS NOT NULL AND tax IS NOT NULL""",
)
def _(t):
    rows = t.sql(GAPPY).select("l_orderkey", "l_partkey", "l_suppkey", "discount", "tax")
    return drop_nulls(rows, ["discount", "tax"])


GAPPY_EVENTS = """SELECT event_id, user_id % 7 AS grp,
    CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE event_type END AS kind,
    CASE WHEN value < 40 THEN NULL ELSE value END AS value FROM {events}"""


@query(
    "impute_text",
    "M4 M6 M15",
    f"""SELECT event_id, coalesce(kind, (SELECT kind FROM ({GAPPY_EVENTS}) m WHERE kind IS NOT NULL
               GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS by_mode,
               coalesce(kind, '') AS by_blank, CAST('' AS STRING) AS never FROM ({GAPPY_EVENTS}) v""",
)
def _(t):
    events = t.sql(GAPPY_EVENTS).select(
        "event_id", F.col("kind").alias("by_mode"), F.col("kind").alias("by_blank"),
        F.lit(None).cast("string").alias("never"),
    )
    return impute_zero(impute_mode(events, ["by_mode", "never"]), ["by_blank"])


def _fill(name: str, ids: str, backward: bool, partition: str) -> None:
    pick = (
        "first_value({c} IGNORE NULLS) OVER ({p} ORDER BY event_id ROWS BETWEEN CURRENT ROW AND "
        "UNBOUNDED FOLLOWING)"
        if backward
        else "last_value({c} IGNORE NULLS) OVER ({p} ORDER BY event_id ROWS BETWEEN UNBOUNDED "
        "PRECEDING AND CURRENT ROW)"
    )
    by = f"PARTITION BY {partition}" if partition else ""
    kind, value = (pick.format(c=c, p=by) for c in ("kind", "value"))

    @query(name, ids, f"SELECT event_id, {kind} AS kind, {value} AS value FROM ({GAPPY_EVENTS}) v")
    def _(t):
        filled = impute_fill(
            t.sql(GAPPY_EVENTS), ["kind", "value"], ["event_id"], backward,
            [partition] if partition else [],
        )
        return filled.select("event_id", "kind", "value")


_fill("forward_fill", "M7 W4", False, "")
_fill("backward_fill", "M8 W5", True, "")
_fill("forward_fill_in_groups", "M7 W4", False, "grp")
_fill("backward_fill_in_groups", "M8 W5", True, "grp")


@query(
    "round_output",
    "C18 F9",
    "SELECT event_id, round(value / 7, 6) AS seventh FROM {events}",
)
def _(t):
    return round_output(t.sql("SELECT event_id, value / 7 AS seventh FROM {events}"))


CUSTOMER_GAPS = """SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 10 + c_nationkey END AS score,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE length(c_mktsegment) END AS size FROM {customer}"""
_GAPS = ["nation", "balance", "score", "size"]


def _knn_sql() -> str:
    """Brute force: every row with a gap against every row that has the column."""
    def gap(c: str) -> str:
        return f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)"

    shared = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INT)" for c in _GAPS)
    d2 = f"({' + '.join(gap(c) for c in _GAPS)}) * 4.0 / ({shared})"
    parts = [f"WITH t AS ({CUSTOMER_GAPS})"]
    for c in ("score", "size"):
        parts.append(
            f""", {c}_near AS (SELECT a.c_custkey, {d2} AS d2, b.{c} AS v, row_number() OVER
                  (PARTITION BY a.c_custkey ORDER BY {d2}, b.{c}) AS r
                FROM t a JOIN t b ON a.{c} IS NULL AND b.{c} IS NOT NULL),
              {c}_new AS (SELECT c_custkey, CASE WHEN min(d2) = 0
                  THEN avg(CASE WHEN d2 = 0 THEN v END)
                  ELSE sum(CASE WHEN d2 > 0 THEN v / sqrt(d2) END)
                    / sum(CASE WHEN d2 > 0 THEN 1 / sqrt(d2) END) END AS v
                FROM {c}_near WHERE r <= 5 GROUP BY c_custkey)"""
        )
    return " ".join(parts) + """ SELECT t.c_custkey, nation, balance,
        round(coalesce(score, score_new.v), 4) AS score,
        round(coalesce(CAST(size AS DOUBLE), size_new.v), 4) AS size
        FROM t LEFT JOIN score_new ON t.c_custkey = score_new.c_custkey
        LEFT JOIN size_new ON t.c_custkey = size_new.c_custkey"""


@query("impute_nearest_neighbours", "M11", _knn_sql())
def _(t):
    return rounded(impute_knn(t.sql(CUSTOMER_GAPS), _GAPS))


@query("impute_chained_ridge", "M12")
def _(t):
    return rounded(impute_mice(t.sql(CUSTOMER_GAPS), _GAPS))


_STEPS = """CASE WHEN c_nationkey < 8 THEN 10.0 WHEN c_nationkey < 17 THEN 20.0 ELSE 40.0 END
    + CASE WHEN c_acctbal < 4000 THEN 0.0 ELSE 5.0 END"""


@query(
    "forest_predicts_a_step_function",
    "M13",
    f"""SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, {_STEPS} AS step,
               true AS near
        FROM {{customer}} WHERE c_custkey % 9 = 0""",
)
def _(t):
    # Near the edge in the balance the forest may be a step off.
    rows = t.sql(
        f"""SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance,
               CASE WHEN c_custkey % 9 <> 0 THEN {_STEPS} END AS step, {_STEPS} AS truth
            FROM {{customer}}"""
    )
    filled = impute_random_forest(rows, ["nation", "balance", "step"], rounds=1, trees=12)
    far = F.abs(F.col("step") - F.col("truth"))
    edge = F.col("balance").between(3600, 4400)
    return filled.where("c_custkey % 9 = 0").select(
        "c_custkey", "nation", F.col("truth").alias("step"),
        ((far < 1) | (edge & (far < 6))).alias("near"),
    )


@query("impute_random_forest", "M13")
def _(t):
    return rounded(impute_random_forest(t.sql(CUSTOMER_GAPS), _GAPS))


@query(
    "chained_ridge_on_a_linear_column",
    "M12",
    """SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance, true AS near
       FROM {customer}""",
)
def _(t):
    # score is balance / 10 + nation wherever it is known.
    filled = impute_mice(t.sql(CUSTOMER_GAPS).drop("size"), _GAPS[:3])
    far = F.abs(F.col("score") - F.col("balance") / 10 - F.col("nation"))
    return filled.select("c_custkey", "nation", "balance", (far < 0.005).alias("near"))


_FILLED = f"""SELECT count(*) AS rows, 0 AS gaps_left, 0 AS changed,
       CAST(sum(CASE WHEN score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS scores_filled,
       CAST(sum(CASE WHEN size IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS sizes_filled
       FROM ({CUSTOMER_GAPS}) v"""


@query("random_forest_fills_gaps_alone", "M13", _FILLED)
def _(t):
    before = t.sql(CUSTOMER_GAPS)
    after = impute_random_forest(before, _GAPS, rounds=2, trees=8)
    both = before.alias("b").join(after.alias("a"), "c_custkey")

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("bigint")

    def inside(c):  # a forest predicts nothing outside of what it has seen
        seen = before.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        return F.col(f"b.{c}").isNull() & F.col(f"a.{c}").between(seen["lo"], seen["hi"])

    changed = [F.col(f"b.{c}") != F.col(f"a.{c}") for c in _GAPS]
    gaps = [F.col(f"a.{c}").isNull() for c in _GAPS]
    return both.agg(
        F.count("*").alias("rows"),
        count(reduce(or_, gaps)).cast("int").alias("gaps_left"),
        count(reduce(or_, changed)).cast("int").alias("changed"),
        count(inside("score")).alias("scores_filled"),
        count(inside("size")).alias("sizes_filled"),
    )


@query(
    "planted_anomalies",
    "V6 X4",
    """SELECT count(*) AS rows, CAST(sum(CASE WHEN event_id % 400 = 0 THEN 1 ELSE 0 END) AS BIGINT)
         AS planted_flagged, true AS at_most_the_share FROM {events}""",
)
def _(t):
    rows = t.sql(
        """SELECT event_id, event_id % 400 = 0 AS planted,
             CASE WHEN event_id % 400 = 0 THEN -1e6 - event_id ELSE user_id END AS user_id,
             CASE WHEN event_id % 400 = 0 THEN 1e6 + event_id ELSE value END AS value FROM {events}"""
    )
    flagged = anomaly_scores(rows, 0.05, ["user_id", "value"], ["event_id"])
    hit = F.col("_is_anomaly") == 1
    return flagged.agg(
        F.count("*").alias("rows"),
        F.count_if(hit & F.col("planted")).alias("planted_flagged"),
        (F.count_if(hit) <= 0.05 * F.count("*")).alias("at_most_the_share"),
    )


@query("anomaly_flags", "V6 X4")
def _(t):
    flagged = anomaly_scores(
        t.sql("SELECT event_id, user_id, value FROM {events}"), 0.05, ["user_id", "value"], ["event_id"]
    )
    return t.spark.table(save_anomalies(flagged, "events"))


@query(
    "clean_with_iqr_cap_and_median",
    "C0 N1 N2 C1 C9 X1 X5 M2 M15 C18 S13",
    """WITH raw AS (SELECT event_id,
         CASE event_id % 10 WHEN 0 THEN NULL WHEN 7 THEN NULL ELSE event_type END AS kind,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE round(value, 2) END AS amount FROM {events}),
       f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (
         SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM raw) q),
       c AS (SELECT event_id, kind, CASE WHEN amount IS NOT NULL THEN least(hi, greatest(lo, amount)) END
             AS amount FROM raw, f),
       m AS (SELECT kind AS top FROM raw WHERE kind IS NOT NULL GROUP BY kind
             ORDER BY count(*) DESC, kind LIMIT 1)
       SELECT CAST(event_id AS DOUBLE) AS event_id, coalesce(kind, top) AS kind,
              round(coalesce(amount, median(amount) OVER ()), 4) AS amount FROM c, m""",
)
def _(t):
    raw = t.sql(
        """SELECT CAST(event_id AS STRING) AS event_id,
             CASE event_id % 10 WHEN 0 THEN 'N/A' WHEN 7 THEN ' Unknown ' ELSE
               concat(' ', event_type, '  ') END AS kind,
             CASE WHEN event_id % 6 = 0 THEN '--' ELSE concat('$', CAST(CAST(round(value, 2)
               AS DECIMAL(12, 2)) AS STRING)) END AS amount FROM {events}"""
    )
    done = clean(raw, CleanConfig(missing_strategy="median"), ["event_id"])
    return rounded(t.spark.table(save_cleaned(done.df, "events")))


@query(
    "clean_statistics",
    "C16 C8 C9 C11 X12",
    """WITH raw AS (SELECT user_id % 50 AS u, event_type AS kind,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE floor(value / 10) END AS amount FROM {events}),
       d AS (SELECT DISTINCT u, kind, amount FROM raw),
       f AS (SELECT m - 3 * s AS lo, m + 3 * s AS hi FROM (SELECT avg(amount) AS m,
         stddev_samp(amount) AS s FROM d) q),
       k AS (SELECT d.* FROM d, f WHERE amount IS NULL OR amount BETWEEN lo AND hi)
       SELECT (SELECT count(*) FROM raw) AS rows_in, (SELECT count(*) FROM k) AS rows_out,
              (SELECT count(*) FROM raw) - (SELECT count(*) FROM k) AS rows_removed,
              (SELECT count(*) FROM raw WHERE amount IS NULL) AS nulls_filled,
              (SELECT count(*) FROM d) - (SELECT count(*) FROM k) AS outliers,
              (SELECT count(*) FROM raw) - (SELECT count(*) FROM d) AS dupes,
              (SELECT count(*) FROM raw) AS str_ops,
              (SELECT 0) AS coerced""",
)
def _(t):
    raw = t.sql(
        """SELECT user_id % 50 AS u, concat(event_type, ' ') AS kind, CASE WHEN event_id % 6 = 0
           THEN NULL ELSE floor(value / 10) END AS amount FROM {events}"""
    )
    cfg = CleanConfig(outlier_method="zscore", outlier_action="remove", missing_strategy="zero")
    return clean(raw, cfg).stats.withColumn("coerced", F.col("coerced").cast("int"))


@query(
    "clean_log",
    "C17",
    """WITH raw AS (SELECT user_id % 50 AS u, event_type AS kind,
         CASE WHEN event_id % 6 = 0 THEN NULL ELSE floor(value / 10) END AS amount FROM {events}),
       d AS (SELECT DISTINCT u, kind, amount FROM raw)
       SELECT 'duplicates: dropped=' || ((SELECT count(*) FROM raw) - (SELECT count(*) FROM d)) AS line
       UNION ALL SELECT 'strings: changed=' || (SELECT count(*) FROM raw)
       UNION ALL SELECT 'gaps: filled=' || (SELECT count(*) FROM raw WHERE amount IS NULL)
       UNION ALL SELECT 'rows: in=' || (SELECT count(*) FROM raw) || ' out=' || (SELECT count(*) FROM d)""",
)
def _(t):
    raw = t.sql(
        """SELECT user_id % 50 AS u, concat(event_type, ' ') AS kind, CASE WHEN event_id % 6 = 0
           THEN NULL ELSE floor(value / 10) END AS amount FROM {events}"""
    )
    log = clean(raw, CleanConfig(outlier_method="none", missing_strategy="zero")).log
    shown = ("duplicates:", "strings:", "gaps: filled", "rows:")
    return small_table(t.spark, [(x,) for x in log if x.startswith(shown)], "line string")


@query(
    "clean_with_column_overrides",
    "C15 X13 M9 M10 M5",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 'GONE' ELSE upper(event_type) END
              AS kind, CASE WHEN value >= 40 THEN round(value, 4) END AS value
       FROM {events}""",
)
def _(t):
    overrides = {
        "kind": ColumnConfig(str_transform="upper", missing="custom", custom_fill="GONE"),
        "value": ColumnConfig(outlier_action="keep", missing="none"),
    }
    cfg = CleanConfig(
        duplicates="none", outlier_method="iqr", missing_strategy="median", columns=overrides
    )
    done = clean(t.sql(GAPPY_EVENTS).drop("grp"), cfg, ["event_id"])
    return rounded(done.df.withColumn("event_id", F.col("event_id").cast("bigint")))


@query("clean_with_isolation_forest", "C0 X4 X5 X7 M11")
def _(t):
    cfg = CleanConfig(outlier_method="isolation_forest", outlier_action="cap", ml_model="knn")
    return clean(t.sql(CUSTOMER_GAPS), cfg, ["c_custkey"]).df


@query(
    "clean_with_fill_of_raw_text",
    "M7 M8 C0 W4",
    f"""SELECT CAST(event_id AS DOUBLE) AS event_id,
          last_value(CASE WHEN kind IN ('N/A', '  ', ' Unknown ') THEN NULL ELSE kind END IGNORE NULLS)
            OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind
        FROM ({DIRTY_EVENTS}) v""",
)
def _(t):
    cfg = CleanConfig(duplicates="none", outlier_method="none", missing_strategy="ffill")
    events = t.sql(DIRTY_EVENTS).select("event_id", "kind")
    done = clean(events, cfg, ["event_id"]).df
    return done.withColumn("event_id", F.col("event_id").cast("double"))
