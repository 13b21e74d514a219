"""Correlations and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators.multivariate import correlations, principal_components
from workload.profiles import GAPPY
from workload.registry import query, rounded

_COLUMNS = ["discount", "tax", "price", "quantity"]


@query(
    "correlation_matrix",
    "V1",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS correlation
            FROM ({GAPPY}) v"""
        for a in _COLUMNS
        for b in _COLUMNS
    ),
)
def _(t):
    return correlations(t.sql(GAPPY), _COLUMNS)


_WIDTH = 64


@query(
    "correlation_of_wide_table",
    "V1",
    """WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
                         unnest(range(64)) AS i FROM {embeddings})
       SELECT concat('e', a.i) AS column_a, concat('e', b.i) AS column_b,
              round(corr(a.x, b.x), 4) AS correlation
       FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY a.i, b.i""",
)
def _(t):
    wide = t("embeddings").select(
        *[F.col("embedding")[i].alias(f"e{i}") for i in range(_WIDTH)]
    )
    return correlations(wide)


_PAIR = """SELECT l_quantity + 0.0 AS x, l_quantity * 3 + l_extendedprice / 2000 AS y FROM {lineitem}"""


@query(
    "explained_variance_of_two_columns",
    "V2 V5 W7",
    f"""SELECT component, round(explained, 3) AS explained,
               round(sum(explained) OVER (ORDER BY component), 3) AS cumulative
        FROM (SELECT 1 AS component, (1 + abs(corr(x, y))) / 2 AS explained FROM ({_PAIR}) v
              UNION ALL SELECT 2, (1 - abs(corr(x, y))) / 2 FROM ({_PAIR}) v) w""",
)
def _(t):
    return rounded(principal_components(t.sql(_PAIR), 2).explained, 3)


@query(
    "loadings_of_two_columns",
    "V4",
    """SELECT component, feature, round(loading, 4) AS loading FROM (VALUES
       (1, 'x', 1 / sqrt(2.0)), (1, 'y', 1 / sqrt(2.0))) v(component, feature, loading)""",
)
def _(t):
    found = principal_components(t.sql(_PAIR), 1).loadings
    return rounded(found)


_TRIPLE = """SELECT l_quantity + 0.0 AS x, l_quantity * 3 + l_extendedprice / 2000 AS y,
    l_tax * 200 - l_quantity AS z FROM {lineitem}"""


@query(
    "loadings_of_three_columns",
    "V4",
    # The largest root of the characteristic polynomial of a 3 x 3 correlation matrix, by angles;
    # its vector is normal to two rows of the matrix less the root.
    f"""WITH r AS (SELECT corr(x, y) AS a, corr(x, z) AS b, corr(y, z) AS c FROM ({_TRIPLE}) v),
        p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM r),
        e AS (SELECT *, 2 * p * cos(acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3) AS l
              FROM p),
        v AS (SELECT a * c + b * l AS vx, a * b + l * c AS vy, l * l - a * a AS vz FROM e),
        n AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) * CASE
                WHEN abs(vx) >= abs(vy) AND abs(vx) >= abs(vz) THEN sign(vx)
                WHEN abs(vy) >= abs(vz) THEN sign(vy) ELSE sign(vz) END AS s FROM v)
        SELECT 1 AS component, 'x' AS feature, round(vx / s, 4) AS loading FROM n
        UNION ALL SELECT 1, 'y', round(vy / s, 4) FROM n
        UNION ALL SELECT 1, 'z', round(vz / s, 4) FROM n""",
)
def _(t):
    return rounded(principal_components(t.sql(_TRIPLE), 1).loadings)


@query(
    "scores_of_two_columns",
    "V3",
    f"""SELECT l_orderkey, l_partkey, l_suppkey,
               round(((x - avg(x) OVER ()) / stddev_pop(x) OVER ()
                    + (y - avg(y) OVER ()) / stddev_pop(y) OVER ()) / sqrt(2.0), 3) AS pc1
        FROM ({_PAIR.replace('SELECT', 'SELECT l_orderkey, l_partkey, l_suppkey,')}) v""",
)
def _(t):
    rows = t.sql(_PAIR.replace("SELECT", "SELECT l_orderkey, l_partkey, l_suppkey,"))
    return rounded(principal_components(rows, 1, ["x", "y"]).scores.drop("x", "y"), 3)


@query("embedding_components", "V2 V5")
def _(t):
    rows = t("embeddings")
    wide = rows.select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(_WIDTH)])
    columns = [f"e{i}" for i in range(_WIDTH)]
    return rounded(principal_components(wide, 3, columns).explained)
