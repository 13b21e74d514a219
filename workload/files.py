"""Given tables written to delimited and JSON files, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from burnish.operators.typing import ROW_ORDER, infer_types
from burnish.plans.fused import small_table
from burnish.plans.materialize import shared_folder
from burnish.sources.catalog import drop, save
from burnish.sources.delimited import load_files, read_delimited, read_sniffed
from burnish.sources.sinks import write_csv, write_json
from burnish.sql import run_sql
from workload.registry import query

# Quotes, commas and outer spaces must survive the trip or be trimmed on the way.
_RAGGED = """SELECT c_custkey, concat('  "', c_name, '", ', lower(c_mktsegment), ' ') AS name,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nation FROM {customer}"""


@query(
    "csv_text_cells",
    "S1 S10",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, trim(name) AS name,
               coalesce(CAST(nation AS VARCHAR), '') AS nation FROM ({_RAGGED}) v""",
)
def _(t):
    folder = shared_folder(t.spark, "csv")
    write_csv(t.sql(_RAGGED), folder)
    return read_delimited(t.spark, folder)


@query(
    "csv_typed_by_share",
    "S1 S10 N2",
    """SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, CAST(p_size AS DOUBLE) AS p_size,
              p_retailprice FROM {part}""",
)
def _(t):
    folder = shared_folder(t.spark, "csv")
    write_csv(t("part").select("p_partkey", "p_name", "p_size", "p_retailprice"), folder)
    return infer_types(read_delimited(t.spark, folder))


@query(
    "csv_typed_by_reader",
    "S7 S10",
    "SELECT CAST(s_suppkey AS INT) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM {supplier}",
)
def _(t):
    folder = shared_folder(t.spark, "csv")
    write_csv(t("supplier"), folder)
    return read_sniffed(t.spark, folder)


@query(
    "csv_row_order",
    "S1",
    "SELECT count(*) AS rows, count(*) AS positions FROM {orders}",
)
def _(t):
    folder = shared_folder(t.spark, "csv")
    write_csv(t("orders"), folder)
    rows = read_delimited(t.spark, folder, with_order=True)
    # Every row has a position of its own.
    places = rows.groupBy(ROW_ORDER).agg(F.count("*").alias("n"))
    return places.agg(F.sum("n").alias("rows"), F.count("*").alias("positions"))


@query(
    "files_as_named_tables",
    "S2 S3 S4 S5 L1",
    """SELECT n_name AS name, r_name AS region FROM {nation} JOIN {region}
       ON n_regionkey = r_regionkey""",
)
def _(t):
    base = shared_folder(t.spark, "files")
    nations, regions = f"{base}/2024 nations.tsv", f"{base}/regions.csv"
    t("nation").write.option("header", True).option("sep", "\t").csv(nations)
    write_csv(t("region"), regions)
    load_files(t.spark, [nations, regions], typed=True)
    return run_sql(
        t.spark,
        """SELECT n_name AS name, r_name AS region FROM t2024_nations JOIN regions
           ON n_regionkey = r_regionkey""",
    )


@query(
    "json_with_null_keys",
    "S11",
    f"SELECT c_custkey, name, nation FROM ({_RAGGED}) v",
)
def _(t):
    folder = shared_folder(t.spark, "json")
    rows = t.sql(_RAGGED)
    write_json(rows, folder)
    return t.spark.read.schema(rows.schema).json(folder)


@query(
    "stored_table",
    "S6 S8",
    "SELECT count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS customers, false AS left_over FROM {orders}",
)
def _(t):
    name = save(t("orders").select("o_orderkey", "o_custkey"), f"stored orders {uuid.uuid4().hex}")
    read = t.spark.table(name).agg(
        F.count("*").alias("orders"), F.sum("o_custkey").cast("bigint").alias("customers")
    )
    found = read.first()
    drop(t.spark, name)
    left = t.spark.catalog.tableExists(name)
    return small_table(
        t.spark, [(*found, left)], "orders bigint, customers bigint, left_over boolean"
    )
