"""Order lines out of the star schema, at a chosen grain."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grain:
    """Which source columns play customer, facility, product and category."""

    customer: str
    facility: str
    product: str
    name: str
    category: str


GRAINS = {
    "fine": Grain("o_custkey", "s_nationkey", "l_partkey", "p_name", "p_brand"),
    "brand": Grain("c_mktsegment", "n_regionkey", "p_brand", "p_brand", "p_brand"),
    "type": Grain("c_mktsegment", "n_regionkey", "p_type", "p_type", "p_type"),
}


# Declared, so that opening a table reads no footer and starts no job.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _origins(grain: Grain) -> dict[str, str]:
    """Source column of each canonical column; its first letter names the table."""
    return {
        "OrderID": "l_orderkey",
        "CreateDate": "o_time",
        "Date": "o_day",
        "CustomerID": grain.customer,
        "FacilityID": grain.facility,
        "ProductID": grain.product,
        "ProductName": grain.name,
        "CategoryName": grain.category,
        "VendorID": "l_suppkey",
        "VendorName": "s_name",
        "OrderUnits": "l_quantity",
        "Price": "l_price",
    }


CANONICAL = [
    "OrderID",
    "CreateDate",
    "CustomerID",
    "FacilityID",
    "ProductID",
    "ProductName",
    "CategoryName",
    "VendorID",
    "VendorName",
    "OrderUnits",
    "Price",
]


def order_lines(
    spark: SparkSession,
    folder: str,
    grain: str = "brand",
    columns: Iterable[str] = CANONICAL,
) -> DataFrame:
    """Canonical order lines, with only the joins that ``columns`` need.

    Besides the canonical columns, ``Date`` may be asked for: the order day, made
    once per order and not once per line. Every join is a left join on the unique
    key of the joined table, so leaving one out never changes the rows; Catalyst
    prunes columns but not joins, which is why the caller names the columns it
    reads. The order side is widened with its customer first: orders are a
    fraction of the lines, so the lines are shuffled on the order key once and no
    more. No side is hinted: Spark broadcasts the ones below its size threshold
    and splits hot keys of the rest.
    """
    origins = _origins(GRAINS[grain])
    wanted = list(columns)
    tables = {origins[name][0] for name in wanted}

    lines = table(spark, folder, "lineitem").withColumn(
        "l_price", F.try_divide("l_extendedprice", "l_quantity")
    )
    if tables & {"o", "c", "n"}:
        orders = table(spark, folder, "orders").withColumns(
            {"o_time": F.col("o_orderdate").cast("timestamp"), "o_day": F.to_date("o_orderdate")}
        )
        if tables & {"c", "n"}:
            customers = table(spark, folder, "customer")
            if "n" in tables:
                nations = table(spark, folder, "nation")
                customers = customers.join(
                    nations, customers["c_nationkey"] == nations["n_nationkey"], "left"
                )
            orders = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left")
        lines = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left")
    if "p" in tables:
        parts = table(spark, folder, "part")
        lines = lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left")
    if "s" in tables:
        suppliers = table(spark, folder, "supplier")
        lines = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"], "left")
    return lines.select(*[F.col(origins[name]).alias(name) for name in wanted])
