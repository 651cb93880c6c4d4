"""Product and customer-product tables, their keyed records, and lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.parsing import clean_id, joined_key
from orderlens.operators.demand import daily_activity, product_table
from orderlens.schema import CUSTOMER_PRODUCT_COLUMNS, PAIR, SERIES
from orderlens.sources.conform import with_default_names


def product_lookup(lines: DataFrame) -> DataFrame:
    """One row per product, missing text filled from the id."""
    named = with_default_names(product_table(lines))
    return named.select(
        "ProductID", "ProductName", "CategoryName", F.col("VendorName").alias("vendorName")
    )


def merge_product_lookups(*tables: DataFrame) -> DataFrame:
    """Distinct union of product tables, reduced to one row per product."""
    union = tables[0]
    for other in tables[1:]:
        union = union.unionByName(other)
    return union.groupBy("ProductID").agg(
        F.min(F.struct("ProductName", "CategoryName", "vendorName")).alias("info")
    ).select("ProductID", "info.*")


def relationships(lines: DataFrame, ts: str = "CreateDate") -> DataFrame:
    """Order-line count and first and last order of each series; lines without a date do not count."""
    if "OrderUnits" not in lines.columns:
        lines = lines.withColumn("OrderUnits", F.lit(1.0))
    return relationships_of(daily_activity(lines, ts))


def relationships_of(activity: DataFrame) -> DataFrame:
    """The same from the daily activity table, without the lines."""
    return activity.groupBy(*SERIES).agg(
        F.sum("Lines").alias("OrderCount"),
        F.min("FirstTime").alias("FirstOrderDate"),
        F.max("LastTime").alias("LastOrderDate"),
    )


def customer_product_lookup(relations: DataFrame, products: DataFrame, how: str = "left") -> DataFrame:
    """Relationships with product text; ``how="inner"`` keeps known products only."""
    return relations.join(products, "ProductID", how).select(*CUSTOMER_PRODUCT_COLUMNS)


def products_of(lookup: DataFrame, customer: str, facility: str, product: str | None = None) -> DataFrame:
    """Products of one customer and facility; ids compare as trimmed text."""
    wanted = {"CustomerID": customer, "FacilityID": facility}
    if product is not None:
        wanted["ProductID"] = product
    for name, value in wanted.items():
        lookup = lookup.where(clean_id(F.col(name)) == str(value).strip())
    return lookup


def top_products(lookup: DataFrame, k: int = 10) -> DataFrame:
    """The k most ordered products of every customer and facility.

    The rank filter is pushed below the shuffle, so a pair with very many
    products sends only its k best per task.
    """
    best = Window.partitionBy(*PAIR).orderBy(F.desc("OrderCount"), "ProductID")
    return lookup.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def lookup_items(products: DataFrame, relations: DataFrame) -> DataFrame:
    """Both tables as keyed records in one layout, unique by key.

    Duplicates of a key are resolved by value, not by arrival. A ``#`` within an id is escaped
    in the composed keys.
    """
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    text = [
        F.col("ProductName").alias("product_name"),
        F.col("CategoryName").alias("category_name"),
        F.col("vendorName").alias("vendor_name"),
    ]
    pair = joined_key("#", *[F.col(name) for name in PAIR])
    of_product = products.select(
        F.col("ProductID").cast("string").alias("product_id"),
        F.lit("PRODUCT").alias("record_type"),
        *text,
    )
    of_pair = relations.select(
        F.concat_ws("#", joined_key("#", F.col("ProductID")), pair).alias("product_id"),
        F.lit("CUSTOMER_PRODUCT").alias("record_type"),
        *text,
        pair.alias("customer_facility"),
        F.col("CustomerID").cast("string").alias("customer_id"),
        F.col("FacilityID").cast("string").alias("facility_id"),
        F.col("ProductID").cast("string").alias("base_product_id"),
        F.col("OrderCount").alias("order_count"),
        F.date_format("FirstOrderDate", iso).alias("first_order_date"),
        F.date_format("LastOrderDate", iso).alias("last_order_date"),
    )
    return first_by_key(of_product, ["product_id", "record_type"]).unionByName(
        first_by_key(of_pair, ["product_id", "record_type"]), allowMissingColumns=True
    )


def first_by_key(df: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the least one in ``order``, then by all other columns.

    A minimum over a struct is combined before the shuffle, which a ranking
    window over a hot key is not.
    """
    rest = [name for name in df.columns if name not in key]
    if not rest:
        return df.distinct()
    lead = [name for name in (order or []) if name in rest]
    ranked = F.struct(*lead, *[name for name in rest if name not in lead])
    return (
        df.groupBy(*key)
        .agg(F.min(ranked).alias("row"))
        .select(*[name if name in key else F.col(f"row.{name}").alias(name) for name in df.columns])
    )


def items_of_pair(items: DataFrame, customer_facility: str) -> DataFrame:
    """Records of one customer#facility key; on a stored table only that key's row groups are read."""
    of_pair = items.where(F.col("record_type") == "CUSTOMER_PRODUCT")
    return of_pair.where(F.col("customer_facility") == customer_facility)


def distinct_pairs(lines: DataFrame) -> DataFrame:
    return lines.select(*PAIR).na.drop().distinct()
