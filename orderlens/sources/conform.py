"""Any order file to the canonical order line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.parsing import lenient_double, parse_order_date
from orderlens.schema import ORDER_LINE

# Spellings accepted for each canonical column, best first, compared
# in lower case without spaces and underscores.
SPELLINGS = {
    "OrderID": ["orderid"],
    "CreateDate": ["createdate"],
    "CustomerID": ["customerid"],
    "FacilityID": ["facilityid"],
    "ProductID": ["productid"],
    "ProductName": ["productdescription", "productname"],
    "CategoryName": ["productcategory", "categoryname"],
    "VendorID": ["vendorid"],
    "VendorName": ["vendorname"],
    "OrderUnits": ["orderunits", "quantity"],
    "Price": ["price", "unitprice"],
}


def fold_name(name: str) -> str:
    return name.strip().replace(" ", "").replace("_", "").lower()


def _typed(column: Column, source: T.DataType, target: T.DataType) -> Column:
    if isinstance(target, T.TimestampType):
        return parse_order_date(column) if isinstance(source, T.StringType) else column.cast(target)
    if isinstance(target, T.DoubleType):
        return lenient_double(column) if isinstance(source, T.StringType) else column.cast(target)
    return column.cast(target)


def conform(df: DataFrame, fill_absent: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Select the canonical columns out of ``df``, whatever their spelling.

    Where several spellings are present the first non-null one counts. A column
    found nowhere becomes a typed NULL, or is left out with ``fill_absent=False``
    for operators that act on its absence. Columns to ``keep`` follow as they are. Only
    metadata is read.
    """
    found: dict[str, list[tuple[str, T.DataType]]] = {}
    for field in df.schema:
        found.setdefault(fold_name(field.name), []).append((field.name, field.dataType))
    picked = []
    for field in ORDER_LINE:
        sources = [s for spelling in SPELLINGS[field.name] for s in found.get(spelling, [])]
        parts = [_typed(F.col(f"`{name}`"), kind, field.dataType) for name, kind in sources]
        if parts:
            picked.append((F.coalesce(*parts) if len(parts) > 1 else parts[0]).alias(field.name))
        elif fill_absent:
            picked.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*picked, *keep)


def with_default_names(df: DataFrame) -> DataFrame:
    """Fill missing product name, category and vendor from the product id."""
    pid = F.col("ProductID").cast("string")
    defaults = {
        "ProductName": F.concat(F.lit("Product "), pid),
        "CategoryName": F.lit("General"),
        "VendorName": F.concat(F.lit("Vendor"), F.replace(pid, F.lit("PROD"), F.lit(""))),
    }
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), default) if name in df.columns else default
            for name, default in defaults.items()
        }
    )
