"""The canonical order line and the names every operator agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

ORDER_LINE = T.StructType(
    [
        T.StructField("OrderID", T.StringType()),
        T.StructField("CreateDate", T.TimestampType()),
        T.StructField("CustomerID", T.StringType()),
        T.StructField("FacilityID", T.StringType()),
        T.StructField("ProductID", T.StringType()),
        T.StructField("ProductName", T.StringType()),
        T.StructField("CategoryName", T.StringType()),
        T.StructField("VendorID", T.StringType()),
        T.StructField("VendorName", T.StringType()),
        T.StructField("OrderUnits", T.DoubleType()),
        T.StructField("Price", T.DoubleType()),
    ]
)

PAIR = ["CustomerID", "FacilityID"]
SERIES = [*PAIR, "ProductID"]
PRODUCT_TEXT = ["ProductName", "CategoryName", "VendorName"]

# Columns of the pattern table, in output order.
PATTERN_COLUMNS = [
    "CustomerID",
    "FacilityID",
    "ProductID",
    "ProductName",
    "CategoryName",
    "VendorName",
    "TotalOrders",
    "AvgQuantity",
    "StdQuantity",
    "MaxQuantity",
    "MinQuantity",
    "MedianQuantity",
    "CoefficientOfVariation",
    "TrendSlope",
    "AvgDaysBetweenOrders",
    "FirstOrderDate",
    "LastOrderDate",
]

# Columns of the customer-product table, in output order.
CUSTOMER_PRODUCT_COLUMNS = [
    "ProductID",
    "ProductName",
    "CategoryName",
    "vendorName",
    "CustomerID",
    "FacilityID",
    "OrderCount",
    "FirstOrderDate",
    "LastOrderDate",
]

# Forecasting window lengths.
CONTEXT_LENGTH = 28
PREDICTION_LENGTH = 14

FORECAST_ROW = "item_id string, ds date, p10 double, p50 double, p90 double"
