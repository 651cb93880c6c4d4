"""orderlens: demand analytics for order-line data, as PySpark DataFrames."""
