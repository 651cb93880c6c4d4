"""Daily demand and what is derived from it per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.parsing import joined_key
from orderlens.functions.stats import coefficient_of_variation, ratio
from orderlens.schema import PAIR, PATTERN_COLUMNS, PRODUCT_TEXT, SERIES


def _keyed(lines: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Lines whose keys and day are all known, with the day."""
    dated = lines.withColumn("Date", F.to_date(ts)) if "Date" not in lines.columns else lines
    return dated.na.drop(subset=[*keys, "Date"])


def daily_demand(lines: DataFrame, measure: str | None = None, ts: str = "CreateDate") -> DataFrame:
    """Quantity per customer, facility, product and day.

    ``measure`` is ``"units"`` or ``"lines"``; by default units if the lines have
    them. Lines are combined before the shuffle, so a hot series sends one row per
    task and day, and each series ends up with at most one row per calendar day.
    That bound is what the per-series windows and arrays downstream rely on.
    """
    if measure is None:
        measure = "units" if "OrderUnits" in lines.columns else "lines"
    if measure == "units":
        quantity = F.coalesce(F.sum("OrderUnits"), F.lit(0.0))
    else:
        quantity = F.count(F.lit(1)).cast("double")
    return (
        _keyed(lines, SERIES, ts).groupBy(*SERIES, "Date").agg(quantity.alias("Quantity"))
    )


def daily_activity(lines: DataFrame, ts: str = "CreateDate") -> DataFrame:
    """Daily demand with the number of order lines and the first and last order time.

    From this table both the history and the relationship summary of a series
    follow, so the lines are scanned once for the two.
    """
    return (
        _keyed(lines, SERIES, ts)
        .groupBy(*SERIES, "Date")
        .agg(
            F.coalesce(F.sum("OrderUnits"), F.lit(0.0)).alias("Quantity"),
            F.count("OrderUnits").alias("Lines"),
            F.min(ts).alias("FirstTime"),
            F.max(ts).alias("LastTime"),
        )
    )


def series_histories(activity: DataFrame) -> DataFrame:
    """One row per series: order count, first and last order, and its days in order."""
    day = F.struct(F.col("Date").alias("timestamp"), F.col("Quantity").alias("y"))
    return activity.groupBy(*SERIES).agg(
        F.sum("Lines").alias("OrderCount"),
        F.min("FirstTime").alias("FirstOrderDate"),
        F.max("LastTime").alias("LastOrderDate"),
        F.sort_array(F.collect_list(day)).alias("points"),
    )


def product_table(lines: DataFrame) -> DataFrame:
    """One row per product: its least (name, category, vendor) tuple.

    A product listed under several names must not multiply the demand it is
    joined to, hence one row, picked by value and not by arrival.
    """
    text = [name for name in PRODUCT_TEXT if name in lines.columns]
    # combined within each task, so that at most one row per task and product is shuffled
    known = lines.where(F.col("ProductID").isNotNull())
    least = known.groupBy("ProductID").agg(F.min(F.struct(*text)).alias("info"))
    return least.select("ProductID", *[F.col(f"info.{name}").alias(name) for name in text])


def enrich(daily: DataFrame, products: DataFrame) -> DataFrame:
    """Add product text to daily rows.

    Left join on the product id. A small product table is broadcast by its size;
    a larger one is sort-merged, with hot products split by adaptive execution.
    """
    return daily.join(products, "ProductID", "left")


def demand_patterns(
    daily: DataFrame, products: DataFrame | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Demand statistics of each series, or of each part of it named by ``by``, over its days.

    Spread is the population deviation. The trend is the least-squares slope over
    positions 0..n-1, 0 below three days. The mean gap is NULL for a single day.
    """
    keys = [*by, *SERIES]
    in_order = Window.partitionBy(*keys).orderBy("Date")
    numbered = daily.withColumn("position", (F.row_number().over(in_order) - 1).cast("double"))
    q, n = F.col("Quantity"), F.count(F.lit(1))
    span = F.datediff(F.max("Date"), F.min("Date"))
    stats = numbered.groupBy(*keys).agg(
        n.alias("TotalOrders"),
        F.avg(q).alias("AvgQuantity"),
        F.stddev_pop(q).alias("StdQuantity"),
        F.max(q).alias("MaxQuantity"),
        F.min(q).alias("MinQuantity"),
        F.median(q).alias("MedianQuantity"),
        coefficient_of_variation(F.stddev_pop(q), F.avg(q)).alias("CoefficientOfVariation"),
        F.when(n > 2, F.regr_slope(q, F.col("position"))).otherwise(0.0).alias("TrendSlope"),
        F.when(n > 1, span / (n - 1)).alias("AvgDaysBetweenOrders"),
        F.min("Date").alias("FirstOrderDate"),
        F.max("Date").alias("LastOrderDate"),
    )
    if products is None:
        stats = stats.withColumns({name: F.lit(None).cast("string") for name in PRODUCT_TEXT})
    else:
        stats = enrich(stats, products)
    return stats.select(*by, *PATTERN_COLUMNS)


def demand_patterns_simple(lines: DataFrame, ts: str = "CreateDate") -> DataFrame:
    """Cheaper statistics over order lines rather than days, in one aggregation.

    Spread is the sample deviation, the median stands in as the mean, the trend
    as 0, and names are made from the product id.
    """
    q = F.col("OrderUnits") if "OrderUnits" in lines.columns else F.lit(1.0)
    stats = (
        lines.na.drop(subset=SERIES)
        .groupBy(*SERIES)
        .agg(
            F.count(q).alias("TotalOrders"),
            F.avg(q).alias("AvgQuantity"),
            F.coalesce(F.stddev_samp(q), F.lit(0.0)).alias("StdQuantity"),
            F.max(q).alias("MaxQuantity"),
            F.min(q).alias("MinQuantity"),
            F.min(ts).alias("FirstOrderDate"),
            F.max(ts).alias("LastOrderDate"),
        )
    )
    return _simple_columns(stats).select(*PATTERN_COLUMNS)


def _simple_columns(stats: DataFrame) -> DataFrame:
    pid = F.col("ProductID").cast("string")
    span = F.datediff("LastOrderDate", "FirstOrderDate")
    return stats.withColumns(
        {
            "MedianQuantity": F.col("AvgQuantity"),
            "CoefficientOfVariation": ratio(F.col("StdQuantity"), F.col("AvgQuantity"), 0.0),
            "TrendSlope": F.lit(0.0),
            "AvgDaysBetweenOrders": ratio(span, F.col("TotalOrders") - 1, 0.0),
            "ProductName": F.concat(F.lit("Product "), pid),
            "CategoryName": F.lit("General"),
            "VendorName": F.concat(F.lit("Vendor"), F.replace(pid, F.lit("PROD"), F.lit(""))),
        }
    )


# --- merging partial results ----------------------------------------------------------


def pattern_state(lines: DataFrame, by: list[str], ts: str = "CreateDate") -> DataFrame:
    """Mergeable state of the simple statistics, per series and ``by``."""
    q = F.col("OrderUnits")
    return (
        lines.na.drop(subset=SERIES)
        .groupBy(*by, *SERIES)
        .agg(
            F.count(q).alias("n"),
            F.sum(q).alias("s1"),
            F.sum(q * q).alias("s2"),
            F.min(q).alias("low"),
            F.max(q).alias("high"),
            F.min(ts).alias("first"),
            F.max(ts).alias("last"),
        )
    )


def merge_pattern_states(states: DataFrame) -> DataFrame:
    """Simple statistics of the union of all states, equal to one pass over the lines."""
    n, s1, s2 = F.sum("n"), F.sum("s1"), F.sum("s2")
    spread = F.greatest(s2 - F.try_divide(s1 * s1, n), F.lit(0.0))
    merged = states.groupBy(*SERIES).agg(
        n.alias("TotalOrders"),
        F.try_divide(s1, n).alias("AvgQuantity"),
        F.coalesce(F.sqrt(F.try_divide(spread, n - 1)), F.lit(0.0)).alias("StdQuantity"),
        F.max("high").alias("MaxQuantity"),
        F.min("low").alias("MinQuantity"),
        F.min("first").alias("FirstOrderDate"),
        F.max("last").alias("LastOrderDate"),
    )
    return _simple_columns(merged).select(*PATTERN_COLUMNS)


def merge_patterns_by_mean(patterns: DataFrame) -> DataFrame:
    """Merge finished pattern tables: counts add up, statistics are averaged unweighted."""
    means = [
        "AvgQuantity",
        "StdQuantity",
        "MedianQuantity",
        "CoefficientOfVariation",
        "TrendSlope",
        "AvgDaysBetweenOrders",
    ]
    return (
        patterns.groupBy(*SERIES)
        .agg(
            F.min(F.struct(*PRODUCT_TEXT)).alias("info"),
            F.sum("TotalOrders").alias("TotalOrders"),
            F.max("MaxQuantity").alias("MaxQuantity"),
            F.min("MinQuantity").alias("MinQuantity"),
            F.min("FirstOrderDate").alias("FirstOrderDate"),
            F.max("LastOrderDate").alias("LastOrderDate"),
            *[F.avg(name).alias(name) for name in means],
        )
        .withColumns({name: F.col(f"info.{name}") for name in PRODUCT_TEXT})
        .select(*PATTERN_COLUMNS)
    )


# --- forecast input tables ------------------------------------------------------------


def item_id(*parts: str | Column) -> Column:
    """Label of a series; different series never share one, so it can be grouped and joined by."""
    return joined_key("_", *[F.col(p) if isinstance(p, str) else p for p in parts])


def densify(daily: DataFrame) -> DataFrame:
    """Fill days without orders with quantity 0 between a series' first and last day."""
    spans = daily.groupBy(*SERIES).agg(F.min("Date").alias("a"), F.max("Date").alias("b"))
    days = spans.select(*SERIES, F.explode(F.sequence("a", "b")).alias("Date"))
    return days.join(daily, [*SERIES, "Date"], "left").withColumn(
        "Quantity", F.coalesce("Quantity", F.lit(0.0))
    )


def product_forecast_long(
    daily: DataFrame, products: DataFrame | None = None, dense: bool = False
) -> DataFrame:
    """Daily rows in the layout forecasting reads: one item per series."""
    rows = densify(daily) if dense else daily
    rows = rows if products is None else enrich(rows, products)
    pid = F.col("ProductID").cast("string")
    defaults = {
        "product_name": ("ProductName", F.concat(F.lit("Product "), pid)),
        "category_name": ("CategoryName", F.lit("General")),
        "vendor_name": (
            "VendorName",
            F.concat(F.lit("Vendor"), F.replace(pid, F.lit("PROD"), F.lit(""))),
        ),
    }
    text = [
        (F.coalesce(F.col(source), default) if source in rows.columns else default).alias(name)
        for name, (source, default) in defaults.items()
    ]
    return rows.select(
        item_id(*SERIES).alias("item_id"),
        F.col("Date").alias("timestamp"),
        F.col("Quantity").alias("target_value"),
        F.col("CustomerID").alias("customer_id"),
        F.col("FacilityID").alias("facility_id"),
        F.col("ProductID").alias("product_id"),
        *text,
        F.weekday("Date").alias("day_of_week"),
        F.month("Date").alias("month"),
    )


def by_series(df: DataFrame, key: str = "item_id", order: str = "timestamp") -> DataFrame:
    """Whole series together and in time order, for writing; not a global sort."""
    return df.repartition(key).sortWithinPartitions(key, order)


def customer_daily(lines: DataFrame, ts: str = "CreateDate") -> DataFrame:
    """Units, lines, distinct products and value per customer, facility and day."""
    aggregates = [
        F.count(F.lit(1)).alias("TotalItems"),
        F.count_distinct("ProductID").alias("UniqueProducts"),
    ]
    if "OrderUnits" in lines.columns:
        aggregates.append(F.coalesce(F.sum("OrderUnits"), F.lit(0.0)).alias("TotalUnits"))
    if "Price" in lines.columns:
        price = F.col("Price")
        value = F.col("OrderUnits") * price if "OrderUnits" in lines.columns else price
        aggregates.append(F.coalesce(F.sum(value), F.lit(0.0)).alias("TotalValue"))
    return _keyed(lines, PAIR, ts).groupBy(*PAIR, "Date").agg(*aggregates)


def customer_forecast_long(totals: DataFrame) -> DataFrame:
    """Customer-day totals as one series per metric, unpivoted from a single pass."""
    units = ("TOTAL_UNITS", "TotalUnits") if "TotalUnits" in totals.columns else (
        "TOTAL_ITEMS", "TotalItems")
    metrics = [units, ("UNIQUE_PRODUCTS", "UniqueProducts")]
    if "TotalValue" in totals.columns:
        metrics.append(("TOTAL_VALUE", "TotalValue"))
    wide = totals.select(
        *PAIR, "Date", *[F.col(column).cast("double").alias(metric) for metric, column in metrics]
    )
    long = wide.unpivot(
        [*PAIR, "Date"], [metric for metric, _ in metrics], "metric_type", "target_value"
    )
    return long.select(
        F.concat_ws("_", item_id(*PAIR), "metric_type").alias("item_id"),
        F.col("Date").alias("timestamp"),
        "target_value",
        F.col("CustomerID").alias("customer_id"),
        F.col("FacilityID").alias("facility_id"),
        "metric_type",
        F.weekday("Date").alias("day_of_week"),
        F.month("Date").alias("month"),
    )
