"""Every operator as a named query over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions import parsing
from orderlens.functions.calendar import month_share, weekday_share
from orderlens.operators import (
    calendar,
    codes,
    demand,
    explore,
    feedback,
    forecast,
    lookups,
    quality,
    recommend,
    registry,
    series,
)
from orderlens.plans import pipeline
from orderlens.schema import PAIR, SERIES
from orderlens.sources import files
from orderlens.sources.conform import with_default_names
from orderlens.sources.stages import stage_path, stored
from orderlens.sources.warehouse import order_lines, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY_COLUMNS = [*SERIES, "CreateDate", "OrderUnits"]
DAILY_COLUMNS = [*SERIES, "Date", "OrderUnits"]
TEXT_COLUMNS = ["ProductID", "ProductName", "CategoryName", "VendorName"]
AS_OF = dt.date(2001, 8, 2)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits: sums depend on the order of their terms."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema
        ]
    )


def query(run: Query) -> Query:
    """Register a query under its function's name."""
    QUERIES[run.__name__] = lambda spark, folder: rounded(run(spark, folder))
    return run


# --- shared inputs --------------------------------------------------------------------


def _daily(spark: SparkSession, folder: str, grain: str = "brand") -> DataFrame:
    return demand.daily_demand(order_lines(spark, folder, grain, DAILY_COLUMNS))


def _products(spark: SparkSession, folder: str, grain: str = "brand") -> DataFrame:
    return demand.product_table(order_lines(spark, folder, grain, TEXT_COLUMNS))


def _long(spark: SparkSession, folder: str, grain: str = "brand") -> DataFrame:
    return demand.product_forecast_long(
        _daily(spark, folder, grain), _products(spark, folder, grain)
    )


def _lookup(spark: SparkSession, folder: str, how: str = "left") -> DataFrame:
    lines = order_lines(spark, folder, "brand", DAY_COLUMNS)
    products = lookups.product_lookup(order_lines(spark, folder, "brand", TEXT_COLUMNS))
    return lookups.customer_product_lookup(lookups.relationships(lines), products, how)


def _dated(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.to_date(name) for name in names})


def _next_day(spark: SparkSession, folder: str) -> Column:
    """The day after the last order, as a subquery."""
    last = table(spark, folder, "orders").agg(F.max("o_orderdate"))
    return F.date_add(F.to_date(last.scalar()), 1)


def _damaged(lines: DataFrame) -> DataFrame:
    """Order lines with known faults, placed by order id."""
    order = F.col("OrderID")
    faults = {
        "OrderUnits": (order % 200 == 0, F.lit(-1.0)),
        "ProductName": (order % 100 == 0, F.lit(None)),
        "Price": (order % 333 == 0, F.lit(-5.0)),
        "CustomerID": (order % 400 == 0, F.lit(None)),
        "FacilityID": (order % 7 == 0, F.lit(None)),
    }
    return lines.withColumns(
        {
            name: F.when(where, value).otherwise(F.col(name))
            for name, (where, value) in faults.items()
            if name in lines.columns
        }
    )


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    history = demand.product_forecast_long(_daily(spark, folder))
    return forecast.evaluate_holdout(series.holdout_split(history))


def _pair_forecast(spark: SparkSession, folder: str) -> DataFrame:
    activity = demand.daily_activity(order_lines(spark, folder, "brand", [*DAY_COLUMNS, "Date"]))
    products = lookups.product_lookup(order_lines(spark, folder, "brand", TEXT_COLUMNS))
    return pipeline.forecast_pairs(activity, products, _next_day(spark, folder))


def _outlook(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.product_outlook(_pair_forecast(spark, folder), _next_day(spark, folder))


def _recommended(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.recommendations(_outlook(spark, folder))


# --- cleaning and calendar ------------------------------------------------------------


@query
def temporal_features(spark, folder):
    lines = order_lines(spark, folder, "fine", ["OrderID", "ProductID", "CreateDate"])
    return calendar.with_temporal_features(lines).drop("CreateDate")


@query
def temporal_features_hourly(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return calendar.with_temporal_features(events, "ts").drop("ts")


@query
def holiday_calendar(spark, folder):
    return calendar.holiday_calendar(table(spark, folder, "orders"), "o_orderdate")


@query
def holiday_flags(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    holidays = calendar.holiday_calendar(orders, "o_orderdate")
    return calendar.holiday_flags(orders, holidays, "o_orderdate").drop("o_orderdate")


@query
def parse_dates(spark, folder):
    ts, key = F.col("o_orderdate"), F.col("o_orderkey")
    layouts = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yy", "yyyy/MM/dd", "MM/dd/yyyy HH:mm", "yyyy/MM/dd HH:mm"]
    layouts += ["yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss.'000'", "yyyy-MM-dd'T'HH:mm"]
    raw = F.when(key % 10 == 9, F.lit("invalid-date"))
    for i, layout in enumerate(layouts):
        raw = raw.when(key % 10 == i, F.date_format(ts, layout))
    orders = table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))
    return orders.withColumn("parsed", F.to_date(parsing.parse_order_date(F.col("raw"))))


@query
def default_columns(spark, folder):
    part = table(spark, folder, "part").select(
        F.concat(F.lit("PROD"), F.col("p_partkey")).alias("ProductID"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("ProductName"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("CategoryName"),
    )
    return with_default_names(part)


@query
def json_from_text(spark, folder):
    key = F.col("event_id")
    text = F.when(key % 7 == 0, F.lit("no object here")).otherwise(
        F.concat(F.lit("Result for "), key, F.lit(": "), F.col("props"), F.lit(" end of text"))
    )
    parsed = parsing.json_from_text(text, "k int", F.struct(F.lit(-1).alias("k")))
    return table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))


@query
def feedback_validation(spark, folder):
    return feedback_rows(table(spark, folder, "events")).select(
        "event_id",
        F.coalesce("error_code", F.lit("OK")).alias("error_code"),
        "customer_id",
        "facility_id",
        "prediction_id",
        "rating",
        "actual_quantity",
        F.col("negative_actual_quantity").cast("int").alias("negative_quantity"),
    )


def feedback_rows(events: DataFrame) -> DataFrame:
    """Feedback made from events: as JSON bodies, some of them faulty, validated."""
    key = F.col("event_id")
    kinds = {"click": "accuracy", "view": "usefulness", "signup": "general", "purchase": "recommendation"}
    kind = F.lit("other")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    facility = F.when(key % 50 == 0, F.lit(None)).when(key % 51 == 0, " ").otherwise(
        (key % 9).cast("string")
    )
    quantity = (
        F.when(key % 10 == 0, "n/a")
        .when(key % 13 == 0, (-F.col("value")).cast("string"))
        .otherwise(F.col("value").cast("string"))
    )
    body = F.to_json(
        F.struct(
            F.concat(F.lit(" "), F.col("user_id")).alias("customer_id"),
            facility.alias("facility_id"),
            key.alias("prediction_id"),
            kind.alias("feedback_type"),
            (F.get_json_object("props", "$.k").try_cast("int") % 7).alias("rating"),
            quantity.alias("actual_quantity"),
        )
    )
    bodies = events.select("event_id", F.when(key % 97 == 0, "{broken").otherwise(body).alias("body"))
    return feedback.validate_feedback(feedback.parse_feedback(bodies).drop("body"))


# --- demand ---------------------------------------------------------------------------


@query
def daily_demand(spark, folder):
    return _daily(spark, folder)


@query
def daily_demand_count(spark, folder):
    lines = order_lines(spark, folder, "brand", [*SERIES, "Date"])
    return demand.daily_demand(lines)


@query
def daily_demand_dense(spark, folder):
    return demand.densify(_daily(spark, folder)).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.col("Quantity") == 0).alias("n_empty"),
        F.sum("Quantity").alias("total"),
    )


@query
def daily_demand_enriched(spark, folder):
    return demand.enrich(_daily(spark, folder), _products(spark, folder))


@query
def demand_patterns(spark, folder):
    return demand.demand_patterns(_daily(spark, folder), _products(spark, folder))


@query
def demand_patterns_simple(spark, folder):
    lines = order_lines(spark, folder, "fine", DAY_COLUMNS)
    return _dated(demand.demand_patterns_simple(lines), "FirstOrderDate", "LastOrderDate")


@query
def merge_patterns(spark, folder):
    lines = order_lines(spark, folder, "brand", DAY_COLUMNS)
    states = demand.pattern_state(lines.withColumn("chunk", F.year("CreateDate")), ["chunk"])
    return _dated(demand.merge_pattern_states(states), "FirstOrderDate", "LastOrderDate")


@query
def merge_patterns_mean(spark, folder):
    daily = _daily(spark, folder).withColumn("chunk", F.year("Date"))
    chunks = demand.demand_patterns(daily, _products(spark, folder), by=("chunk",))
    return demand.merge_patterns_by_mean(chunks)


@query
def customer_daily(spark, folder):
    return demand.customer_daily(order_lines(spark, folder, "brand", [*DAILY_COLUMNS, "Price"]))


@query
def customer_forecast_long(spark, folder):
    lines = order_lines(spark, folder, "brand", [*DAILY_COLUMNS, "Price"])
    return demand.customer_forecast_long(demand.customer_daily(lines))


@query
def product_forecast_long(spark, folder):
    return _long(spark, folder)


# --- lookups --------------------------------------------------------------------------


@query
def product_lookup(spark, folder):
    return lookups.product_lookup(order_lines(spark, folder, "fine", TEXT_COLUMNS))


@query
def product_lookup_union(spark, folder):
    tables = [
        lookups.product_lookup(order_lines(spark, folder, grain, TEXT_COLUMNS))
        for grain in ("brand", "type")
    ]
    return lookups.merge_product_lookups(*tables, tables[0])


@query
def customer_product_lookup(spark, folder):
    return _dated(_lookup(spark, folder), "FirstOrderDate", "LastOrderDate")


@query
def customer_product_inner(spark, folder):
    lines = order_lines(spark, folder, "fine", DAY_COLUMNS)
    known = table(spark, folder, "part").select(
        F.col("p_partkey").alias("ProductID"),
        F.col("p_name").alias("ProductName"),
        F.col("p_brand").alias("CategoryName"),
        F.concat(F.lit("Vendor"), F.col("p_partkey")).alias("vendorName"),
    )
    joined = lookups.customer_product_lookup(lookups.relationships(lines), known, "inner")
    return _dated(joined, "FirstOrderDate", "LastOrderDate")


@query
def lookup_items(spark, folder):
    products = lookups.product_lookup(order_lines(spark, folder, "brand", TEXT_COLUMNS))
    return lookups.lookup_items(products, _lookup(spark, folder))


@query
def lookup_by_customer_facility(spark, folder):
    products = lookups.product_lookup(order_lines(spark, folder, "brand", TEXT_COLUMNS))
    root = stage_path(spark, "lookup-items")
    files.write_lookup_items(lookups.lookup_items(products, _lookup(spark, folder)), root, "run")
    return lookups.items_of_pair(files.read_lookup_items(spark, root, "run"), "FURNITURE#2")


@query
def customer_products(spark, folder):
    return _dated(
        lookups.products_of(_lookup(spark, folder), " FURNITURE ", "2"),
        "FirstOrderDate",
        "LastOrderDate",
    )


@query
def top_products_per_facility(spark, folder):
    return lookups.top_products(_lookup(spark, folder)).select(*SERIES, "OrderCount", "rank")


@query
def distinct_pairs(spark, folder):
    return lookups.distinct_pairs(order_lines(spark, folder, "fine", PAIR))


@query
def latest_snapshot(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return _dated(files.latest_only(orders, "o_orderdate"), "o_orderdate")


# --- exploration ----------------------------------------------------------------------


@query
def orders_by_day(spark, folder):
    return explore.orders_by_day(order_lines(spark, folder, columns=["CreateDate"]))


@query
def orders_by_weekday(spark, folder):
    return explore.orders_by_weekday(order_lines(spark, folder, columns=["CreateDate"]))


@query
def top_products(spark, folder):
    lines = order_lines(spark, folder, "fine", ["ProductID", "ProductName"])
    return explore.top_by_count(lines, ["ProductID", "ProductName"], 20)


@query
def top_series(spark, folder):
    history = demand.product_forecast_long(_daily(spark, folder))
    return explore.top_by_count(history, ["item_id"], 5)


@query
def dataset_overview(spark, folder):
    return explore.dataset_overview(_damaged(order_lines(spark, folder, "brand")))


@query
def series_length_stats(spark, folder):
    return explore.series_length_stats(explore.series_lengths(_daily(spark, folder), SERIES))


@query
def series_length_hist(spark, folder):
    return explore.series_length_histogram(explore.series_lengths(_daily(spark, folder), SERIES))


# --- quality --------------------------------------------------------------------------

CHECKED_COLUMNS = ["OrderID", *DAY_COLUMNS, "Price"]


@query
def dq_nulls(spark, folder):
    return quality.null_checks(_damaged(order_lines(spark, folder, "brand", CHECKED_COLUMNS)))


@query
def dq_dates(spark, folder):
    orders = table(spark, folder, "orders")
    raw = F.when(F.col("o_orderkey") % 250 == 0, "invalid-date").otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy")
    )
    found = quality.date_checks(orders.select(raw.alias("CreateDate")), AS_OF)
    return found.withColumns({name: F.col(name).cast("int") for name in ("too_old", "too_new")})


@query
def dq_value_checks(spark, folder):
    lines = order_lines(spark, folder, "brand", ["OrderID", "OrderUnits", "Price"])
    return quality.value_checks(_damaged(lines))


@query
def dq_duplicates(spark, folder):
    return quality.duplicate_rows(order_lines(spark, folder, "brand", DAY_COLUMNS))


@query
def dq_fd_violations(spark, folder):
    lines = order_lines(spark, folder, "fine", ["CategoryName", "ProductName"])
    return quality.dependency_violations(lines, "CategoryName", "ProductName")


@query
def dq_checks(spark, folder):
    lines = _damaged(order_lines(spark, folder, "brand"))
    return quality.validation_checks(lines, AS_OF).drop("message")


@query
def dq_verdict(spark, folder):
    lines = stored(order_lines(spark, folder, "brand"), "lines")
    sets = {"clean": lines, "damaged": _damaged(lines)}
    parts = [
        quality.verdict(quality.validation_checks(df, AS_OF)).withColumn("dataset", F.lit(name))
        for name, df in sets.items()
    ]
    return parts[0].unionByName(parts[1])


@query
def numeric_profile(spark, folder):
    # read once per pass of the quantiles: join and divide once
    lines = order_lines(spark, folder, columns=["OrderID", "VendorID", "OrderUnits", "Price"])
    return quality.numeric_profile(stored(lines, "numbers"))


@query
def iqr_outliers(spark, folder):
    lines = order_lines(spark, folder, columns=["OrderUnits", "Price"])
    return quality.iqr_outliers(stored(lines, "numbers"))


@query
def categorical_profile(spark, folder):
    lines = order_lines(spark, folder, "fine", ["OrderID", "ProductName", "CategoryName", "VendorName"])
    return quality.categorical_profile(_damaged(lines))


@query
def categorical_top5(spark, folder):
    lines = order_lines(spark, folder, "fine", ["OrderID", "ProductName", "CategoryName", "VendorName"])
    return quality.categorical_top(_damaged(lines))


@query
def business_rules(spark, folder):
    return quality.business_rules(_damaged(order_lines(spark, folder, "fine")))


def _scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    # without the order id, some lines of a day are copies of one another
    return _damaged(order_lines(spark, folder, "brand", ["OrderID", *DAY_COLUMNS])).drop("OrderID")


@query
def quality_score(spark, folder):
    return quality.quality_score(_scored_lines(spark, folder))


@query
def quality_recommendations(spark, folder):
    return quality.quality_recommendations(quality.quality_score(_scored_lines(spark, folder)))


@query
def validation_report(spark, folder):
    # the report reads its lines several times: join them once
    lines = stored(_damaged(order_lines(spark, folder, "brand")), "lines")
    report = quality.validation_report(lines, AS_OF)
    return report.withColumn("recommendations", F.array_join("recommendations", " | "))


# --- series ---------------------------------------------------------------------------


def _series(spark: SparkSession, folder: str) -> DataFrame:
    history = demand.product_forecast_long(_daily(spark, folder))
    return pipeline.stored_series(history, _products(spark, folder))


def _codes(arrays: DataFrame) -> DataFrame:
    return codes.category_codes(series.at_least(arrays))


@query
def category_codes(spark, folder):
    return _codes(_series(spark, folder))


@query
def encode_categories(spark, folder):
    arrays = _series(spark, folder)
    encoded = codes.encode(arrays, _codes(arrays), codes.DEFAULT_CARDINALITY)
    return encoded.select("item_id", "customer_cat", "facility_cat", "category_cat")


@query
def series_context(spark, folder):
    history = demand.product_forecast_long(_daily(spark, folder))
    return series.series_context(history).select("item_id", "timestamp", "target_value", "position")


@query
def holdout_split(spark, folder):
    history = demand.product_forecast_long(_daily(spark, folder))
    return series.holdout_split(history).select("item_id", "timestamp", "target_value", "split")


def _instance_totals(instances: DataFrame) -> DataFrame:
    def added(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda total, x: total + x)

    return instances.select(
        "item_id",
        "part",
        "start",
        F.size("target").alias("n_points"),
        added(F.col("target")).alias("target_sum"),
        *[F.col("cat")[i].alias(f"{name}_cat") for i, name in enumerate(codes.FEATURES)],
        *[
            added(F.col("dynamic_feat")[i]).alias(f"{name}_sum")
            for i, name in enumerate(["weekday", "month"])
        ],
        F.col("product_info.product_id").alias("product_id"),
    )


@query
def series_instances(spark, folder):
    instances, _ = pipeline.training_sets(_series(spark, folder))
    return _instance_totals(instances)


@query
def inference_instances(spark, folder):
    arrays = _series(spark, folder)
    instances = series.inference_instances(arrays, _codes(arrays))
    rows = instances.select(
        "item_id", "start", "target", "dynamic_feat", F.posexplode(F.col("dynamic_feat")[0]).alias("position", "weekday_share")
    )
    return rows.select(
        "item_id",
        "start",
        "position",
        F.get("target", F.col("position")).alias("target"),
        "weekday_share",
        F.get(F.col("dynamic_feat")[1], F.col("position")).alias("month_share"),
    )


@query
def request_payload(spark, folder):
    arrays = _series(spark, folder)
    requests = series.request_payload(series.inference_instances(arrays, _codes(arrays)))
    # read back what was sent
    instance = "struct<start:string,target:array<double>,cat:array<int>,dynamic_feat:array<array<double>>>"
    settings = "struct<num_samples:int,output_types:array<string>,quantiles:array<string>>"
    body = parsing.json_object(F.col("payload"), f"instances array<{instance}>, configuration {settings}")
    sent = requests.select("item_id", body.alias("body")).select(
        "item_id", F.inline("body.instances"), F.col("body.configuration").alias("configuration")
    )
    return sent.select(
        "item_id",
        "start",
        F.size("target").alias("n_points"),
        F.aggregate("target", F.lit(0.0), lambda total, y: total + y).alias("target_sum"),
        F.size(F.col("dynamic_feat")[1]).alias("n_days"),
        F.array_join(F.col("cat").cast("array<string>"), ",").alias("cat"),
        "configuration.num_samples",
        F.array_join("configuration.quantiles", ",").alias("quantiles"),
    )


@query
def series_product_info(spark, folder):
    history = _long(spark, folder)
    lengths = explore.series_lengths(history, ["item_id"])
    return series.with_product_info(lengths, series.product_info(history))


# --- forecasts ------------------------------------------------------------------------


@query
def forecast_calendar(spark, folder):
    items = order_lines(spark, folder, "brand", SERIES).distinct()
    days = calendar.forecast_calendar(
        items.select(demand.item_id(*SERIES).alias("item_id")), _next_day(spark, folder), 14
    )
    day = F.col("ds")
    return days.withColumns(
        {"weekday_share": weekday_share(day), "month_share": month_share(day)}
    )


BASELINE_COLUMNS = [*SERIES, "ds", "p10", "p50", "p90", "mean"]


@query
def baseline_forecast(spark, folder):
    rows = forecast.baseline_forecast(_lookup(spark, folder), _next_day(spark, folder))
    return rows.select(*BASELINE_COLUMNS)


@query
def baseline_forecast_fallback(spark, folder):
    rows = forecast.fallback_forecast(_lookup(spark, folder), _next_day(spark, folder))
    return rows.select(*BASELINE_COLUMNS, F.col("mock_data").cast("int").alias("mock_data"))


@query
def model_forecast_fallback(spark, folder):
    def last_and_range(rows: pd.DataFrame) -> pd.DataFrame:
        """Repeats the last quantity, between the least and the largest; refuses some series."""
        y = rows["y"]
        if y.iloc[-1] > 40:
            raise ValueError(f"last quantity {y.iloc[-1]:.0f} is out of range")
        days = [AS_OF + dt.timedelta(days=i) for i in range(14)]
        return pd.DataFrame({"ds": days, "p10": y.min(), "p50": y.iloc[-1], "p90": y.max()})

    activity = demand.daily_activity(order_lines(spark, folder, "brand", [*DAY_COLUMNS, "Date"]))
    products = lookups.product_lookup(order_lines(spark, folder, "brand", TEXT_COLUMNS))
    rows = pipeline.forecast_pairs(activity, products, F.lit(AS_OF), model=last_and_range)
    flag = F.col("mock_data").cast("int").alias("mock_data")
    return rows.select(*SERIES, "ProductName", "OrderCount", "ds", "p10", "p50", "p90", flag, "error")


@query
def seasonal_quantile_forecast(spark, folder):
    history = demand.product_forecast_long(_daily(spark, folder))
    return forecast.seasonal_forecast(history, _next_day(spark, folder))


@query
def quantiles_to_rows(spark, folder):
    history = demand.product_forecast_long(_daily(spark, folder))
    as_of = _next_day(spark, folder)
    arrays = forecast.quantile_arrays(forecast.seasonal_forecast(history, as_of), ["item_id"])
    return forecast.quantiles_to_rows(arrays, as_of)


@query
def forecast_stats(spark, folder):
    return forecast.forecast_stats(_pair_forecast(spark, folder), SERIES)


@query
def forecast_insight_stats(spark, folder):
    return forecast.forecast_insight_stats(_scored(spark, folder), ["item_id"])


@query
def analyst_payload(spark, folder):
    stats = forecast.forecast_stats(_pair_forecast(spark, folder), SERIES)
    payloads = forecast.analyst_payload(stats, PAIR)
    product = "struct<ProductID:string,p50_avg:double,trend:string,confidence_score:double>"
    products = F.from_json("payload", f"array<{product}>")
    return payloads.select(*PAIR, F.posexplode(products).alias("position", "p")).select(
        *PAIR, "position", "p.*"
    )


@query
def forecast_accuracy(spark, folder):
    return forecast.forecast_accuracy(_scored(spark, folder))


@query
def forecast_accuracy_total(spark, folder):
    return forecast.forecast_accuracy_total(_scored(spark, folder))


@query
def result_records(spark, folder):
    records = forecast.result_records(_scored(spark, folder))
    values = F.arrays_zip("actual_values", "predicted_values", "p10_values", "p90_values")
    return records.select("item_id", "metrics.rmse", F.posexplode(values).alias("position", "v")).select(
        "item_id", "rmse", "position", "v.*"
    )


@query
def quantile_loss(spark, folder):
    return forecast.quantile_loss(_scored(spark, folder))


# --- recommendations ------------------------------------------------------------------


@query
def recommendations(spark, folder):
    return _recommended(spark, folder)


@query
def ordering_schedule(spark, folder):
    schedule = recommend.ordering_schedule(_recommended(spark, folder))
    return schedule.withColumn("products", F.array_join("products", ", "))


@query
def recommendation_insights(spark, folder):
    return recommend.recommendation_insights(_outlook(spark, folder))


@query
def high_confidence_products(spark, folder):
    rows = _pair_forecast(spark, folder)
    chosen = recommend.recommendations(recommend.product_outlook(rows, _next_day(spark, folder)))
    return recommend.high_confidence_products(rows, chosen)


@query
def prediction_summary(spark, folder):
    return recommend.prediction_summary(_outlook(spark, folder))


@query
def procurement_report(spark, folder):
    level = (
        F.when(F.col("trend") == "increasing", "High")
        .when(F.col("trend") == "stable", "Medium")
        .otherwise("Low")
    )
    chosen = _recommended(spark, folder).withColumn("priority_level", level)
    return recommend.procurement_report(chosen, ["product_id", *PAIR]).drop("reasoning", "combined_score")


@query
def procurement_top_quantities(spark, folder):
    chosen = recommend.top_quantities(_recommended(spark, folder), ["product_id", *PAIR])
    return chosen.select(*PAIR, "product_id", "recommended_quantity", "confidence")


@query
def prediction_bundle(spark, folder):
    bundle = recommend.prediction_bundle(_outlook(spark, folder), _next_day(spark, folder))
    return bundle.select(
        "customerId",
        "facilityId",
        "timestamp",
        F.size("productPredictions").alias("n_products"),
        F.size("recommendations.recommended_products").alias("n_recommended"),
        F.col("recommendations.recommended_products")[0]["product_id"].alias("best_product"),
        F.col("recommendations.ordering_schedule")[0]["date"].alias("first_date"),
        F.col("summary.avg_confidence").alias("avg_confidence"),
    )


@query
def recommendation_defaults(spark, folder):
    bundle = recommend.prediction_bundle(_outlook(spark, folder), _next_day(spark, folder))
    kind = F.pmod(F.col("facilityId"), F.lit(3))
    # one pair in three answered without insights, one in three with only a part of them
    partial = F.to_json(F.struct(F.struct(F.lit("Steady").alias("seasonal_trends")).alias("insights")))
    answers = bundle.select(
        "customerId",
        "facilityId",
        F.when(kind == 0, F.lit("Answer: {\"recommended_products\": []} .")).when(kind == 1, partial)
        .otherwise(F.to_json("recommendations")).alias("response"),
    )
    filled = recommend.with_response_defaults(
        recommend.parse_response(answers).select("customerId", "facilityId", "recommendations.*")
    )
    return filled.select(
        "customerId",
        "facilityId",
        F.size("recommended_products").alias("n_recommended"),
        "insights.*",
    )


# --- run registry ---------------------------------------------------------------------


@query
def registry_freshness(spark, folder):
    runs = table(spark, folder, "events").select(
        F.col("user_id").alias("kind"), F.col("ts").cast("timestamp").alias("end_time")
    )
    found = registry.freshness(runs, F.lit(dt.date(2024, 2, 6)), ["kind"])
    return _dated(found, "latest_end_time").withColumn("retrain", F.col("retrain").cast("int"))


@query
def registry_retention(spark, folder):
    runs = table(spark, folder, "events").select(
        F.col("user_id").alias("kind"), F.col("event_id").alias("name"), F.col("ts").alias("created")
    )
    return registry.retention(runs).drop("created")


@query
def run_metrics(spark, folder):
    metrics = table(spark, folder, "events").select(
        F.col("user_id").alias("name"),
        F.col("event_type").alias("metric"),
        "value",
        F.col("ts").alias("end_time"),
    )
    found = registry.run_metrics(metrics)
    return _dated(found, "end_time").select("name", "end_time", F.explode("metrics").alias("metric", "value"))
