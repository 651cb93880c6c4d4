"""Order recommendations, their schedule, summaries and response shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.parsing import json_from_text
from orderlens.functions.stats import clamp, count_where
from orderlens.schema import PAIR, SERIES

HIGH_CONFIDENCE = 80

RECOMMENDED_PRODUCT = (
    "struct<product_name:string,product_id:string,recommended_quantity:int,confidence:int,"
    "optimal_order_date:string,reasoning:string>"
)
SCHEDULE_ENTRY = "struct<date:string,products:array<string>,total_items:bigint>"
INSIGHTS = "struct<seasonal_trends:string,risk_assessment:string,cost_optimization:string>"
RESPONSE = (
    f"recommended_products array<{RECOMMENDED_PRODUCT}>, "
    f"ordering_schedule array<{SCHEDULE_ENTRY}>, insights {INSIGHTS}"
)

# Texts for absent insights, then for an absent field among others.
ABSENT_INSIGHTS = {
    "seasonal_trends": "No trend analysis available",
    "risk_assessment": "Risk assessment unavailable",
    "cost_optimization": "Cost optimization suggestions unavailable",
}
ABSENT_FIELDS = {
    "seasonal_trends": "Seasonal Trends unavailable",
    "risk_assessment": "Risk Assessment unavailable",
    "cost_optimization": "Cost Optimization unavailable",
}


def product_outlook(forecast: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row per forecast product: its score within the pair and what to order.

    ``forecast`` holds dated quantiles with the product's text and OrderCount. The
    score weighs predicted demand, order history and trend. Every table below is a
    filter or one aggregate of this one. A pair has as many rows here as products
    were forecast for it, each with a horizon of predictions. A forecast with ``mock_data``
    (fallbacks of a model) passes the flag on.
    """
    p50 = F.coalesce("p50", "mean", F.lit(0.0))
    quantiles = F.struct("p10", "p50", "p90", "mean")
    text = ["CategoryName", "vendorName", "FirstOrderDate", "LastOrderDate", "mock_data"]
    text = [c for c in text if c in forecast.columns]
    per_product = forecast.groupBy(*SERIES).agg(
        F.max("ProductName").alias("product_name"),
        F.max("OrderCount").alias("OrderCount"),
        *[F.max(c).alias(c) for c in text],
        F.avg(p50).alias("avg_predicted"),
        (F.max_by(p50, "ds") - F.min_by(p50, "ds")).alias("trend_score"),
        F.avg(F.coalesce("p90", F.lit(0.0)) - F.coalesce("p10", F.lit(0.0))).alias("width"),
        F.sort_array(F.collect_list(F.struct("ds", quantiles.alias("q")))).alias("predictions"),
    )
    # Weights of demand, history and trend.
    score = (
        F.col("avg_predicted") * 0.7 + (F.col("OrderCount") / 100) * 0.3 + F.col("trend_score") * 0.1
    )
    average, trend = F.col("avg_predicted"), F.col("trend_score")
    confidence = F.when(
        average > 0, clamp(100 - F.try_divide(F.col("width"), average) * 50, 50.0, 95.0)
    ).otherwise(60.0)
    direction = F.when(trend > 0, "increasing").when(trend == 0, "stable").otherwise("decreasing")
    coming = F.aggregate(
        F.slice("predictions", 1, days), F.lit(0.0), lambda s, p: s + F.coalesce(p["q"]["mean"], F.lit(0.0))
    )
    return (
        per_product.withColumn("combined_score", score)
        .withColumns(
            {
                "product_id": F.col("ProductID"),
                "recommended_quantity": F.greatest(F.lit(1), (average * 1.1).cast("int")),
                "confidence": confidence.cast("int"),
                "optimal_order_date": F.date_add(as_of, F.when(trend >= 0, 1).otherwise(2)),
                # rounded half to even before printing, as %.1f alone rounds half up
                "reasoning": F.format_string(
                    "Predicted avg demand: %.1f, trend: %s, historical orders: %d",
                    F.bround(average, 1),
                    direction,
                    F.col("OrderCount"),
                ),
                "trend": direction,
                "coming_demand": coming,
            }
        )
    )


def ranked(outlook: DataFrame, k: int | None = None) -> DataFrame:
    """Products with their rank within the pair; with ``k`` the best only.

    The limit sits on the ranking window, so a task sends its k best products of a pair and no more.
    """
    best = Window.partitionBy(*PAIR).orderBy(F.desc("combined_score"), "ProductID")
    rows = outlook.withColumn("rank", F.row_number().over(best))
    return rows if k is None else rows.where(F.col("rank") <= k)


RECOMMENDED = [
    "product_name",
    "product_id",
    "recommended_quantity",
    "confidence",
    "optimal_order_date",
    "reasoning",
]


def recommendations(outlook: DataFrame, k: int = 5) -> DataFrame:
    """The k best products of each customer and facility, with quantity and order date."""
    return ranked(outlook, k).select(*PAIR, "rank", *RECOMMENDED, "combined_score", "trend")


def ordering_schedule(recommended: DataFrame) -> DataFrame:
    """What each pair orders on each day: products in rank order and total quantity."""
    named = F.sort_array(F.collect_list(F.struct("rank", "product_name")))
    return (
        recommended.groupBy(*PAIR, F.col("optimal_order_date").alias("date"))
        .agg(
            named.alias("named"),
            F.sum("recommended_quantity").alias("total_items"),
        )
        .select(*PAIR, "date", F.col("named.product_name").alias("products"), "total_items")
    )


def _pair_counts(outlook: DataFrame, k: int) -> DataFrame:
    """Per pair: products, recommendations, confidence, demand and dates.

    Sums over all products are combined before the shuffle, and only the k best products of a pair are
    ranked, so a pair of very many products is no group of that size.
    """
    totals = outlook.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("total_products"), F.sum("coming_demand").alias("coming_demand")
    )
    best = outlook.select(*SERIES, "combined_score", "confidence", "optimal_order_date")
    chosen = ranked(best, k).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("recommended"),
        count_where(F.col("confidence") > HIGH_CONFIDENCE).alias("high_confidence"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        # the best recommendation opens the schedule
        F.min_by("optimal_order_date", "rank").alias("next_date"),
    )
    return totals.join(chosen, PAIR)


def _insights() -> dict[str, Column]:
    # Insight texts.
    return {
        "seasonal_trends": F.format_string(
            "Analysis based on %d products with varying demand patterns. "
            "Consider seasonal factors for procurement planning.",
            "total_products",
        ),
        "risk_assessment": F.format_string(
            "%d/%d recommendations have high confidence (>80%%). Average confidence: %.1f%%",
            F.col("high_confidence"),
            F.col("recommended"),
            F.bround("avg_confidence", 1),
        ),
        "cost_optimization": F.lit(
            "Consider consolidating orders by date to reduce procurement costs. "
            "Monitor high-volatility products for inventory optimization."
        ),
    }


def recommendation_insights(outlook: DataFrame, k: int = 5) -> DataFrame:
    """Counts and texts about the recommendations of each pair."""
    return _pair_counts(outlook, k).drop("coming_demand", "next_date").withColumns(_insights())


def high_confidence_products(
    forecast: DataFrame, recommended: DataFrame, threshold: int = HIGH_CONFIDENCE
) -> DataFrame:
    """How many forecast products of each pair are recommended with high confidence.

    For recommendations that come from elsewhere; those of an outlook are counted
    in its summary. Both sides meet as rows unique by series.
    """
    confident = recommended.where(F.col("confidence") > threshold).select(
        *PAIR, F.col("product_id").alias("ProductID"), F.lit(1).alias("_hit")
    )
    products = forecast.select(*SERIES).distinct()
    return (
        products.join(confident.distinct(), SERIES, "left")
        .groupBy(*PAIR)
        .agg(F.count("_hit").alias("high_confidence_products"))
    )


def _summary() -> dict[str, Column]:
    # Names of the summary's fields.
    return {
        "total_products_analyzed": F.col("total_products"),
        "total_predicted_demand_7days": F.col("coming_demand"),
        "recommended_products_count": F.col("recommended"),
        "high_confidence_products": F.col("high_confidence"),
        "avg_confidence": F.col("avg_confidence"),
        "next_suggested_order_date": F.col("next_date"),
    }


def prediction_summary(outlook: DataFrame, k: int = 5) -> DataFrame:
    """Summary of each pair: products, demand of the next days, confidence, next order date."""
    return _pair_counts(outlook, k).select(*PAIR, *[c.alias(name) for name, c in _summary().items()])


# --- reports --------------------------------------------------------------------------


def _priority(level: Column) -> Column:
    # Weight of each priority.
    return (
        F.when(F.lower(level) == "high", 3)
        .when(F.lower(level) == "medium", 2)
        .when(F.lower(level) == "low", 1)
        .otherwise(0)
    )


def procurement_report(items: DataFrame, ties: list[str]) -> DataFrame:
    """All recommendations, by priority if they have one, else by confidence."""
    if "priority_level" in items.columns:
        items = items.withColumn("priority_value", _priority(F.col("priority_level")))
        lead = F.desc("priority_value")
    else:
        lead = F.desc("confidence")
    return items.orderBy(lead, *ties)


def top_quantities(items: DataFrame, ties: list[str], k: int = 10) -> DataFrame:
    """The k recommendations of largest quantity."""
    return items.orderBy(F.desc("recommended_quantity"), *ties).limit(k)


# --- response shapes ------------------------------------------------------------------


def parse_response(answers: DataFrame, text: str = "response") -> DataFrame:
    """Recommendations out of an analyst's free text; NULL where it holds no JSON."""
    parsed = json_from_text(F.col(text), RESPONSE)
    return answers.withColumn("recommendations", parsed)


def with_response_defaults(bundles: DataFrame) -> DataFrame:
    """Fill absent parts of a recommendation: empty lists and standard texts."""
    insights = F.struct(
        *[
            F.when(F.col("insights").isNull(), ABSENT_INSIGHTS[name])
            .otherwise(F.coalesce(F.col(f"insights.{name}"), F.lit(ABSENT_FIELDS[name])))
            .alias(name)
            for name in ABSENT_INSIGHTS
        ]
    )
    return bundles.withColumns(
        {
            "recommended_products": F.coalesce(
                "recommended_products", F.array().cast(f"array<{RECOMMENDED_PRODUCT}>")
            ),
            "ordering_schedule": F.coalesce(
                "ordering_schedule", F.array().cast(f"array<{SCHEDULE_ENTRY}>")
            ),
            "insights": insights,
        }
    )


def _schedule(recommended: Column) -> Column:
    """Ordering schedule of a ranked recommendation array, in order of first mention."""

    def entry(date: Column) -> Column:
        same = F.filter(recommended, lambda r: r["optimal_order_date"] == date)
        return F.struct(
            date.cast("string").alias("date"),
            F.transform(same, lambda r: r["product_name"]).alias("products"),
            F.aggregate(
                same, F.lit(0).cast("bigint"), lambda n, r: n + r["recommended_quantity"]
            ).alias("total_items"),
        )

    return F.transform(F.array_distinct(recommended["optimal_order_date"]), entry)


def prediction_bundle(outlook: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    """The full nested result of every customer and facility.

    It lists the predictions of all products of a pair, in rank order, as one row: a pair of very many
    products makes one long row. :func:`recommendations`, :func:`prediction_summary` and
    :func:`recommendation_insights` give the same without such lists.
    """
    day = F.transform("predictions", lambda p: F.struct(p["ds"].cast("string"), p["q"]))
    product = F.struct(
        "rank",
        *RECOMMENDED,
        F.struct(
            F.col("ProductID").alias("product_id"),
            "product_name",
            F.col("CategoryName").alias("category_name"),
            F.col("vendorName").alias("vendor_name"),
            F.map_from_entries(day).alias("predictions"),
            F.struct(
                F.col("OrderCount").alias("order_count"),
                F.col("FirstOrderDate").alias("first_order"),
                F.col("LastOrderDate").alias("last_order"),
            ).alias("order_history"),
            *[c for c in ["mock_data"] if c in outlook.columns],
        ).alias("prediction"),
    )
    listed = ranked(outlook).groupBy(*PAIR).agg(
        F.array_sort(
            F.collect_list(product),
            lambda a, b: (a["rank"] - b["rank"]).cast("int"),
        ).alias("products")
    )
    grouped = listed.join(_pair_counts(outlook, k), PAIR)
    listed = F.transform(
        F.filter("products", lambda p: p["rank"] <= k),
        lambda p: F.struct(*[p[name].alias(name) for name in RECOMMENDED]),
    )
    identity = F.sha2(
        F.concat_ws("|", as_of.cast("string"), *[F.col(c).cast("string") for c in PAIR]), 256
    )
    return grouped.withColumn("recommended_products", listed).select(
        identity.alias("id"),
        as_of.alias("timestamp"),
        F.col("CustomerID").alias("customerId"),
        F.col("FacilityID").alias("facilityId"),
        F.col("products.prediction").alias("productPredictions"),
        F.struct(
            "recommended_products",
            _schedule(F.col("recommended_products")).alias("ordering_schedule"),
            F.struct(*[c.alias(name) for name, c in _insights().items()]).alias("insights"),
        ).alias("recommendations"),
        F.struct(*[c.alias(name) for name, c in _summary().items()]).alias("summary"),
    )
