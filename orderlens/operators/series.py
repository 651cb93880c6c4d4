"""Series as training and inference instances, context windows and hold-out splits.

A series has at most one point per calendar day, so its points fit an array or a
window partition however many order lines went into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.calendar import following_days, month_share, weekday_share
from orderlens.operators.codes import FEATURES, encode
from orderlens.schema import CONTEXT_LENGTH, PREDICTION_LENGTH

IDS = ["customer_id", "facility_id", "product_id"]
TEXT = ["product_name", "category_name"]


def _window():
    return Window.partitionBy("item_id")


def long_enough(long: DataFrame, points: int = CONTEXT_LENGTH + PREDICTION_LENGTH) -> DataFrame:
    """Rows of the series that have at least that many points."""
    counted = long.withColumn("_n", F.count(F.lit(1)).over(_window()))
    return counted.where(F.col("_n") >= points).drop("_n")


def series_context(long: DataFrame, context: int = CONTEXT_LENGTH) -> DataFrame:
    """Last ``context`` points of each series that has so many, numbered from 0."""
    newest = _window().orderBy(F.desc("timestamp"))
    ranked = long.withColumns(
        {"_back": F.row_number().over(newest), "_n": F.count(F.lit(1)).over(_window())}
    )
    kept = ranked.where((F.col("_n") >= context) & (F.col("_back") <= context))
    return kept.withColumn("position", context - F.col("_back")).drop("_back", "_n")


def holdout_split(
    long: DataFrame, horizon: int = PREDICTION_LENGTH, context: int = CONTEXT_LENGTH
) -> DataFrame:
    """Mark the last ``horizon`` points of each long enough series as ``test``."""
    newest = _window().orderBy(F.desc("timestamp"))
    ranked = long_enough(long, context + horizon).withColumn("_back", F.row_number().over(newest))
    label = F.when(F.col("_back") <= horizon, "test").otherwise("train")
    return ranked.withColumn("split", label).drop("_back")


def series_arrays(long: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """One row per series: ids, text, and its points in time order.

    Ids and text follow from the item, so grouping by them too changes nothing.
    With ``products`` the text is joined from there, to series and not to days.
    """
    keys = ["item_id", *IDS, *([] if products is not None else TEXT)]
    point = F.struct("timestamp", F.col("target_value").cast("double").alias("y"))
    arrays = long.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("points"))
    if products is None:
        return arrays
    text = products.select(
        F.col("ProductID").alias("product_id"),
        F.col("ProductName").alias("product_name"),
        F.col("CategoryName").alias("category_name"),
    )
    return arrays.join(text, "product_id", "left")


def at_least(arrays: DataFrame, points: int = CONTEXT_LENGTH + PREDICTION_LENGTH) -> DataFrame:
    """Series with at least that many points."""
    return arrays.where(F.size("points") >= points)


def _dynamic(days: Column) -> Column:
    return F.array(F.transform(days, weekday_share), F.transform(days, month_share))


def _cat() -> Column:
    return F.array(*[F.col(f"{feature}_cat") for feature in FEATURES])


def series_instances(
    arrays: DataFrame,
    codes: DataFrame,
    horizon: int = PREDICTION_LENGTH,
    context: int = CONTEXT_LENGTH,
) -> DataFrame:
    """Training and test instances of the long enough series, told apart by ``part``.

    A test instance withholds the last ``horizon`` points. Both are made from the
    same row. ``codes`` should come from the long enough series only.
    """
    kept = at_least(arrays, context + horizon)
    points = F.col("points")
    parts = F.array(
        F.struct(F.lit("train").alias("part"), points.alias("points")),
        F.struct(F.lit("test").alias("part"), F.slice(points, 1, F.size(points) - horizon).alias("points")),
    )
    encoded = encode(kept, codes)
    rows = encoded.select(*[c for c in encoded.columns if c != "points"], F.inline(parts))
    days = F.col("points.timestamp")
    return rows.select(
        "part",
        F.date_format(days[0], "yyyy-MM-dd").alias("start"),
        F.col("points.y").alias("target"),
        _cat().alias("cat"),
        _dynamic(days).alias("dynamic_feat"),
        "item_id",
        F.struct("product_id", *TEXT, "customer_id", "facility_id").alias("product_info"),
    )


def inference_instances(
    arrays: DataFrame,
    codes: DataFrame,
    horizon: int = PREDICTION_LENGTH,
    context: int = CONTEXT_LENGTH,
) -> DataFrame:
    """Last ``context`` points of each series plus calendar features of the days to come."""
    recent = at_least(arrays, context).withColumn("points", F.slice("points", -context, context))
    days = F.col("points.timestamp")
    coming = following_days(F.date_add(F.element_at(days, -1), 1), horizon)
    return encode(recent, codes).select(
        F.date_format(days[0], "yyyy-MM-dd").alias("start"),
        F.col("points.y").alias("target"),
        _cat().alias("cat"),
        _dynamic(F.concat(days, coming)).alias("dynamic_feat"),
        "item_id",
    )


def extend_instances(instances: DataFrame, horizon: int = PREDICTION_LENGTH) -> DataFrame:
    """Lengthen the features of stored instances by ``horizon`` days.

    The first feature is the weekday, the second the month; any further one
    repeats its last value. Days are counted from the start, a day per point.
    """
    start = F.to_date("start")
    days = following_days(F.date_add(start, F.size("target")), horizon)
    coming = _dynamic(days)

    def lengthen(feature: Column, index: Column) -> Column:
        repeated = F.array_repeat(F.element_at(feature, -1), horizon)
        return F.concat(feature, F.when(index < 2, F.get(coming, index)).otherwise(repeated))

    return instances.withColumn("dynamic_feat", F.transform("dynamic_feat", lengthen))


def request_payload(instances: DataFrame) -> DataFrame:
    """Scoring request of each instance as JSON."""
    # Request settings.
    configuration = F.struct(
        F.lit(100).alias("num_samples"),
        F.array(F.lit("quantiles")).alias("output_types"),
        F.array(F.lit("0.1"), F.lit("0.5"), F.lit("0.9")).alias("quantiles"),
    )
    instance = F.struct("start", "target", "cat", "dynamic_feat")
    body = F.struct(F.array(instance).alias("instances"), configuration.alias("configuration"))
    return instances.select("item_id", F.to_json(body).alias("payload"))


def product_mapping(arrays: DataFrame) -> DataFrame:
    """Product of each series, from the one row it has: no days are read or compared."""
    return arrays.select("item_id", "product_id", *TEXT)


def product_info(long: DataFrame) -> DataFrame:
    """Product of each item, one row per item."""
    return long.select("item_id", "product_id", *TEXT).distinct()


def with_product_info(results: DataFrame, info: DataFrame) -> DataFrame:
    """Results with their product; placeholders for items that are not known."""
    unknown = F.lit("Unknown")
    return results.join(info, "item_id", "left").withColumns(
        {
            "product_id": F.coalesce(F.col("product_id").cast("string"), unknown),
            "product_name": F.coalesce("product_name", F.concat(F.lit("Product "), F.col("item_id"))),
            "category_name": F.coalesce("category_name", unknown),
        }
    )
