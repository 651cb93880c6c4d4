"""The three jobs: order files to snapshots, lookups to recommendations, history to accuracy."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import calendar, codes, demand, explore, forecast, lookups, quality, recommend, series
from orderlens.schema import SERIES
from orderlens.sources import files
from orderlens.sources.stages import stored


Model = Callable[[pd.DataFrame], pd.DataFrame]


# --- order lines to feature, lookup and forecast tables -------------------------------


def build_outputs(lines: DataFrame, root: str, run_ts: str) -> list[str]:
    """Write every table derived from conformed order lines as the snapshot ``run_ts``.

    The run is committed when all its tables are there; until then readers of the newest run
    see the one before. Repeating a run withdraws its commit first.

    The lines and the daily demand are written first and read back: later tables
    then scan only the columns they need, no text is parsed twice, and a lost
    executor costs a re-read and not a rebuild. Without lines nothing is written,
    without any usable line only these two are; the written names are returned.
    """
    spark = lines.sparkSession
    written: list[str] = []
    # the one look ahead; a derived table is empty only if the activity is
    if lines.isEmpty():
        return written
    files.withdraw_run(spark, root, run_ts)

    def keep(name: str, df: DataFrame) -> None:
        files.write_snapshot(df, f"{root}/{name}", run_ts)
        written.append(name)

    def reread(name: str, like: DataFrame) -> DataFrame:
        runs = files.read_snapshots(spark, f"{root}/{name}", like.schema)
        return runs.where(F.col("run_ts") == run_ts).drop("run_ts")

    featured = calendar.with_temporal_features(lines)
    keep("processed/order_lines", featured)
    featured = reread("processed/order_lines", featured)

    activity = demand.daily_activity(featured)
    keep("processed/daily_activity", activity)
    activity = reread("processed/daily_activity", activity)
    if activity.isEmpty():
        files.commit_run(spark, root, run_ts, written)
        return written
    daily = activity.select(*SERIES, "Date", "Quantity")

    products = demand.product_table(featured)
    keep("processed/product_features", demand.demand_patterns(daily, products))
    keep("lookup/product_lookup", lookups.product_lookup(featured))
    lookup = reread("lookup/product_lookup", lookups.product_lookup(featured))
    relations = lookups.relationships_of(activity)
    keep("lookup/customer_product_lookup", lookups.customer_product_lookup(relations, lookup))
    relations = reread("lookup/customer_product_lookup", lookups.customer_product_lookup(relations, lookup))
    files.write_lookup_items(lookups.lookup_items(lookup, relations), f"{root}/lookup/items", run_ts)
    written.append("lookup/items")
    keep("forecast_format/product_forecast_data", demand.by_series(demand.product_forecast_long(daily, products)))
    totals = demand.customer_daily(featured)
    keep("forecast_format/customer_forecast_data", demand.by_series(demand.customer_forecast_long(totals)))
    files.commit_run(spark, root, run_ts, written)
    return written


def validate_lines(lines: DataFrame, as_of: dt.date, path: str) -> DataFrame:
    """Write the whole validation report of some order lines below ``path``; its summary back.

    The lines are stored once and each part reads the columns it needs. Parts: checks, statistics, distributions
    (numbers), categories and their most frequent values, rules, summary.
    """
    lines = stored(lines, "validated-lines")
    rules = stored(quality.business_rules(lines), "rules")
    checks = stored(quality.validation_checks(lines, as_of), "checks")
    parts = {
        "checks": checks,
        "statistics": explore.dataset_overview(lines),
        "distributions": quality.numeric_profile(lines),
        "categories": quality.categorical_profile(lines),
        "category_values": quality.categorical_top(lines),
        "rules": rules,
        "summary": quality.report_summary(quality.quality_score(lines), checks, rules),
    }
    for name, part in parts.items():
        files.write_report(part, f"{path}/{name}")
    return lines.sparkSession.read.json(f"{path}/summary")


# --- history to forecasts and recommendations ------------------------------------------


def forecast_pairs(
    activity: DataFrame,
    products: DataFrame,
    as_of: Column,
    relations: DataFrame | None = None,
    model: Model | None = None,
) -> DataFrame:
    """Forecasts of all products of every customer and facility, in one job.

    ``activity`` is the daily activity table, ``products`` the product lookup. With a
    stored customer-product lookup as ``relations`` only its series are forecast. A ``model`` takes
    the place of the built-in one; a series it fails on gets the fallback forecast, flagged by
    ``mock_data``, with the message in ``error``.
    """
    if relations is not None:
        activity = activity.join(relations.select(*SERIES), SERIES, "left_semi")
    if model is not None:
        history = activity.select(
            *SERIES,
            demand.item_id(*SERIES).alias("item_id"),
            F.col("Date").alias("ds"),
            F.col("Quantity").cast("double").alias("y"),
        )
        outcomes = forecast.model_outcomes(history, model, SERIES)
        # both sides are grouped by series: one exchange each, no third
        known = outcomes.join(lookups.relationships_of(activity), SERIES)
        return forecast.with_fallback(known, as_of).join(products, "ProductID", "left")
    chosen = demand.series_histories(activity)
    profiled = forecast.profile_histories(chosen, SERIES)
    return forecast.forecast_days(profiled.join(products, "ProductID", "left"), as_of)


def recommend_pairs(
    activity: DataFrame,
    products: DataFrame,
    as_of: Column,
    relations: DataFrame | None = None,
    model: Model | None = None,
) -> DataFrame:
    """Nested predictions and recommendations of every customer and facility."""
    rows = forecast_pairs(activity, products, as_of, relations, model)
    return recommend.prediction_bundle(recommend.product_outlook(rows, as_of), as_of)


# --- history to training sets and accuracy --------------------------------------------


def training_sets(arrays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test instances, and the category codes they use.

    ``arrays`` holds one row per series and is read for the codes and for the
    instances: take it from :func:`stored_series` or a table.
    """
    mapping = codes.category_codes(series.at_least(arrays))
    return series.series_instances(arrays, mapping), mapping


def store_training_sets(arrays: DataFrame, root: str, run_ts: str) -> None:
    """Write instances, category codes and the product mapping of a training run, and commit it.

    Codes go on from those of the newest committed run, so values keep their numbers over runs. Instances
    are JSON lines in a folder per part. ``arrays`` as for :func:`training_sets`.
    """
    spark = arrays.sparkSession
    before = files.committed_run(spark, root, "codes")
    files.withdraw_run(spark, root, run_ts)
    known = spark.createDataFrame([], codes.CODE_TABLE)
    if before is not None:
        known, _ = codes.load_codes(spark, f"{root}/codes/{before}")
    mapping = codes.extend_codes(known, series.at_least(arrays))
    if before == run_ts:  # read before it is replaced
        mapping = stored(mapping, "codes")
    codes.save_codes(mapping, f"{root}/codes/{run_ts}")
    mapping, _ = codes.load_codes(spark, f"{root}/codes/{run_ts}")
    files.write_instances(series.series_instances(arrays, mapping), f"{root}/instances/{run_ts}")
    files.write_snapshot(series.product_mapping(arrays), f"{root}/product_mapping", run_ts)
    files.commit_run(spark, root, run_ts, ["codes", "instances", "product_mapping"])


def read_training_run(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Training and test instances, codes and product mapping of the newest committed training run."""
    run = files.committed_run(spark, root, "instances")
    if run is None:
        raise FileNotFoundError(f"no committed training run below {root}")
    mapping = spark.read.parquet(f"{root}/product_mapping").where(F.col("run_ts") == run)
    return {
        "train": files.read_instances(spark, f"{root}/instances/{run}/part=train"),
        "test": files.read_instances(spark, f"{root}/instances/{run}/part=test"),
        "codes": codes.load_codes(spark, f"{root}/codes/{run}")[0],
        "product_mapping": mapping.drop("run_ts"),
    }


def stored_series(long: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """One row per series, stored, so that the history is grouped once."""
    return stored(series.series_arrays(long, products), "series")


def evaluate(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accuracy of each series and overall, on the last two weeks of each."""
    scored = forecast.evaluate_holdout(series.holdout_split(long))
    return forecast.forecast_accuracy(scored), forecast.forecast_accuracy_total(scored)


def latest_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Customer-product table of the newest committed run below ``root``."""
    return files.read_latest_lookups(spark, root)[1]
