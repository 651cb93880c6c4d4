"""Quantile forecasts, their statistics, and their accuracy on a hold-out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.calendar import following_days
from orderlens.functions.stats import (
    clamp,
    coefficient_of_variation,
    mae,
    mape,
    mase,
    rmse,
    wape,
    weighted_quantile_loss,
)
from orderlens.schema import FORECAST_ROW, PREDICTION_LENGTH

# Forecast quantiles by column.
QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


# --- rule-based forecast from order counts --------------------------------------------


def baseline_forecast(
    lookup: DataFrame, as_of: Column, divisor: int = 10, days: int = 7
) -> DataFrame:
    """A flat forecast of the coming days for every product of each pair."""
    flat = _flat_quantiles(divisor)
    return (
        lookup.withColumns({**flat, "mean": flat["p50"], "mock_data": F.lit(divisor == 1)})
        .withColumn("ds", F.explode(following_days(as_of, days)))
    )


def _flat_quantiles(divisor: int) -> dict[str, Column]:
    base = F.greatest(F.lit(1), F.floor(F.col("OrderCount") / divisor)).cast("double")
    return {"p10": F.greatest(F.lit(0.0), base * 0.5), "p50": base, "p90": base * 2}


def fallback_forecast(lookup: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The variant used when scoring a product fails: the whole order count, flagged."""
    return baseline_forecast(lookup, as_of, divisor=1, days=days)


# --- the built-in model: quantiles per weekday ----------------------------------------


def _profile(rows: DataFrame, keys: list[str], fit: Column, *extra: Column) -> DataFrame:
    """Quantiles per weekday of each key's (timestamp, y) rows that ``fit`` holds for.

    All weekdays and the whole series come out of one aggregation, which takes
    ``extra`` aggregates along; a weekday without history gets the quantiles of the
    whole series. A key has at most one row per calendar day.
    """
    wanted = F.array(*[F.lit(q) for q in QUANTILES.values()])
    y = F.when(fit, F.col("y").cast("double"))
    days = {
        f"_d{d}": F.percentile(F.when(F.weekday("timestamp") == d, y), wanted) for d in range(7)
    }
    profiled = rows.groupBy(*keys).agg(
        *extra, F.percentile(y, wanted).alias("_whole"), *[q.alias(name) for name, q in days.items()]
    )
    by_day = F.array(*[F.coalesce(name, "_whole") for name in days])
    return profiled.withColumn("weekdays", by_day).drop("_whole", *days)


def _from_profile(day: Column) -> dict[str, Column]:
    at = F.get("weekdays", F.weekday(day))
    columns = {name: at[i] for i, name in enumerate(QUANTILES)}
    return {**columns, "mean": columns["p50"]}


def profile_histories(histories: DataFrame, keys: list[str]) -> DataFrame:
    """Weekday quantiles of series with their ``points``; all other columns are kept.

    Unpacking the points keeps rows where they are, so the aggregation by key
    needs no shuffle after one by the key or a part of it.
    """
    rest = [name for name in histories.columns if name not in (*keys, "points")]
    rows = histories.select(*keys, *rest, F.inline("points"))
    along = [F.max(name).alias(name) for name in rest]
    return _profile(rows, keys, F.lit(True), *along)


def forecast_days(profiled: DataFrame, as_of: Column, horizon: int = PREDICTION_LENGTH) -> DataFrame:
    """One row per profiled series and day of the ``horizon`` days from ``as_of`` on."""
    days = profiled.withColumn("ds", F.explode(following_days(as_of, horizon)))
    return days.withColumns(_from_profile(F.col("ds"))).drop("weekdays")


def _points(history: DataFrame) -> DataFrame:
    return history.select("item_id", "timestamp", F.col("target_value").alias("y"))


def seasonal_forecast(
    history: DataFrame, as_of: Column, horizon: int = PREDICTION_LENGTH
) -> DataFrame:
    """Forecast of the ``horizon`` days from ``as_of`` on for every item of a long table."""
    profiled = _profile(_points(history), ["item_id"], F.lit(True))
    return forecast_days(profiled, as_of, horizon)


def evaluate_holdout(split: DataFrame) -> DataFrame:
    """Hold-out rows with the forecast of a model fitted to the training rows only.

    The hold-out rows ride along in the aggregation that fits the model and are
    unpacked behind it: no join, and no shuffle beyond that of the split.
    """
    test = F.when(F.col("split") == "test", F.struct("timestamp", F.col("y").cast("double").alias("y")))
    rows = split.select("item_id", "timestamp", F.col("target_value").alias("y"), "split")
    profiled = _profile(
        rows, ["item_id"], F.col("split") == "train", F.sort_array(F.collect_list(test)).alias("test")
    )
    scored = profiled.select("item_id", "weekdays", F.inline("test"))
    return (
        scored.withColumnRenamed("y", "target_value")
        .withColumns(_from_profile(F.col("timestamp")))
        .drop("weekdays")
    )


# --- other models ---------------------------------------------------------------------


def model_forecast(
    history: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str = FORECAST_ROW
) -> DataFrame:
    """Forecast with a user's model, called once per series.

    The model gets (item_id, ds, y) sorted by day, at most one row per calendar
    day, and returns (item_id, ds, p10, p50, p90).
    """

    def run(series: pd.DataFrame) -> pd.DataFrame:
        return model(series.sort_values("ds", ignore_index=True))

    source = history.select(
        "item_id", F.to_date("timestamp").alias("ds"), F.col("target_value").cast("double").alias("y")
    )
    return source.groupBy("item_id").applyInPandas(run, schema)


def model_outcomes(
    history: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str]
) -> DataFrame:
    """Forecasts of a user's model, and what went wrong where there is none.

    ``history`` holds (keys, item_id, ds, y), at most one row per series and calendar day; the model is
    called once per series, as in :func:`model_forecast`. A series whose model raises, or gives no days, a day
    twice, or a day or quantile that is missing, has one row without a day whose ``error`` says so;
    all others go on.
    """
    columns = ["ds", *QUANTILES]

    def run(group: tuple, series: pd.DataFrame) -> pd.DataFrame:
        ordered = series[["item_id", "ds", "y"]].sort_values("ds", ignore_index=True)
        try:
            made = model(ordered)[columns].reset_index(drop=True)
            if made.empty or made.isna().any(axis=None) or made["ds"].duplicated().any():
                raise ValueError("the model gave no days, a day twice, or a missing value")
            made["ds"] = pd.to_datetime(made["ds"]).dt.date
            made[list(QUANTILES)] = made[list(QUANTILES)].astype("float64")
            made["error"] = None
        except Exception as error:  # whatever a user's model raises must not end the job
            made = pd.DataFrame([[None, None, None, None, f"{type(error).__name__}: {error}"]], columns=[*columns, "error"])
        for name, value in zip(keys, group):
            made[name] = value
        return made[[*keys, *columns, "error"]]

    kinds = [f"`{name}` {history.schema[name].dataType.simpleString()}" for name in keys]
    schema = ", ".join([*kinds, "ds date, p10 double, p50 double, p90 double, error string"])
    return history.groupBy(*keys).applyInPandas(run, schema)


def with_fallback(outcomes: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Outcomes of a model with the flagged fallback forecast where it failed.

    ``outcomes`` carry the series' OrderCount. Failed series are exploded where they lie, so the model
    runs once and nothing is joined for them.
    """
    failed = F.col("error").isNotNull()
    flat = _flat_quantiles(1)
    ds = F.explode(F.when(failed, following_days(as_of, days)).otherwise(F.array("ds")))
    rest = [c for c in outcomes.columns if c not in ("ds", *QUANTILES)]
    quantiles = {name: F.when(failed, flat[name]).otherwise(F.col(name)) for name in QUANTILES}
    rows = outcomes.select(*rest, ds.alias("ds"), *[c.alias(name) for name, c in quantiles.items()])
    return rows.withColumns({"mean": F.col("p50"), "mock_data": F.col("error").isNotNull()})


def quantiles_to_rows(
    scored: DataFrame, as_of: Column, horizon: int = PREDICTION_LENGTH
) -> DataFrame:
    """Quantile arrays to one row per day from ``as_of`` on, at most ``horizon`` days."""
    zipped = F.slice(F.arrays_zip(*QUANTILES), 1, F.least(F.size("p50"), F.lit(horizon)))
    keys = [name for name in scored.columns if name not in QUANTILES]
    rows = scored.select(*keys, F.posexplode(zipped).alias("pos", "q"))
    return rows.select(
        *keys, F.date_add(as_of, F.col("pos")).alias("ds"), "q.*", F.col("q.p50").alias("mean")
    )


def quantile_arrays(forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Dated quantiles back to arrays in day order, a horizon's worth per key."""
    days = F.sort_array(F.collect_list(F.struct("ds", *QUANTILES))).alias("days")
    grouped = forecast.groupBy(*keys).agg(days)
    return grouped.select(*keys, *[F.col(f"days.{name}").alias(name) for name in QUANTILES])


# --- statistics of forecasts ----------------------------------------------------------


def _trend(day: str) -> Column:
    rising = F.max_by("p50", day) > F.min_by("p50", day)
    return F.when(rising, "increasing").otherwise("decreasing")


def forecast_stats(forecast: DataFrame, keys: list[str], day: str = "ds") -> DataFrame:
    """Mean quantiles, trend, spread and confidence of each forecast."""
    mean, width = F.avg("p50"), F.avg(F.col("p90") - F.col("p10"))
    score = F.when(mean > 0, clamp(100 - F.try_divide(width, mean) * 100, 0.0, 100.0))
    return forecast.groupBy(*keys).agg(
        F.avg("p10").alias("p10_avg"),
        mean.alias("p50_avg"),
        F.avg("p90").alias("p90_avg"),
        _trend(day).alias("trend"),
        F.stddev_pop("p50").alias("volatility"),
        F.coalesce(score, F.lit(50.0)).alias("confidence_score"),
    )


def forecast_insight_stats(scored: DataFrame, keys: list[str], day: str = "timestamp") -> DataFrame:
    """Statistics of hold-out forecasts: relative spread, unclamped confidence, range."""
    mean, width = F.avg("p50"), F.avg(F.col("p90") - F.col("p10"))
    confidence = F.when(mean > 0, 100 - F.try_divide(width, mean) * 100).otherwise(0.0)
    return scored.groupBy(*keys).agg(
        _trend(day).alias("trend"),
        coefficient_of_variation(F.stddev_pop("p50"), mean).alias("volatility"),
        confidence.alias("confidence"),
        width.alias("confidence_width"),
        mean.alias("avg_prediction"),
        F.max("p50").alias("max_prediction"),
        F.min("p50").alias("min_prediction"),
    )


def analyst_payload(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast statistics of each pair's products as a JSON column.

    A list per pair is built, so a pair of very many products makes one long row.
    """
    rest = [name for name in stats.columns if name not in keys]
    rows = F.sort_array(F.collect_list(F.struct(*rest)))
    return stats.groupBy(*keys).agg(F.to_json(rows).alias("payload"))


# --- accuracy -------------------------------------------------------------------------


def _with_step(scored: DataFrame) -> DataFrame:
    in_order = Window.partitionBy("item_id").orderBy("timestamp")
    y = F.col("target_value")
    return scored.withColumn("_step", y - F.lag(y).over(in_order))


def _metrics() -> list[Column]:
    y, p, step = F.col("target_value"), F.col("p50"), F.col("_step")
    return [
        F.count(F.lit(1)).alias("n"),
        rmse(y, p).alias("rmse"),
        mape(y, p).alias("mape"),
        mae(y, p).alias("mae"),
        mase(y, p, step).alias("mase"),
    ]


def forecast_accuracy(scored: DataFrame) -> DataFrame:
    """Error measures of each series; the naive error is the hold-out's own."""
    return _with_step(scored).groupBy("item_id").agg(*_metrics())


def forecast_accuracy_total(scored: DataFrame) -> DataFrame:
    """Error measures over all series, steps taken within a series."""
    return _with_step(scored).agg(*_metrics())


def quantile_loss(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Weighted quantile loss of each quantile, and the weighted absolute error."""
    y = F.col("target_value")
    return scored.groupBy(*(keys or [])).agg(
        *[
            weighted_quantile_loss(y, F.col(name), q).alias(f"wql_{name}")
            for name, q in QUANTILES.items()
        ],
        wape(y, F.col("p50")).alias("wape"),
    )


def result_records(scored: DataFrame) -> DataFrame:
    """Metrics with the actual and predicted values of each series, as arrays."""
    row = F.struct("timestamp", F.col("target_value").alias("actual"), "p10", "p50", "p90")
    grouped = _with_step(scored).groupBy("item_id").agg(
        *_metrics(), F.sort_array(F.collect_list(row)).alias("rows")
    )
    return grouped.select(
        "item_id",
        F.struct("rmse", "mape", "mae", "mase").alias("metrics"),
        F.col("rows.actual").alias("actual_values"),
        F.col("rows.p50").alias("predicted_values"),
        F.col("rows.p10").alias("p10_values"),
        F.col("rows.p90").alias("p90_values"),
    )
