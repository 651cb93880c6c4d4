"""Calendar features of order lines and the holiday table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.calendar import following_days, holidays_of_year, temporal_columns


def with_temporal_features(lines: DataFrame, ts: str = "CreateDate") -> DataFrame:
    return lines.withColumns(temporal_columns(F.col(ts)))


def holiday_calendar(lines: DataFrame, ts: str = "CreateDate") -> DataFrame:
    """Holidays of every year that occurs in the data: eleven rows a year."""
    years = lines.select(F.year(ts).alias("year")).where("year is not null").distinct()
    return years.select("year", F.inline(holidays_of_year(F.col("year")))).select(
        "year", F.col("date").alias("Date"), F.col("name").alias("HolidayName")
    )


def holiday_flags(lines: DataFrame, holidays: DataFrame, ts: str = "CreateDate") -> DataFrame:
    """Flag lines against a holiday table, such as one with extra local days.

    The holiday table is reduced to one row per calendar day, so its size is bound
    by the calendar and not by the data: it is broadcast, and the lines stay put.
    """
    day = F.to_date(ts)
    named = holidays.groupBy("Date").agg(F.min("HolidayName").alias("HolidayName"))
    flagged = lines.withColumn("Date", day).join(F.broadcast(named), "Date", "left")
    return flagged.withColumns(
        {
            "IsHoliday": F.when(F.col("HolidayName").isNotNull(), 1).otherwise(0),
            "HolidayName": F.coalesce("HolidayName", F.lit("")),
        }
    )


def forecast_calendar(items: DataFrame, start: Column, days: int) -> DataFrame:
    """One row per item and coming day."""
    return items.withColumn("ds", F.explode(following_days(start, days)))
