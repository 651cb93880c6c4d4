import datetime as dt
import math

from pyspark.sql import functions as F

from orderlens.functions.calendar import holiday_name
from orderlens.functions.parsing import json_from_text, parse_order_date
from orderlens.operators.calendar import holiday_calendar, holiday_flags, with_temporal_features
from orderlens.sources.conform import conform


def _days(spark, first, last):
    start, end = F.lit(dt.date(first, 1, 1)), F.lit(dt.date(last, 12, 31))
    return spark.range(1).select(F.explode(F.sequence(start, end)).alias("CreateDate"))


def test_known_values(order_frame):
    rows = with_temporal_features(conform(order_frame)).orderBy("OrderID").collect()
    by_order = {r["OrderID"]: r for r in rows}
    order = ["9149870", "9148894", "9635115", "9626004", "9854860", "9149871", "9148895"]
    seen = [by_order[o] for o in order]
    assert [r["OrderDayOfWeek"] for r in seen] == [0, 0, 0, 1, 2, 1, 2]
    assert [r["OrderMonth"] for r in seen] == [7, 7, 10, 10, 12, 7, 7]
    assert [r["OrderDay"] for r in seen] == [8, 8, 21, 15, 4, 9, 10]
    assert [r["OrderQuarter"] for r in seen] == [3, 3, 4, 4, 4, 3, 3]
    assert all(r["IsWeekend"] == 0 for r in seen)


def test_circles_close(spark):
    frame = with_temporal_features(_days(spark, 2023, 2024))
    for name in ["DayOfWeek", "DayOfMonth", "MonthOfYear"]:
        square = F.pow(f"{name}_sin", F.lit(2)) + F.pow(f"{name}_cos", F.lit(2))
        low, high = frame.agg(F.min(square), F.max(square)).first()
        assert math.isclose(low, 1, abs_tol=1e-12) and math.isclose(high, 1, abs_tol=1e-12)


def test_holidays_of_2024(spark):
    found = {r["Date"]: r["HolidayName"] for r in holiday_calendar(_days(spark, 2024, 2024)).collect()}
    assert found == {
        dt.date(2024, 1, 1): "New Year's Day",
        dt.date(2024, 1, 15): "Martin Luther King Jr. Day",
        dt.date(2024, 2, 19): "Presidents' Day",
        dt.date(2024, 5, 27): "Memorial Day",
        dt.date(2024, 6, 19): "Juneteenth",
        dt.date(2024, 7, 4): "Independence Day",
        dt.date(2024, 9, 2): "Labor Day",
        dt.date(2024, 10, 14): "Columbus Day",
        dt.date(2024, 11, 11): "Veterans Day",
        dt.date(2024, 11, 28): "Thanksgiving Day",
        dt.date(2024, 12, 25): "Christmas Day",
    }


def test_both_holiday_forms_agree(spark):
    days = _days(spark, 1990, 2040)
    named = days.select(F.col("CreateDate").alias("Date"), holiday_name(F.col("CreateDate")).alias("n"))
    left = {tuple(r) for r in named.where("n <> ''").collect()}
    right = {(r["Date"], r["HolidayName"]) for r in holiday_calendar(days).collect()}
    assert left == right and len(left) == 51 * 11
    assert holiday_flags(days, holiday_calendar(days)).agg(F.sum("IsHoliday")).first()[0] == 51 * 11


def test_date_layouts(spark):
    cases = {
        "2024-07-09": dt.date(2024, 7, 9),
        "2024-07-09 13:45:10": dt.date(2024, 7, 9),
        "2024-07-09T13:45:10": dt.date(2024, 7, 9),
        "07/09/2024": dt.date(2024, 7, 9),
        " 7/9/24 ": dt.date(2024, 7, 9),
        "2024/07/09": dt.date(2024, 7, 9),
        "25/12/2024": dt.date(2024, 12, 25),
        "07/08/2024 10:30": dt.date(2024, 7, 8),
        "7/8/2024 10:30:00": dt.date(2024, 7, 8),
        "25/12/2024 9:05": dt.date(2024, 12, 25),
        "1/2/99 23:59": dt.date(1999, 1, 2),
        "2024/07/08 10:30": dt.date(2024, 7, 8),
        "20240708": dt.date(2024, 7, 8),
        "20241345": None,
        "2024-07-08T10:30": dt.date(2024, 7, 8),
        "2024-07-08T10:30:00.123": dt.date(2024, 7, 8),
        "2024-07-08T10:30:00.5Z": dt.date(2024, 7, 8),
        "2024-07-08 10:30:00 soon": None,
        "2024-07": None,
        "25/12/24": dt.date(2024, 12, 25),
        "1/2/68": dt.date(2068, 1, 2),
        "1/2/69": dt.date(1969, 1, 2),
        "1/2/99": dt.date(1999, 1, 2),
        "invalid-date": None,
        "2024-13-45": None,
        "": None,
        None: None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "raw string")
    found = frame.select("raw", F.to_date(parse_order_date(F.col("raw"))).alias("d")).collect()
    assert {r["raw"]: r["d"] for r in found} == cases


def test_json_from_text(spark):
    texts = ['say {"a": {"b": 1}} ok', "none", "{broken", 'x {"a": \n{"b": 2}} } y', None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = frame.select(json_from_text(F.col("t"), "a struct<b:int>").alias("j")).collect()
    assert [r["j"]["a"]["b"] if r["j"] else None for r in found] == [1, None, None, None, None]


def test_more_date_layouts(spark):
    texts = {
        "8-Jul-24": (2024, 7, 8), "08-JULY-2024": (2024, 7, 8), "8 jul 1999": (1999, 7, 8), "8-Jul-99": (1999, 7, 8),
        "Jul 8, 2024": (2024, 7, 8), "September 30 2024": (2024, 9, 30), "07-08-2024": (2024, 7, 8), "25-12-2024": (2024, 12, 25),
        "07/08/2024 2:30 PM": (2024, 7, 8, 14, 30), "07/08/2024 12:05:09am": (2024, 7, 8, 0, 5, 9), "13-13-2024": None, "Foo 8, 2024": None, "8-Jul": None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_order_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in rows.collect()} == {t: v and dt.datetime(*v) for t, v in texts.items()}
