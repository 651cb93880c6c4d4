"""Calendar columns: date parts, cyclical encodings, US federal holidays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Federal holidays on a set day, as (month, day, name).
FIXED_DAY_HOLIDAYS = [
    (1, 1, "New Year's Day"),
    (6, 19, "Juneteenth"),
    (7, 4, "Independence Day"),
    (11, 11, "Veterans Day"),
    (12, 25, "Christmas Day"),
]

# Federal holidays on the n-th weekday of a month, as
# (month, weekday with Monday = 0, n, name); n = -1 is the last one.
NTH_WEEKDAY_HOLIDAYS = [
    (1, 0, 3, "Martin Luther King Jr. Day"),
    (2, 0, 3, "Presidents' Day"),
    (5, 0, -1, "Memorial Day"),
    (9, 0, 1, "Labor Day"),
    (10, 0, 2, "Columbus Day"),
    (11, 3, 4, "Thanksgiving Day"),
]


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value that wraps after ``period`` steps."""
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def holiday_name(day: Column) -> Column:
    """Name of the federal holiday on ``day``, or an empty string.

    A conditional over month, day and weekday: the check needs no join and no
    list of the years in the data, so it stays inside the scan's code.
    """
    month, dom, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)
    branches = [((month == m) & (dom == d), name) for m, d, name in FIXED_DAY_HOLIDAYS]
    for m, wanted, n, name in NTH_WEEKDAY_HOLIDAYS:
        if n > 0:
            week = dom.between(7 * n - 6, 7 * n)
        else:
            week = dom > F.dayofmonth(F.last_day(day)) - 7
        branches.append(((month == m) & (weekday == wanted) & week, name))
    expr = None
    for condition, name in branches:
        expr = F.when(condition, name) if expr is None else expr.when(condition, name)
    return expr.otherwise("")


def holidays_of_year(year: Column) -> Column:
    """All holidays of a year as an array of (date, name), built date-first."""
    entries = [
        F.struct(F.make_date(year, F.lit(m), F.lit(d)).alias("date"), F.lit(name).alias("name"))
        for m, d, name in FIXED_DAY_HOLIDAYS
    ]
    names = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    for m, wanted, n, name in NTH_WEEKDAY_HOLIDAYS:
        first = F.make_date(year, F.lit(m), F.lit(1))
        if n > 0:
            # next_day is strictly later, so start the search a day early
            day = F.date_add(F.next_day(F.date_sub(first, 1), names[wanted]), 7 * (n - 1))
        else:
            day = F.next_day(F.date_sub(F.last_day(first), 7), names[wanted])
        entries.append(F.struct(day.alias("date"), F.lit(name).alias("name")))
    return F.array(*entries)


def temporal_columns(ts: Column) -> dict[str, Column]:
    """The sixteen calendar columns of an order timestamp."""
    weekday, day, month = F.weekday(ts), F.dayofmonth(ts), F.month(ts)
    dow_sin, dow_cos = cyclic(weekday, 7)
    dom_sin, dom_cos = cyclic(day - 1, 31)
    moy_sin, moy_cos = cyclic(month - 1, 12)
    holiday = holiday_name(F.to_date(ts))
    return {
        "OrderYear": F.year(ts),
        "OrderMonth": month,
        "OrderDay": day,
        "OrderDayOfWeek": weekday,
        "OrderHour": F.hour(ts),
        "DayOfWeek_sin": dow_sin,
        "DayOfWeek_cos": dow_cos,
        "DayOfMonth_sin": dom_sin,
        "DayOfMonth_cos": dom_cos,
        "MonthOfYear_sin": moy_sin,
        "MonthOfYear_cos": moy_cos,
        "OrderQuarter": F.quarter(ts),
        "IsWeekend": F.when(weekday >= 5, 1).otherwise(0),
        "Date": F.to_date(ts),
        "IsHoliday": F.when(holiday != "", 1).otherwise(0),
        "HolidayName": holiday,
    }


def weekday_share(day: Column) -> Column:
    """Weekday scaled to [0, 1]."""
    return F.weekday(day) / F.lit(6.0)


def month_share(day: Column) -> Column:
    """Month scaled to [0, 1]."""
    return (F.month(day) - 1) / F.lit(11.0)


def following_days(start: Column, n: int) -> Column:
    """Array of ``n`` consecutive dates from ``start`` on."""
    return F.sequence(start, F.date_add(start, n - 1))
