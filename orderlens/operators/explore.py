"""Exploratory aggregates over order lines and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def orders_by_day(lines: DataFrame, ts: str = "CreateDate") -> DataFrame:
    return lines.groupBy(F.to_date(ts).alias("Date")).agg(F.count(F.lit(1)).alias("OrderCount"))


def orders_by_weekday(lines: DataFrame, ts: str = "CreateDate") -> DataFrame:
    """Line count per weekday, Monday = 0, with its name.

    The name comes from a group's own day, after the rows are counted.
    """
    return lines.groupBy(F.weekday(ts).alias("DayOfWeek")).agg(
        F.count(F.lit(1)).alias("OrderCount"),
        F.date_format(F.min(ts), "EEEE").alias("DayName"),
    )


def top_by_count(lines: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most frequent keys; ties go to the lesser key."""
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("OrderCount"))
    return counts.orderBy(F.desc("OrderCount"), *keys).limit(k)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def dataset_overview(lines: DataFrame, ts: str = "CreateDate") -> DataFrame:
    """Row count, date range, null counts and distinct ids of a table, in one row.

    One scan and one reduction: a row gives one cell (column, value) per id column and one cell with its day
    and the places of its nulls. Equal cells are counted before the shuffle, so what is shuffled
    are the distinct ids, whatever their columns, and the few distinct pairs of day and null places.
    """
    ids = [c for c in ["CustomerID", "FacilityID", "ProductID", "OrderID", "VendorID"] if c in lines.columns]

    def cell(part: int, value: Column, day: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), value.cast("string").alias("value"), day.alias("day"))

    no_day, row = F.lit(None).cast("date"), len(ids)
    blanks = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in lines.columns])
    cells = F.array(*[cell(i, F.col(c), no_day) for i, c in enumerate(ids)], cell(row, blanks, F.to_date(ts)))
    counts = lines.select(F.inline(cells)).groupBy("part", "value", "day").agg(F.count(F.lit(1)).alias("n"))
    is_row = F.col("part") == row
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    start, end = F.min("day"), F.max("day")
    return counts.agg(
        total(is_row).alias("total_records"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.datediff(end, start).alias("span_days"),
        *[
            total(is_row & (F.substring("value", i, 1) == "1")).alias(f"nulls_{c.lower()}")
            for i, c in enumerate(lines.columns, 1)
        ],
        *[
            F.count_if((F.col("part") == i) & F.col("value").isNotNull()).alias(f"unique_{c.lower()}")
            for i, c in enumerate(ids)
        ],
    ).withColumn("total_columns", F.lit(len(lines.columns)))


def series_lengths(daily: DataFrame, series: list[str]) -> DataFrame:
    return daily.groupBy(*series).agg(F.count(F.lit(1)).alias("length"))


def series_length_stats(lengths: DataFrame) -> DataFrame:
    """Number of series and the centre and range of their lengths.

    Lengths are counted first; the exact median then keeps one entry per distinct
    length, of which there are no more than calendar days.
    """
    return lengths.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.avg("length").alias("avg_length"),
        F.median("length").alias("median_length"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
    )


def series_length_histogram(lengths: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins over the range of lengths, empty bins included.

    Lengths are reduced to (length, number of series), no more rows than there are
    calendar days; the bins are then filled within one row. A single common length
    gets bins half a day around it.
    """
    counted = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    low, high = F.min("length").cast("double"), F.max("length").cast("double")
    single = low == high
    facts = counted.agg(
        F.when(single, low - 0.5).otherwise(low).alias("low"),
        F.when(single, high + 0.5).otherwise(high).alias("high"),
        F.collect_list(F.struct("length", "n")).alias("counts"),
    ).where("low is not null")
    width = F.col("high") - F.col("low")

    def bin_of(length):
        return F.least(F.floor((length - F.col("low")) * bins / width), F.lit(bins - 1))

    def fill(bin_no):
        inside = F.filter("counts", lambda c: bin_of(c["length"]) == bin_no)
        return F.struct(
            bin_no.alias("bin"),
            (F.col("low") + bin_no * width / bins).alias("bin_start"),
            (F.col("low") + (bin_no + 1) * width / bins).alias("bin_end"),
            F.aggregate(inside, F.lit(0).cast("bigint"), lambda n, c: n + c["n"]).alias("n_series"),
        )

    return facts.select(F.inline(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), fill)))
