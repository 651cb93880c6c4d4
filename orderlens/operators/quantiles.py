"""Exact quantiles of whole columns, without gathering a column anywhere."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
# Room for one place per sign and power of two of a double, zero and the infinities.
POWERS = 8192


def _value(column: str):
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], buckets: int = BUCKETS
) -> DataFrame:
    """Linearly interpolated quantiles as rows (column, probability, value)."""
    found = find_quantiles(df, columns, probabilities, buckets)
    rows = [(c, p, value) for (c, p), value in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, probability double, value double")


def find_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], buckets: int = BUCKETS
) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantile of each (column, probability); None without values.

    Runs jobs when called. Ranks are narrowed down: the first pass counts the values
    by sign and power of two, every later one counts the values of the interval known
    to hold a rank in equal buckets and moves to the rank's bucket, until that is one
    value. A pass ships at most ``buckets`` counts per rank and task whatever the
    skew. Within a power of two there are 2^52 values at most, so six passes settle
    any column, infinities and the smallest numbers included. ``df`` is read once per
    pass: store it first if it is costly to make.
    """
    frame = df.select(*[_value(c).alias(c) for c in columns])
    sizes = frame.agg(
        *[F.struct(F.count(f"`{c}`"), F.min(f"`{c}`"), F.max(f"`{c}`")).alias(c) for c in columns]
    ).first()
    facts = {c: tuple(sizes[c]) for c in columns if sizes[c][0]}
    ranks = {(c, rank) for c in facts for p in probabilities for rank in _ranks(facts[c][0], p)}
    placed = _values_at_ranks(frame, ranks, facts, buckets)
    found: dict[tuple[str, float], float | None] = {}
    for c in columns:
        for p in probabilities:
            found[c, float(p)] = None
            if c in facts:
                low, high = _ranks(facts[c][0], p)
                a, b = placed[c, low], placed[c, high]
                share = p * (facts[c][0] - 1) - low
                if a == b or share == 0:
                    found[c, float(p)] = a
                elif math.isinf(a) or math.isinf(b):  # a difference would not be a number
                    found[c, float(p)] = a * (1 - share) + b * share
                else:
                    found[c, float(p)] = a + (b - a) * share
    return found


def _ranks(n: int, p: float) -> tuple[int, int]:
    place = p * (n - 1)
    return math.floor(place), math.ceil(place)


def _power(value: Column) -> Column:
    """Place of a value by sign and power of two; never falls as the value rises."""
    size = F.abs(value)
    step = (
        F.when(size == 0, F.lit(0))
        .when(size == float("inf"), F.lit(2300))
        .otherwise(F.floor(F.log2(size)) + 1100)
    )
    return F.when(value < 0, -step).otherwise(step) + POWERS // 2


def _bucket(value: Column, low: float, high: float, buckets: int) -> Column:
    """Place of a value among equal buckets; the ends fall into different ones."""
    share = (value - low) / (F.lit(high) - low)
    return F.least(F.floor(share * buckets), F.lit(buckets - 1))


def _values_at_ranks(frame: DataFrame, ranks, facts, buckets: int) -> dict[tuple[str, int], float]:
    """Value at each (column, zero-based rank). The driver sees one row per rank and pass."""
    # what is known of a rank: interval, and how many values lie below it
    open_ranks = {key: (facts[key[0]][1], facts[key[0]][2], 0) for key in ranks}
    done: dict[tuple[str, int], float] = {}
    passes = 0
    while True:
        for key, (low, high, _) in list(open_ranks.items()):
            if low == high:
                done[key] = low
                del open_ranks[key]
        if not open_ranks:
            return done
        intervals = sorted({(c, low, high) for (c, _), (low, high, _) in open_ranks.items()})
        number = {interval: i for i, interval in enumerate(intervals)}
        width = buckets if passes else POWERS
        # the intervals of a column are disjoint, so a value falls into one at most
        places: dict[str, Column] = {}
        for (c, low, high), i in number.items():
            value = F.col(f"`{c}`")
            bucket = _bucket(value, low, high, buckets) if passes else _power(value)
            branch = (value.between(low, high), bucket + i * width)
            places[c] = places[c].when(*branch) if c in places else F.when(*branch)
        passes += 1
        hits = [F.struct(place.alias("place"), F.col(f"`{c}`").alias("value")) for c, place in places.items()]
        counts = (
            frame.select(F.inline(F.array(*hits)))
            .where("place is not null")
            .groupBy("place")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min("value").alias("low"),
                F.max("value").alias("high"),
            )
            .withColumns(
                {
                    "interval": F.floor(F.col("place") / width).cast("int"),
                    "bucket": F.col("place") % width,
                }
            )
        )
        below = F.coalesce(
            F.sum("n").over(
                Window.partitionBy("interval").orderBy("bucket").rowsBetween(
                    Window.unboundedPreceding, -1
                )
            ),
            F.lit(0),
        )
        rows = [
            (number[c, low, high], c, rank, under) for (c, rank), (low, high, under) in open_ranks.items()
        ]
        wanted = frame.sparkSession.createDataFrame(
            rows, "interval int, column string, rank bigint, under bigint"
        )
        first = F.col("under") + F.col("below")
        chosen = (
            counts.withColumn("below", below)
            .join(wanted, "interval")
            .where(F.col("rank").between(first, first + F.col("n") - 1))
            .select("column", "rank", "low", "high", first.alias("under"))
            .collect()
        )
        for row in chosen:
            open_ranks[row["column"], row["rank"]] = (row["low"], row["high"], row["under"])
