"""Consecutive integer codes for category values, and encoding with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.session import ensure_checkpoint_dir

# Encoded features, and how many codes each has when no mapping is stored.
FEATURES = ["customer", "facility", "category"]
DEFAULT_CARDINALITY = [4, 50, 24]
FEATURE_COLUMNS = {
    "customer": "customer_id",
    "facility": "facility_id",
    "category": "category_name",
}
CODE_TABLE = "feature string, value string, code int"


def _distinct_values(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Distinct (feature, value) with sort keys that keep numbers in number order, exactly."""
    entries = []
    for feature, column in columns.items():
        kind, value = df.schema[column].dataType, F.col(column)
        whole = isinstance(kind, T.IntegralType)
        number = isinstance(kind, T.NumericType) and not whole
        entries.append(
            F.struct(
                F.lit(feature).alias("feature"),
                (value if whole else F.lit(None)).cast("bigint").alias("whole"),
                (value if number else F.lit(None)).cast("double").alias("number"),
                value.cast("string").alias("value"),
            )
        )
    return df.select(F.inline(F.array(*entries))).where("value is not null").distinct()


def category_codes(df: DataFrame, columns: Mapping[str, str] = FEATURE_COLUMNS) -> DataFrame:
    """Codes 0..n-1 in value order for each feature, as (feature, value, code).

    The distinct values are range-partitioned and numbered by partition offset plus
    position, whatever their number; the sorted values are checkpointed when this is
    called. Joins with the codes are left to Spark.
    """
    ensure_checkpoint_dir(df.sparkSession)
    coded = _codes_by_offset(_distinct_values(df, columns))
    return coded.select("feature", "value", F.col("code").cast("int").alias("code"))


def extend_codes(
    codes: DataFrame, df: DataFrame, columns: Mapping[str, str] = FEATURE_COLUMNS
) -> DataFrame:
    """Stored codes as they are, and the next numbers for values they do not have, in value order.

    A value keeps its code over all runs, also when it no longer occurs, so what was encoded
    with earlier codes stays valid. Without stored codes these are :func:`category_codes`.
    """
    known = codes.select("feature", "value")
    fresh = _distinct_values(df, columns).join(known, ["feature", "value"], "left_anti")
    ensure_checkpoint_dir(df.sparkSession)
    # one row per feature, so a broadcast is bounded
    start = F.broadcast(cardinalities(codes))
    code = F.col("code") + F.coalesce("cardinality", F.lit(0))
    numbered = _codes_by_offset(fresh).join(start, "feature", "left")
    return codes.select("feature", "value", "code").unionByName(
        numbered.select("feature", "value", code.cast("int").alias("code"))
    )


def _codes_by_offset(values: DataFrame) -> DataFrame:
    # checkpointed, as counting and numbering must see the same partitions even after an
    # executor is lost; a monotonic id is the partition number in the high bits, the position in the low 33
    placed = (
        values.orderBy("feature", "whole", "number", "value")
        .withColumn("id", F.monotonically_increasing_id())
        .withColumns(
            {
                "part": F.shiftright("id", 33),
                "position": F.col("id").bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
        .drop("id")
        .checkpoint()
    )
    # one row per partition and feature: as many as there are partitions, whatever the data
    sizes = placed.groupBy("feature", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("start")
    )
    before = F.sum("n").over(
        Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        "feature", "part", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("offset")
    )
    return placed.join(F.broadcast(offsets), ["feature", "part"]).withColumn(
        "code", F.col("offset") + F.col("position")
    )


def cardinalities(codes: DataFrame) -> DataFrame:
    """Number of codes of each feature."""
    return codes.groupBy("feature").agg((F.max("code") + 1).alias("cardinality"))


def encode(
    df: DataFrame,
    codes: DataFrame,
    cardinality: Sequence[int] | None = None,
    columns: Mapping[str, str] = FEATURE_COLUMNS,
) -> DataFrame:
    """Add ``<feature>_cat``: the value's code, 0 when unknown, below the cardinality."""
    limits = dict(zip(FEATURES, cardinality)) if cardinality else {}
    for feature, column in columns.items():
        own = codes.where(F.col("feature") == feature).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        code: Column = F.coalesce("_code", F.lit(0))
        if feature in limits:
            code = F.greatest(F.lit(0), F.least(code, F.lit(limits[feature] - 1)))
        df = (
            df.join(own, F.col(column).cast("string") == F.col("_value"), "left")
            .withColumn(f"{feature}_cat", code.cast("int"))
            .drop("_value", "_code")
        )
    return df


def save_codes(codes: DataFrame, path: str) -> None:
    codes.write.mode("overwrite").partitionBy("feature").parquet(path)


def load_codes(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """Stored codes and their cardinality; no codes and the defaults when absent."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CODE_TABLE), list(DEFAULT_CARDINALITY)
    codes = spark.read.schema(CODE_TABLE).parquet(path)
    # three rows at most
    found = {row["feature"]: row["cardinality"] for row in cardinalities(codes).collect()}
    if any(feature not in found for feature in FEATURES):
        return codes, list(DEFAULT_CARDINALITY)
    return codes, [found[feature] for feature in FEATURES]
