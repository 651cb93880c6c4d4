"""Daily demand kept up to date without going back to earlier files.

Every batch adds its own sums, so files may arrive in any order: no watermark, no row lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderlens.schema import SERIES
from orderlens.streaming.ingest import run_name

DAILY = (
    "CustomerID string, FacilityID string, ProductID string, Date date, Quantity double, "
    "line string, batch string"
)


def daily_demand_stream(
    lines: DataFrame, identity: list[str] | None = None, ts: str = "CreateDate"
) -> DataFrame:
    """Quantity, series and day of each order line of a stream.

    With ``identity`` a line keeps the text of these columns, by which it counts once
    however often it is delivered. Lines without a series key or a date are left out.
    """
    line = F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}) if identity else F.lit(None)
    return lines.na.drop(subset=[*SERIES, ts]).select(
        *SERIES,
        F.to_date(ts).alias("Date"),
        F.coalesce(F.col("OrderUnits"), F.lit(0.0)).alias("Quantity"),
        line.cast("string").alias("line"),
    )


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SERIES, "Date").agg(F.sum("Quantity").alias("Quantity"))


def _once(rows: DataFrame) -> DataFrame:
    """One row per line, the first delivered; ties go to the least row."""
    lead = [c for c in ["batch"] if c in rows.columns]
    row = F.min(F.struct(*lead, *SERIES, "Date", "Quantity")).alias("row")
    return rows.groupBy("line").agg(row).select(*[f"row.{c}" for c in [*SERIES, "Date", "Quantity"]], "line")


def store_daily_demand(daily: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what each batch adds under the batch's number; a repeated batch replaces itself.

    Lines with an identity are kept one by one, all others as sums by series and day.
    """

    def work(rows: DataFrame, batch: int) -> None:
        sums = _summed(rows.where("line IS NULL")).withColumn("line", F.lit(None).cast("string"))
        added = sums.unionByName(_once(rows.where("line IS NOT NULL")))
        added.write.mode("overwrite").parquet(f"{path}/batch={run_name(batch)}")

    return (
        daily.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _finished(spark: SparkSession, folder: str, column: str) -> list[str]:
    """Values of the partition folders whose write has ended, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{column}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(status.getPath().getParent().getName().split("=", 1)[1] for status in found)


def _generations(path: str) -> str:
    return f"{path.rstrip('/')}_generations"


def _delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the newest finished generation and of the batches after it; a generation's have an empty batch."""
    done = _finished(spark, _generations(path), "through")
    if not done:
        return spark.read.schema(schema).parquet(path)
    covered = spark.read.schema(schema).parquet(f"{_generations(path)}/through={done[-1]}")
    covered = covered.withColumn("batch", F.lit(""))  # before all batches, so its lines come first
    later = [b for b in _finished(spark, path, "batch") if b > done[-1]]
    if not later:
        return covered
    folders = [f"{path}/batch={b}" for b in later]
    return covered.unionByName(spark.read.schema(schema).option("basePath", path).parquet(*folders))


def compact_daily_demand(spark: SparkSession, path: str, schema: str = DAILY) -> str | None:
    """Merge the newest generation and all finished batches after it into a generation; the last batch it covers.

    Sums are added up by series and day, lines with an identity are kept once each, so that later
    deliveries of them are still known. Batches are left where they are: readers turn to the generation when its
    write has ended, and a batch that is repeated after it was covered changes nothing, as it brings the same
    lines. None, and nothing written, without a new batch.
    """
    batches, done = _finished(spark, path, "batch"), _finished(spark, _generations(path), "through")
    if not batches or (done and done[-1] >= batches[-1]):
        return None
    rows = _delivered(spark, path, schema).where(F.col("batch") <= batches[-1])
    sums = _summed(rows.where("line IS NULL")).withColumn("line", F.lit(None).cast("string"))
    merged = sums.unionByName(_once(rows.where("line IS NOT NULL")))
    merged.write.mode("overwrite").parquet(f"{_generations(path)}/through={batches[-1]}")
    return batches[-1]


def current_daily_demand(spark: SparkSession, path: str, schema: str = DAILY) -> DataFrame:
    """Quantity of every series and day from all that was delivered: a generation and the batches after it."""
    rows = _delivered(spark, path, schema)
    lines = _once(rows.where("line IS NOT NULL"))
    return _summed(rows.where("line IS NULL").select(*lines.columns).unionByName(lines))
