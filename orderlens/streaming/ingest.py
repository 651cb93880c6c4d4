"""Order files as they arrive: to snapshots, and to validation reports.

A streaming query numbers its batches and repeats a batch under its old number
after a failure. Every output is written under that number and replaces what an
earlier attempt left, so a batch that is delivered twice counts once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderlens.plans.pipeline import build_outputs, validate_lines
from orderlens.sources.conform import conform
from orderlens.sources.files import header_schema, read_order_files


#: Column that names the file a line came from.
SOURCE_FILE = "source_file"


def raw_order_files(
    spark: SparkSession,
    folder: str,
    header: list[str],
    files_per_batch: int | None = None,
    with_file: bool = False,
) -> DataFrame:
    """Stream of the CSV files that appear in a folder, conformed.

    A file with another header than this one stops the stream instead of being misread. ``with_file``
    adds the file's name to its lines, for a delivery ledger.
    """
    reader = (
        spark.readStream.schema(header_schema(header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("pathGlobFilter", "*.csv")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.csv(folder)
    if not with_file:
        return conform(lines)
    return conform(lines.withColumn(SOURCE_FILE, F.col("_metadata.file_path")), keep=(SOURCE_FILE,))


def file_contents(lines: DataFrame) -> DataFrame:
    """One row per file: lines, and two sums of line hashes that do not depend on the lines' order.

    Files with the same lines, however often each occurs, have the same content under any name.
    """
    columns = [c for c in lines.columns if c != SOURCE_FILE]
    # nulls are skipped by a hash: their places are hashed as well
    blanks = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    first, second = F.xxhash64(*columns, blanks), F.xxhash64(F.lit(1), blanks, *columns)
    # 64-bit hashes add up beyond 64 bits
    total = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    return lines.groupBy(SOURCE_FILE).agg(
        F.count(F.lit(1)).alias("n_lines"), total(first).alias("sum_a"), total(second).alias("sum_b")
    )


CONTENT = ["n_lines", "sum_a", "sum_b"]
LEDGER = f"{SOURCE_FILE} string, n_lines bigint, sum_a string, sum_b string, first_file string, batch string"


def delivered_once(lines: DataFrame, ledger: str, batch: int) -> DataFrame:
    """Lines of files whose content no earlier batch, and no lesser file name of this one, has brought.

    The ledger gets a row per file under the batch's number, replacing an earlier attempt; a batch
    that is repeated looks at earlier batches only, so it decides as before. Files without lines leave no trace.
    """
    spark, name = lines.sparkSession, run_name(batch)
    contents = file_contents(lines)
    own = contents.groupBy(*CONTENT).agg(F.min(SOURCE_FILE).alias("least"))
    # an empty part of its own schema stands for a ledger that does not exist yet
    spark.createDataFrame([], LEDGER).drop("batch").write.mode("append").parquet(f"{ledger}/batch=none")
    earlier = spark.read.schema(LEDGER).parquet(ledger).where(F.col("batch") < name).where("first_file IS NULL")
    earlier = earlier.groupBy(*CONTENT).agg(F.min(SOURCE_FILE).alias("before"))
    origin = F.coalesce("before", F.when(F.col(SOURCE_FILE) != F.col("least"), F.col("least")))
    found = contents.join(own, CONTENT).join(earlier, CONTENT, "left").select(
        SOURCE_FILE, *CONTENT, origin.alias("first_file")
    )
    found.write.mode("overwrite").parquet(f"{ledger}/batch={name}")
    new = spark.read.schema(LEDGER).parquet(ledger).where((F.col("batch") == name) & F.col("first_file").isNull())
    return lines.join(new.select(SOURCE_FILE), SOURCE_FILE, "left_semi")


def run_name(batch: int) -> str:
    """Snapshot name of a batch; names sort like the batches."""
    return f"batch-{batch:012d}"


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_orders(stream: DataFrame, root: str, checkpoint: str, ledger: str | None = None) -> StreamingQuery:
    """Write every derived table of each batch of order lines as a snapshot.

    With a ``ledger`` folder (and lines that name their file) a file that was delivered under another
    name before counts once.
    """

    def work(lines: DataFrame, batch: int) -> None:
        if ledger is not None:
            lines = delivered_once(lines, ledger, batch).drop(SOURCE_FILE)
        build_outputs(lines, root, run_name(batch))

    return _start(stream, work, checkpoint)


def arriving_files(
    spark: SparkSession, folder: str, files_per_batch: int = 1000, pattern: str = "*.csv"
) -> DataFrame:
    """Stream of the names of files that appear in a folder; their contents are not read."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
    )
    return reader.load(folder).select("path")


def ingest_order_files(
    names: DataFrame, root: str, checkpoint: str, quarantine: str, ledger: str | None = None
) -> StreamingQuery:
    """As :func:`ingest_orders`, for files with any mix of headers, from a stream of their names.

    A file without a usable header does not stop the stream: its name and the reason are written below
    ``quarantine`` under the batch's number. A batch collects the names of its own files only.
    """

    def work(batch_names: DataFrame, batch: int) -> None:
        paths = sorted({row.path for row in batch_names.collect()})
        file_column = SOURCE_FILE if ledger is not None else None
        lines, issues = read_order_files(batch_names.sparkSession, paths, file_column=file_column)
        issues.write.mode("overwrite").json(f"{quarantine}/batch={run_name(batch)}")
        if ledger is not None:
            lines = delivered_once(lines, ledger, batch).drop(SOURCE_FILE)
        build_outputs(lines, root, run_name(batch))

    return _start(names, work, checkpoint)


def validate_orders(stream: DataFrame, as_of: dt.date, root: str, checkpoint: str) -> StreamingQuery:
    """Write the check table and the summary of each batch of order lines."""

    def work(lines: DataFrame, batch: int) -> None:
        if not lines.isEmpty():
            validate_lines(lines, as_of, f"{root}/{run_name(batch)}")

    return _start(stream, work, checkpoint)


def written_lines(spark: SparkSession, root: str) -> DataFrame:
    """Stream of the order lines that :func:`ingest_orders` wrote below ``root``."""
    path = f"{root}/processed/order_lines"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).drop("run_ts")
