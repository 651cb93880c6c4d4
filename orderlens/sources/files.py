"""File formats: order CSVs, snapshot folders, series as JSON lines, reports."""

from __future__ import annotations

import csv
import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.schema import ORDER_LINE
from orderlens.sources.conform import SPELLINGS, conform, fold_name

#: Without one of these columns a file holds no order lines.
REQUIRED = ["CreateDate", "ProductID"]

INSTANCE = T.StructType(
    [
        T.StructField("start", T.StringType()),
        T.StructField("target", T.ArrayType(T.DoubleType())),
        T.StructField("cat", T.ArrayType(T.IntegerType())),
        T.StructField("dynamic_feat", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("item_id", T.StringType()),
    ]
)

PRODUCT_TABLE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ["ProductID", "ProductName", "CategoryName", "vendorName"]
    ]
)

CUSTOMER_PRODUCT_TABLE = T.StructType(
    [
        *PRODUCT_TABLE.fields,
        T.StructField("CustomerID", T.StringType()),
        T.StructField("FacilityID", T.StringType()),
        T.StructField("OrderCount", T.LongType()),
        T.StructField("FirstOrderDate", T.TimestampType()),
        T.StructField("LastOrderDate", T.TimestampType()),
    ]
)


def read_raw_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Order CSV as text columns named by its header; nothing is inferred.

    Files whose header differs from the first one's are refused when they are read.
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    return reader.option("enforceSchema", False).csv(path)


def read_orders_csv(spark: SparkSession, path: str | list[str], fill_absent: bool = True) -> DataFrame:
    """Order lines of CSV files, read by name.

    The paths of a list may have different headers; those with the same one are scanned
    together. The files of one path share their header.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for one in [path] if isinstance(path, str) else path:
        by_header.setdefault(tuple(read_raw_csv(spark, one).columns), []).append(one)
    frames = [conform(read_raw_csv(spark, paths), fill_absent) for paths in by_header.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: A header line longer than this many bytes is no header.
HEADER_BYTES = 1 << 16

FILE_ISSUE = "path string, issue string"


def literal_path(path: str) -> str:
    """A path whose pattern letters stand for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_header(spark: SparkSession, path: str) -> bytes:
    """The first line of a file, unpacked by its ending; at most HEADER_BYTES are read."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    where = hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        reader = hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream)
        line = hadoop.io.Text()
        if reader.readLine(line, HEADER_BYTES, HEADER_BYTES) >= HEADER_BYTES:
            raise ValueError("the first line has no end")
        return bytes(line.copyBytes())
    finally:
        stream.close()


def header_names(line: bytes) -> list[str]:
    """Column names of a CSV header line; ValueError says why it is none of an order file."""
    try:
        text = line.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise ValueError("the first line is not UTF-8") from None
    names = next(csv.reader([text]), [])
    if not any(name.strip() for name in names):
        raise ValueError("no header")
    if len({name.lower() for name in names}) < len(names):
        raise ValueError("a column name occurs twice")
    folded = {fold_name(name) for name in names}
    absent = [c for c in REQUIRED if not folded.intersection(SPELLINGS[c])]
    if absent:
        raise ValueError("no column for " + ", ".join(absent))
    return names


def read_order_files(
    spark: SparkSession, paths: list[str], fill_absent: bool = True, file_column: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Order lines of CSV files with any mix of headers, and (path, issue) of the files that cannot be read.

    The driver looks at the first line of each file only. Files with the same header are scanned together, so
    there is a scan per header, not per file. A file without a usable header is named in the second
    table and left out; the others go on. ``file_column`` adds the name of a line's file. Without
    any usable file the lines are an empty table of all columns.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    issues = []
    for path in dict.fromkeys(paths):  # a file named twice is read once
        try:
            names = header_names(read_header(spark, path))
        except (ValueError, Py4JJavaError) as problem:
            text = problem.java_exception.toString() if isinstance(problem, Py4JJavaError) else str(problem)
            issues.append((path, text))
        else:
            by_header.setdefault(tuple(names), []).append(path)
    keep = (file_column,) if file_column else ()
    frames = []
    for same in by_header.values():
        raw = read_raw_csv(spark, [literal_path(path) for path in same])
        if file_column:
            raw = raw.withColumn(file_column, F.col("_metadata.file_path"))
        frames.append(conform(raw, fill_absent, keep))
    if not frames:
        empty = empty_order_lines(spark)
        frames.append(empty.withColumn(file_column, F.lit("")) if file_column else empty)
    lines = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return lines, spark.createDataFrame(issues, FILE_ISSUE)


def order_file_names(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """The files of a folder that hold any bytes, by name; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return [row.path for row in found.select("path").orderBy("path").toLocalIterator()]


def header_schema(header: list[str]) -> T.StructType:
    """All-text schema for a streaming CSV source, from its header."""
    return T.StructType([T.StructField(name, T.StringType()) for name in header])


def unknown_columns(df: DataFrame) -> list[str]:
    """Columns that no canonical column claims."""
    known = {spelling for spellings in SPELLINGS.values() for spelling in spellings}
    return [name for name in df.columns if fold_name(name) not in known]


# --- snapshots ------------------------------------------------------------------------


def write_snapshot(df: DataFrame, root: str, run_ts: str, fmt: str = "parquet") -> None:
    """Write one run under ``root/run_ts=...``; a repeat of the run replaces it."""
    (
        df.withColumn("run_ts", F.lit(run_ts))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("run_ts")
        .format(fmt)
        .save(root)
    )


def read_snapshots(
    spark: SparkSession, root: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """All runs below ``root``; an empty table of that schema when there is none."""
    full = T.StructType([*schema.fields, T.StructField("run_ts", T.StringType())])
    if not _exists(spark, root):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("header", True).format(fmt).load(root)


def latest_only(df: DataFrame, column: str = "run_ts") -> DataFrame:
    """Rows of the newest run. On a partition column only its folder is read."""
    newest = df.select(F.max(column).alias("newest")).scalar()
    return df.where(F.col(column) == newest)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def commit_run(spark: SparkSession, root: str, run_ts: str, tables: list[str]) -> None:
    """Record that a run has written all its tables; to be called last."""
    record = spark.createDataFrame([(tables,)], "tables array<string>")
    write_snapshot(record.coalesce(1), f"{root}/runs", run_ts)


def withdraw_run(spark: SparkSession, root: str, run_ts: str) -> None:
    """Take back a run's commit record, if it has one, before its tables are written anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs/run_ts={run_ts}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def committed_run(spark: SparkSession, root: str, table: str | None = None) -> str | None:
    """The newest committed run below ``root``, of those that wrote a table; None without one."""
    if not _exists(spark, f"{root}/runs"):
        return None
    runs = spark.read.schema("tables array<string>, run_ts string").parquet(f"{root}/runs")
    if table is not None:
        runs = runs.where(F.array_contains("tables", table))
    return runs.select(F.max("run_ts")).first()[0]


def read_latest_lookups(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Product and customer-product tables of one run: the newest committed one that wrote them."""
    tables = [("product_lookup", PRODUCT_TABLE), ("customer_product_lookup", CUSTOMER_PRODUCT_TABLE)]
    run = committed_run(spark, root, "lookup/customer_product_lookup")
    products, relations = (
        read_snapshots(spark, f"{root}/lookup/{name}", schema).where(F.col("run_ts") == F.lit(run)).drop("run_ts")
        for name, schema in tables
    )
    return products, relations


# --- keyed lookup records ---------------------------------------------------------------


def write_lookup_items(items: DataFrame, root: str, run_ts: str) -> None:
    """Keyed records of a run, in key order, so that a point read touches the files and row groups of its key.

    Files hold ranges of (customer_facility, product_id); records of products have no pair and lie in ranges of
    their own. Parquet's statistics per row group then leave out all but the key's.
    """
    # no record type and pair is one partition: product_id splits a pair of very many products
    placed = items.repartitionByRange("record_type", "customer_facility", "product_id")
    ordered = placed.sortWithinPartitions("record_type", "customer_facility", "product_id")
    (
        ordered.withColumn("run_ts", F.lit(run_ts))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_ts", "record_type")
        .parquet(root)
    )


def read_lookup_items(spark: SparkSession, root: str, run_ts: str) -> DataFrame:
    """Keyed records of a run; a filter on ``customer_facility`` or ``product_id`` reaches the scan."""
    return spark.read.parquet(root).where(F.col("run_ts") == run_ts).drop("run_ts")


# --- series and reports ---------------------------------------------------------------


def write_instances(df: DataFrame, path: str) -> None:
    """Series instances as JSON lines, without product information.

    The JSON writer leaves null fields out by itself. Training and test instances
    go to a folder each, in one job.
    """
    writer = df.drop("product_info").write.mode("overwrite")
    (writer.partitionBy("part") if "part" in df.columns else writer).json(path)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSTANCE).json(path)


def report_paths(data_path: str) -> tuple[str, str]:
    """Where the validation report and the summary of a data file go."""
    # Folder and file names.
    base = data_path.replace("processed/", "validation/")
    stem = re.sub(r"\.csv$", "", base)
    return f"{stem}_validation.json", f"{stem}_summary.json"


def write_report(report: DataFrame, path: str) -> None:
    """A validation report, one JSON object per line."""
    report.write.mode("overwrite").json(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def empty_order_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ORDER_LINE)
