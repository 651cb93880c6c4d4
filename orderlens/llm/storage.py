"""Folders and stored stages that the driver and all executors can see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Only where that is unset, and only on a local master, a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame, written as Parquet (with these options) in the shared folder and read again: lineage ends here."""
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(broadcast: Broadcast) -> None:
    """Let a task forget a broadcast value; the next use loads it from the task's disk."""
    vars(broadcast).pop("_value", None)
