"""Feedback events: parsed, validated, and split into accepted and rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderlens.operators.feedback import feedback_records, parse_feedback, validate_feedback
from orderlens.streaming.ingest import run_name


def feedback_stream(bodies: DataFrame, body: str = "value") -> DataFrame:
    """Validated rows of a stream of JSON bodies; stateless."""
    return validate_feedback(parse_feedback(bodies, body))


def store_feedback(
    stream: DataFrame, accepted: str, rejected: str, checkpoint: str, received: Column | None = None
) -> StreamingQuery:
    """Append accepted and rejected feedback to two folders, per batch.

    A batch is read once and both parts are written under its number, replacing an
    earlier attempt.
    """

    def work(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            time = received if received is not None else F.current_timestamp()
            parts = {
                accepted: feedback_records(rows, time),
                rejected: rows.where(F.col("error_code").isNotNull()),
            }
            for path, part in parts.items():
                part.write.mode("overwrite").parquet(f"{path}/batch={run_name(batch)}")
        finally:
            rows.unpersist()

    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
