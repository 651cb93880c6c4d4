"""Decisions over a registry of training runs and their artifacts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshness(
    runs: DataFrame, as_of: Column, by: list[str] | None = None, end: str = "end_time", days: int = 7
) -> DataFrame:
    """Newest end time and whether it is more than ``days`` old; no run also asks for one."""
    newest = runs.groupBy(*(by or [])).agg(F.max(end).alias("latest_end_time"))
    stale = F.col("latest_end_time") < as_of.cast("timestamp") - F.make_dt_interval(F.lit(days))
    return newest.withColumn("retrain", F.coalesce(stale, F.lit(True)))


def retention(
    runs: DataFrame, kind: str = "kind", name: str = "name", created: str = "created", keep: int = 2
) -> DataFrame:
    """Mark the newest ``keep`` runs of each kind ``keep``, all others ``delete``.

    Equal rows are one run and share their mark; runs without a creation time are the
    oldest. The survivors are found with a rank filter that works before the shuffle.
    The rest is marked by joining them back on the run itself, nulls included, so that
    a kind with very many runs is never sorted in one place.
    """
    newest = Window.partitionBy(kind).orderBy(F.desc(created), name)
    key = [kind, name, created]
    kept = (
        runs.select(*key)
        .distinct()
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= keep)
        .select(*[F.col(c).alias(f"_kept_{c}") for c in key], F.lit("keep").alias("_action"))
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_kept_{c}")) for c in key])
    action = F.coalesce("_action", F.lit("delete")).alias("action")
    return runs.join(kept, same, "left").select(*runs.columns, action)


def run_metrics(metrics: DataFrame, run: str = "name", end: str = "end_time") -> DataFrame:
    """Metrics of each run as a map, newest run first.

    ``metrics`` has one row per run and metric; the last value of a name counts,
    so the map has one entry per metric name.
    """
    final = metrics.groupBy(run, "metric").agg(
        F.max(end).alias(end), F.max_by("value", end).alias("value")
    )
    entries = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return (
        final.groupBy(run)
        .agg(F.max(end).alias(end), F.map_from_entries(entries).alias("metrics"))
        .orderBy(F.desc(end), run)
    )
