"""The hourly table kept up to date by a stream instead of computed anew each hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.operators.readings import parse_readings
from barograph.operators.rollup import HOURLY_INPUT, finish_hours, part_aggregates
from barograph.operators.upkeep import mart_diff, mart_upsert


def hourly_stream(messages: DataFrame, lateness: str = "2 hours", last_skipped_offset: int | None = 2) -> DataFrame:
    """Hourly rows as they change (update mode) or once they are final (append mode).

    A message more than ``lateness`` behind the newest one is no longer counted here; ``hours_to_repair``
    finds the hours concerned from the landed log, and ``repaired`` puts them right.
    """
    readings = parse_readings(messages, HOURLY_INPUT, last_skipped_offset)
    windows = readings.withWatermark("read_datetime", lateness).groupBy(F.window("read_datetime", "1 hour"))
    return finish_hours(windows.agg(*part_aggregates()).withColumn("hour_start", F.col("window.start")))


def repaired(streamed: DataFrame, recomputed: DataFrame, complete_from: Column | None = None) -> DataFrame:
    """The stream's table with late messages counted, from a batch run over the landed log.

    complete_from: the time from which the log has every message; earlier hours stay as the stream has them.
    """
    return mart_upsert(streamed, recomputed, complete_from)


def hours_to_repair(streamed: DataFrame, recomputed: DataFrame, complete_from: Column | None = None) -> DataFrame:
    """Hours in which the stream's table and a batch run over the landed log differ."""
    return mart_diff(streamed, recomputed, complete_from).where("status IN ('inserted', 'changed')")
