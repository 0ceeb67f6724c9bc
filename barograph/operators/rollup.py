"""The two result tables: per hour and per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions.values import half_up_mean
from barograph.schema import HOUR_KEY, HOURLY_COLUMNS, MEASURES

HOURLY_INPUT = ["id", "read_datetime", *MEASURES.values()]
SOURCE_INPUT = ["id", "picow_local_ip"]


def part_aggregates() -> list[Column]:
    aggs = [F.count("id").alias("count"), F.max("read_datetime").alias("datetime")]
    for short, column in MEASURES.items():
        aggs += [
            F.sum(column).alias(f"sum_{short}"),
            F.count(column).alias(f"n_{short}"),
            F.min(column).alias(f"min_{short}"),
            F.max(column).alias(f"max_{short}"),
        ]
    return aggs


def hourly_parts(readings: DataFrame) -> DataFrame:
    """Unrounded partial results per hour. Parts of disjoint inputs can be united and merged exactly.

    One key column (the hour's start) instead of four; map-side partial aggregation leaves at most one
    row per hour and task to shuffle, so a busy hour is no hot spot.
    """
    return readings.groupBy(F.date_trunc("hour", "read_datetime").alias("hour_start")).agg(*part_aggregates())


def merge_parts(parts: DataFrame) -> DataFrame:
    aggs = [F.sum("count").alias("count"), F.max("datetime").alias("datetime")]
    for short in MEASURES:
        aggs += [
            F.sum(f"sum_{short}").cast("decimal(28,6)").alias(f"sum_{short}"),
            F.sum(f"n_{short}").alias(f"n_{short}"),
            F.min(f"min_{short}").alias(f"min_{short}"),
            F.max(f"max_{short}").alias(f"max_{short}"),
        ]
    return parts.groupBy("hour_start").agg(*aggs)


def finish_hours(parts: DataFrame) -> DataFrame:
    """Merged parts to the 19 columns of the hourly table."""
    start = F.col("hour_start")
    cols = {
        "datetime": F.col("datetime"),
        "date": F.to_date(start),
        "year": F.year(start),
        "month": F.month(start),
        "day": F.dayofmonth(start),
        "hour": F.hour(start),
        "count": F.col("count"),
    }
    for short in MEASURES:
        cols[f"min_{short}"] = F.round(f"min_{short}", 2).cast("double")
        cols[f"avg_{short}"] = half_up_mean(F.col(f"sum_{short}"), F.col(f"n_{short}"))
        cols[f"max_{short}"] = F.round(f"max_{short}", 2).cast("double")
    return parts.select(*[cols[c].alias(c) for c in HOURLY_COLUMNS])


def hourly_rollup(readings: DataFrame) -> DataFrame:
    return finish_hours(hourly_parts(readings))


def newest_first(hourly: DataFrame) -> DataFrame:
    """The table's order on output; nothing inside the pipeline sorts."""
    return hourly.orderBy(*[F.desc(k) for k in HOUR_KEY])


def messages_by_source(readings: DataFrame) -> DataFrame:
    """Messages per source address; messages without address form a group of their own."""
    return readings.groupBy(F.col("picow_local_ip").alias("source_ip")).agg(F.count("id").alias("messages"))
