"""The dashboard's questions, asked of the two result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.operators.ordered import previous_row
from barograph.schema import HOUR_KEY

#: What the dashboard offers to choose from (fixed values).
X_AXES = ["datetime", "hour", "date", "day", "month", "year"]
LINE_METRICS = [f"{stat}_{m}" for m in ("bme_temp", "picow_temp") for stat in ("min", "avg", "max")]
HEATMAP_MEASURES = ["avg_bme_temp", "avg_picow_temp"]
HEADLINE = ["avg_bme_temp", "avg_bme_hum", "avg_bme_press"]


def _pick(name: str, allowed: list[str]) -> str:
    if name not in allowed:
        raise ValueError(f"{name!r} is none of {allowed}")
    return name


def _exact(c: Column | str) -> Column:
    """The two-decimal values of the hourly table as decimals, so differences and sums of them are exact."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)")


def _difference(previous: Column, current: Column, sign: str) -> Column:
    d = _exact(previous) - _exact(current)
    return F.round(d if sign == "previous_minus_latest" else -d, 3).cast("double")


def latest_hours(hourly: DataFrame, n: int = 2) -> DataFrame:
    """The n newest rows, newest first; ordered explicitly, not by where a table scan happens to begin."""
    return hourly.orderBy(*[F.desc(k) for k in HOUR_KEY]).limit(n)


def hour_headline(hourly: DataFrame, sign: str = "previous_minus_latest") -> DataFrame:
    """Latest averages and their change against the hour before; with one hour only the changes are NULL."""
    key = F.struct(*HOUR_KEY)
    pair = latest_hours(hourly, 2).agg(
        F.count("*").alias("n"),
        *[F.max_by(m, key).alias(f"latest_{m}") for m in HEADLINE],
        *[F.min_by(m, key).alias(f"previous_{m}") for m in HEADLINE],
    )
    both = F.col("n") == 2
    return pair.where("n > 0").select(
        F.col("latest_avg_bme_temp").alias("avg_bme_temp"),
        F.col("latest_avg_bme_hum").alias("avg_bme_hum"),
        F.round(_exact("latest_avg_bme_press"), 1).cast("double").alias("avg_bme_press"),
        *[
            F.when(both, _difference(F.col(f"previous_{m}"), F.col(f"latest_{m}"), sign)).alias(f"diff_{m}")
            for m in HEADLINE
        ],
    )


def hour_delta_series(hourly: DataFrame, sign: str = "previous_minus_latest") -> DataFrame:
    """The headline's change for every hour, against the hour before it in the table."""
    month = F.col("year") * 12 + F.col("month")
    pairs = previous_row(hourly.select(*HOUR_KEY, *HEADLINE), [], HOUR_KEY, month, HEADLINE)
    return pairs.select(
        *HOUR_KEY, *HEADLINE, *[_difference(F.col(f"prev_{m}"), F.col(m), sign).alias(f"diff_{m}") for m in HEADLINE]
    )


def source_share(by_source: DataFrame) -> DataFrame:
    """Each source's part of all messages. The total is a one-row subquery, not a window over all sources."""
    total = by_source.agg(F.sum("messages")).scalar()
    return by_source.select("source_ip", "messages", (F.col("messages") / total).alias("share"))


def heatmap_date_hour(hourly: DataFrame, measure: str = "avg_bme_temp") -> DataFrame:
    """One cell per date and hour, the table's value as it is."""
    return hourly.select("date", "hour", F.col(_pick(measure, HEATMAP_MEASURES)).alias("value"))


def heatmap_matrix(hourly: DataFrame, measure: str = "avg_bme_temp") -> DataFrame:
    """The same as one row per date and one column per hour of the day."""
    cells = heatmap_date_hour(hourly, measure)
    wide = cells.groupBy("date").pivot("hour", list(range(24))).agg(F.max("value"))
    return wide.select("date", *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in range(24)])


def heatmap_weekday_hour(hourly: DataFrame, measure: str = "avg_bme_temp") -> DataFrame:
    """Cells by day of the week (0 is Sunday): hours of several weeks are averaged by their message counts."""
    value = _exact(_pick(measure, HEATMAP_MEASURES))
    weight = F.when(value.isNotNull(), F.col("count"))
    weighted = F.sum(value * F.col("count").cast("decimal(18,0)")).cast("decimal(28,2)")
    return hourly.groupBy((F.dayofweek("date") - 1).alias("weekday"), "hour").agg(
        F.sum("count").alias("count"), F.round(weighted / F.sum(weight), 2).cast("double").alias("value")
    )


def chart_columns(hourly: DataFrame, x: str = "datetime", metrics: list[str] | None = None) -> DataFrame:
    metrics = metrics if metrics is not None else LINE_METRICS[:3]
    return hourly.select(_pick(x, X_AXES), *[_pick(m, LINE_METRICS) for m in metrics])


def metric_long(hourly: DataFrame, x: str = "datetime", metrics: list[str] | None = None) -> DataFrame:
    """The chosen lines as rows ``x, metric, value``."""
    metrics = metrics if metrics is not None else LINE_METRICS[:3]
    return chart_columns(hourly, x, metrics).unpivot([x], metrics, "metric", "value")
