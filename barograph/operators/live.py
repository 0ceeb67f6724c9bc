"""The live page's views, as batch queries over the log. ``barograph.streaming`` runs the same on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barograph.functions.values import band, strip_unit
from barograph.operators.readings import parse_documents

LIVE_COLUMNS = [
    "time",
    "bme_280_temperature",
    "bme_280_humidity",
    "bme_280_pressure",
    "picow_temperature",
    "picow_mem_alloc_bytes",
    "picow_mem_free_bytes",
    "picow_free_storage_kb",
    "picow_free_cpu_freq_mhz",
    "picow_local_ip",
]
LOG_POSITION = ["timestamp", "partition", "offset"]
BUFFER = 30

#: Gauge scale (fixed values): upper edges of the humidity bands and their colours.
HUMIDITY_EDGES = [10, 20, 30, 50]
HUMIDITY_BANDS = ["red", "orange", "yellow", "green", "over"]


def live_projection(messages: DataFrame) -> DataFrame:
    """The ten flat fields of every readable message, with its place in the log.

    Time is the device's own text. Memory is in KiB although the names say bytes. A field that does not
    read is NULL; a message without sensor or board part is left out, where the live page would have stopped.
    """
    docs = parse_documents(messages).where(F.col("bme280").isNotNull() & F.col("picow").isNotNull())
    sensor = lambda field, unit: strip_unit(F.col(f"bme280.{field}"), unit).cast("double")
    kib = lambda field: F.col(f"picow.{field}").try_cast("bigint") / F.lit(1024.0)
    return docs.select(
        *LOG_POSITION,
        F.col("bme280.read_datetime").alias("time"),
        sensor("temperature", "C").alias("bme_280_temperature"),
        sensor("humidity", "%").alias("bme_280_humidity"),
        sensor("pressure", "hPa").alias("bme_280_pressure"),
        F.col("picow.temperature").alias("picow_temperature"),
        kib("mem_alloc_bytes").alias("picow_mem_alloc_bytes"),
        kib("mem_free_bytes").alias("picow_mem_free_bytes"),
        F.col("picow.free_storage_kb").alias("picow_free_storage_kb"),
        F.col("picow.cpu_freq_mhz").alias("picow_free_cpu_freq_mhz"),
        F.col("picow.local_ip").alias("picow_local_ip"),
    )


def event_lines(live: DataFrame) -> DataFrame:
    """Each live row as the text the page receives."""
    return live.select(
        *LOG_POSITION,
        F.concat(F.lit("data:"), F.to_json(F.struct(*LIVE_COLUMNS), {"ignoreNullFields": "false"}), F.lit("\n\n")).alias("line"),
    )


def _newest(order: list[str]):
    return [F.desc(c) for c in order]


def last_points(live: DataFrame, n: int = BUFFER) -> DataFrame:
    """The n newest rows of the whole log, oldest in slot ``n - rows``, newest in slot ``n - 1``.

    The limit keeps n rows per task before anything is gathered, so the window sees n rows.
    """
    newest = live.orderBy(*_newest(LOG_POSITION)).limit(n)
    rank = F.row_number().over(W.orderBy(*_newest(LOG_POSITION)))
    return newest.withColumn("slot", F.lit(n) - rank)


def last_points_per_source(live: DataFrame, n: int = BUFFER) -> DataFrame:
    """The same per source. Spark limits each group to n rows in every task before the shuffle."""
    rank = F.row_number().over(W.partitionBy("picow_local_ip").orderBy(*_newest(LOG_POSITION)))
    return live.withColumn("_rank", rank).where(F.col("_rank") <= n).withColumn("slot", F.lit(n) - F.col("_rank")).drop("_rank")


def latest_reading(live: DataFrame) -> DataFrame:
    """Each source's newest row."""
    values = [c for c in LIVE_COLUMNS if c != "picow_local_ip"]
    newest = F.max_by(F.struct(*LOG_POSITION, *values), F.struct(*LOG_POSITION)).alias("newest")
    return live.groupBy("picow_local_ip").agg(newest).select("picow_local_ip", "newest.*")


def latest_source(live: DataFrame) -> DataFrame:
    """Address of the device that sent the newest message that names one, ``Unknown`` if there is none."""
    newest = F.max_by("picow_local_ip", F.when(F.col("picow_local_ip").isNotNull(), F.struct(*LOG_POSITION)))
    return live.agg(F.coalesce(newest, F.lit("Unknown")).alias("source_ip"))


def humidity_gauge(live: DataFrame) -> DataFrame:
    """Colour band of the humidity and the needle's place on the scale; above the scale the place exceeds 1."""
    value = F.col("bme_280_humidity")
    return live.select(
        *LOG_POSITION,
        "picow_local_ip",
        "bme_280_humidity",
        band(value, HUMIDITY_EDGES, HUMIDITY_BANDS).alias("band"),
        (value / F.lit(float(HUMIDITY_EDGES[-1]))).alias("needle"),
    )


def memory_split(live: DataFrame) -> DataFrame:
    """Each source's newest pair of allocated and free memory, and the allocated part."""
    alloc, free = F.col("picow_mem_alloc_bytes"), F.col("picow_mem_free_bytes")
    return latest_reading(live).select(
        "picow_local_ip",
        alloc.alias("allocated_kib"),
        free.alias("free_kib"),
        F.try_divide(alloc, alloc + free).alias("allocated_share"),
    )
