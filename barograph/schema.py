"""Fixed schemas of the message log, the JSON document and the result tables.

The names and types below are fixed values: they are the interface that producers and
dashboards already use.
"""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
    ]
)

SENSOR = T.StructType([T.StructField(n, T.StringType()) for n in ("pressure", "temperature", "humidity", "read_datetime")])

BOARD = T.StructType(
    [T.StructField("local_ip", T.StringType())]
    + [
        T.StructField(n, T.DoubleType())
        for n in ("temperature", "free_storage_kb", "mem_alloc_bytes", "mem_free_bytes", "cpu_freq_mhz")
    ]
)

DOCUMENT = T.StructType(
    [T.StructField("id", T.IntegerType()), T.StructField("bme280", SENSOR), T.StructField("picow", BOARD)]
)

#: Column of ``readings`` -> where it sits in the document.
DOCUMENT_PATHS = {
    "bme280_pressure": ("bme280", "pressure"),
    "bme280_temperature": ("bme280", "temperature"),
    "bme280_humidity": ("bme280", "humidity"),
    "device_datetime": ("bme280", "read_datetime"),
    "picow_local_ip": ("picow", "local_ip"),
    "picow_temperature": ("picow", "temperature"),
    "picow_mem_alloc_bytes": ("picow", "mem_alloc_bytes"),
    "picow_mem_free_bytes": ("picow", "mem_free_bytes"),
    "picow_cpu_freq_mhz": ("picow", "cpu_freq_mhz"),
    "picow_free_storage_kb": ("picow", "free_storage_kb"),
}

#: Averaged measures are kept as decimals, so a mean never depends on the order of the rows.
MEASURE = T.DecimalType(18, 6)

#: Short name in the hourly table -> column of ``readings``.
MEASURES = {
    "bme_temp": "bme280_temperature",
    "picow_temp": "picow_temperature",
    "bme_hum": "bme280_humidity",
    "bme_press": "bme280_pressure",
}

HOUR_KEY = ["year", "month", "day", "hour"]
HOURLY_COLUMNS = ["datetime", "date", *HOUR_KEY, "count"] + [
    f"{stat}_{m}" for m in MEASURES for stat in ("min", "avg", "max")
]
HOURLY_TABLE = "agg_by_hour_df"
SOURCE_TABLE = "agg_by_ip_df"


def document_schema(columns: list[str] | None = None) -> T.StructType:
    """The document schema, narrowed to what the wanted ``readings`` columns need.

    Spark's JSON reader skips the values of fields that are not declared.
    """
    if columns is None:
        return DOCUMENT
    wanted = [DOCUMENT_PATHS[c] for c in columns if c in DOCUMENT_PATHS]
    fields = [DOCUMENT["id"]]
    for outer in ("bme280", "picow"):
        inner = [f for f in DOCUMENT[outer].dataType.fields if (outer, f.name) in wanted]
        if inner:
            fields.append(T.StructField(outer, T.StructType(inner)))
    return T.StructType(fields)
