"""Telemetry made from the ``events`` table: a message log, GPS sentences and raw sensor registers.

The shapes follow the documents that devices send; the values are plain functions of the event, so the
expected results can be worked out from ``events`` without any parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.functions.sentences import checksum
from barograph.schema import MESSAGES
from barograph.session import pin_utc

TOPIC = "telemetry"
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table dealt out over all cores, as a log of many files or partitions would be.

    It is one file with one row group, which one task reads. What stands in for a log is made from the dealt rows, so
    that parsing runs everywhere from the start; readers of real logs deal nothing out.
    """
    events = pin_utc(spark).read.parquet(f"{sf_dir}/events.parquet").drop("event_type")
    return events.repartition(spark.sparkContext.defaultParallelism, "event_id")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = pin_utc(spark).readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf_dir)


def _k() -> Column:
    return F.regexp_extract("props", r"(\d+)", 1).cast("int")


def _cents(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def as_messages(events: DataFrame) -> DataFrame:
    """Each event as one message of the log.

    Fixed rules: ``event_id % 97 = 13`` is cut off in the middle, ``% 89 = 7`` has no id, ``% 83 = 5`` has plain
    numbers, all others have units behind the sensor values.
    """
    n, user = F.col("event_id"), F.col("user_id")
    temperature = _cents(F.col("value"))
    humidity = _cents(_k() + F.lit(0.5))
    pressure = _cents(F.lit(870.25) + user % 50)
    clock = F.date_format("ts", "yyyy-M-d H:m:s").alias("read_datetime")
    board = F.struct(
        F.concat(F.lit("192.168.1."), user).alias("local_ip"),
        (temperature + F.lit(2.25).cast("decimal(4,2)")).alias("temperature"),
        F.lit(409.5).alias("free_storage_kb"),
        (50_000 + n % 1000 * 16).alias("mem_alloc_bytes"),
        (150_000 - n % 1000 * 16).alias("mem_free_bytes"),
        F.lit(125.0).alias("cpu_freq_mhz"),
    ).alias("picow")
    numbers = {"pressure": (pressure, "hPa"), "temperature": (temperature, "C"), "humidity": (humidity, "%")}
    suffixed = F.struct(*[F.concat(c, F.lit(u)).alias(k) for k, (c, u) in numbers.items()], clock).alias("bme280")
    plain = F.struct(*[c.alias(k) for k, (c, _) in numbers.items()], F.lit(1110.8).alias("altitude"), clock).alias("bme280")
    whole = F.struct(n.alias("id"), suffixed, board)
    text = (
        F.when(n % 97 == 13, F.left(F.to_json(whole), F.lit(40)))
        .when(n % 89 == 7, F.to_json(F.struct(suffixed, board)))
        .when(n % 83 == 5, F.to_json(F.struct(n.alias("id"), plain, board)))
        .otherwise(F.to_json(whole))
    )
    return events.select(
        F.lit(None).cast("binary").alias("key"),
        text.cast("binary").alias("value"),
        F.lit(TOPIC).alias("topic"),
        F.lit(0).alias("partition"),
        n.alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    ).select(*MESSAGES.fieldNames())


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(read_events(spark, sf_dir))


def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(stream_events(spark, sf_dir))


#: Messages with this last digit of the offset come after all others in ``arrived_log``.
LATE_DIGIT = 3
ARRIVALS = 4
#: Rows of a stretch that go into one file; a stretch with more comes in several.
FILE_ROWS = 50_000


def _files_each(rows: DataFrame) -> int:
    """In how many files each stretch of ``rows`` comes."""
    return max(1, -(-rows.count() // (ARRIVALS * FILE_ROWS)))


def _files_in(spark: SparkSession, path: str) -> int:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(f.getPath().getName().endswith(".parquet") for f in files.listStatus(root)) if files.exists(root) else 0


def _arrive(rows: DataFrame, path: str, files: int, *keys: str) -> None:
    """Adds ``rows`` to ``path`` as exactly ``files`` files, dealt by ``keys``: a stream that takes as many at a time reads
    stretch by stretch, since it takes files by age. Where a file has no row, an empty one is written for it."""
    before = _files_in(rows.sparkSession, path)
    rows.repartition(files, *keys).write.mode("append").parquet(path)
    for _ in range(before + files - _files_in(rows.sparkSession, path)):
        rows.limit(0).coalesce(1).write.mode("append").parquet(path)


def arrived_log(spark: SparkSession, sf_dir: str, path: str, late_ones: bool = True) -> tuple[str, int]:
    """The log as files in the order of arrival, written to ``path``: ``ARRIVALS`` stretches of offsets, then the late ones.

    Without ``late_ones`` each message is in its stretch. Returns the path and how many files each stretch has.
    """
    log, at = messages(spark, sf_dir), F.col("offset")
    size, files = log.agg(F.max("offset")).scalar() + 1, _files_each(log)
    late = (at % 10 == LATE_DIGIT) & F.lit(late_ones)
    for i in range(ARRIVALS + late_ones):
        part = log.where(late) if i == ARRIVALS else log.where(~late & (F.floor(at * ARRIVALS / size) == i))
        _arrive(part, path, files, "offset")
    return path, files


def arrived_lines(lines: DataFrame, path: str) -> tuple[int, int]:
    """GPS lines as files in the order of arrival, written to ``path``: stretches of sequence numbers, but every seventh line
    comes with the stretch after its own. Returns the length of a stretch and how many files each has."""
    step, files = (lines.agg(F.max("seq")).first()[0] or 0) // ARRIVALS + 1, _files_each(lines)
    at = F.expr(f"seq div {step}") + F.when(F.col("seq") % 7 == 3, 1).otherwise(0)
    for i in range(ARRIVALS + 1):
        _arrive(lines.where(at == i), path, files, "device_id", "seq")
    return step, files


def repeated_log(spark: SparkSession, sf_dir: str, path: str) -> tuple[str, int]:
    """The log as files in the order of arrival, where each stretch but the first comes with repeats: every seventh message
    of the last hour of the stretch before it, and one of its own twice. Returns the path and how many files each stretch has."""
    log, at = messages(spark, sf_dir), F.col("offset")
    files = _files_each(log)
    size = log.agg(F.max("offset")).scalar() + 1
    log = log.withColumn("part", F.floor(at * ARRIVALS / size))
    ends = log.groupBy("part").agg(F.max("timestamp").alias("end"), F.max("offset").alias("last"))
    log = log.join(ends, "part")
    for i in range(ARRIVALS):
        again = log.where((F.col("part") == i - 1) & (at % 7 == 0) & (F.col("timestamp") > F.col("end") - F.expr("INTERVAL 1 HOUR")))
        own = log.where(F.col("part") == i)
        rows = own.unionByName(own.where(at == F.col("last"))).unionByName(again)
        _arrive(rows.select(*MESSAGES.fieldNames()), path, files, "offset")
    return path, files


def arrived_bursts(spark: SparkSession, sf_dir: str, path: str, parts: range) -> int:
    """Stretches ``parts`` of ``ARRIVALS`` of the raw registers, added to ``path``. Returns how many files each has."""
    rows = read_events(spark, sf_dir)
    size, files = rows.agg(F.max("event_id")).scalar() + 1, _files_each(rows)
    for i in parts:
        _arrive(raw_registers(rows.where(F.floor(F.col("event_id") * ARRIVALS / size) == i)), path, files, "reading_id")
    return files


def gps_lines(events: DataFrame) -> DataFrame:
    """Each event as one GPS sentence of the device ``user_id``; kind by ``event_id % 6``.

    ``event_id % 50 = 0`` carries a checksum that is no number, ``= 1`` a wrong one. ``event_id % 120 = 66`` has a clock
    and ``= 67`` a latitude that end in a letter and are no numbers.
    """
    n, user, k = F.col("event_id"), F.col("user_id"), _k()
    utc, day = F.concat(F.date_format("ts", "HHmmss"), F.when(n % 120 == 66, "f").otherwise("")), F.date_format("ts", "ddMMyy")
    value = _cents(F.col("value")).cast("string")

    def minutes(c: Column) -> Column:
        return F.concat(F.lpad(F.expr(f"{c} div 100").cast("string"), 2, "0"), F.lit("."), F.lpad((F.expr(c) % 100).cast("string"), 2, "0"))

    lat = F.concat(F.lpad((user % 90).cast("string"), 2, "0"), minutes("(event_id * 7 % 6000)"), F.when(n % 120 == 67, "d").otherwise(""))
    lon = F.concat(F.lpad((user % 180).cast("string"), 3, "0"), minutes("(event_id * 11 % 6000)"))
    ns, ew = F.when(user % 2 == 0, "N").otherwise("S"), F.when(user % 3 == 0, "E").otherwise("W")
    status = F.when(n % 7 == 0, "V").otherwise("A")
    tenths = lambda c: F.concat(F.expr(f"{c} div 10"), F.lit("."), F.expr(c) % 10)
    course = tenths("(event_id % 3600)")
    fix = F.when(n % 11 == 0, "0").otherwise("1")
    hdop = F.concat(F.expr("k div 10"), F.lit("."), F.col("k") % 10)
    total, index = F.lit(3), F.expr("1 + event_id div 6 % 3")

    def satellites(count: Column) -> Column:
        one = lambda j: F.concat_ws(
            ",",
            F.lpad((n % 20 + index * 4 + j).cast("string"), 2, "0"),
            (F.col("k") % 90).cast("string"),
            (user % 360).cast("string"),
            F.when((n + j) % 5 == 0, "").otherwise((F.col("k") % 50).cast("string")),
        )
        return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), one), ",")

    bodies = {
        0: F.concat_ws(",", F.lit("GPRMC"), utc, status, lat, ns, lon, ew, value, course, day, F.lit(""), F.lit("")),
        1: F.concat_ws(",", F.lit("GNGLL"), lat, ns, lon, ew, utc, status),
        2: F.concat_ws(",", F.lit("GPVTG"), course, F.lit("T"), F.lit(""), F.lit("M"), value, F.lit("N")),
        3: F.concat_ws(
            ",", F.lit("GNGGA"), utc, lat, ns, lon, ew, fix, (F.col("k") % 13).cast("string"), hdop, value,
            F.lit("M"), F.lit("-20.5"), F.lit("M"), F.lit(""), F.lit(""),
        ),
        4: F.concat_ws(
            ",", F.lit("GLGSA"), F.lit("A"), (1 + n % 3).cast("string"), (F.col("k") % 32 + 1).cast("string"),
            (user % 32 + 1).cast("string"), *[F.lit("")] * 10, F.lit("2.5"), hdop, F.lit("1.5"),
        ),
        5: F.concat_ws(
            ",", F.lit("GPGSV"), total.cast("string"), index.cast("string"), F.lit("10"),
            satellites(F.when(index == 3, 2).otherwise(4)),
        ),
    }
    body = F.coalesce(*[F.when(n % 6 == i, b) for i, b in bodies.items()])
    right = F.lpad(F.hex(checksum(F.col("body"))), 2, "0")
    wrong = F.lpad(F.hex((checksum(F.col("body")) + 1) % 256), 2, "0")
    digits = F.when(n % 50 == 0, "ZZ").when(n % 50 == 1, wrong).otherwise(right)
    rows = events.withColumn("k", k).withColumn("body", body)
    return rows.select(
        user.alias("device_id"), n.alias("seq"), "ts", F.concat(F.lit("$"), "body", F.lit("*"), digits).alias("line")
    )


def gps_chunks(events: DataFrame) -> DataFrame:
    """The same sentences as a device's serial line gives them: rows cut anywhere, each of the rest of one sentence and
    the beginning of the next. Sentence ``event_id`` begins in row ``2 * event_id``; a ninth of them come in three rows.
    ``event_id % 31 = 17`` breaks off after its first half; then noise without a start may follow.
    """
    lines = gps_lines(events)
    n = F.col("seq")
    cut = (1 + n * 7 % F.length("line")).cast("int")
    middle = F.when(n % 9 == 0, (cut + 1 + (F.length("line") - cut) / 2).cast("int")).otherwise(cut)
    whole = F.when(n % 31 == 17, F.left("line", F.length("line") / 2)).otherwise(F.concat("line", F.lit("\r\n")))
    pieces = lines.select("device_id", "seq", "ts", whole.alias("line"), cut.alias("cut"), middle.alias("middle"))
    rest = F.when(n % 31 == 17, F.lit("")).otherwise(F.substring("line", F.col("middle") + 1, F.length("line")))
    pieces = pieces.select(
        "device_id",
        "seq",
        "ts",
        F.substring("line", F.lit(1), F.col("cut")).alias("first"),
        F.substring("line", F.col("cut") + 1, F.col("middle") - F.col("cut")).alias("second"),
        rest.alias("third"),
    )
    order = Window.partitionBy("device_id").orderBy("seq")
    before, last = F.coalesce(F.lag("third").over(order), F.lit("")), F.lead("seq").over(order).isNull()
    rows = pieces.withColumn("before", before).withColumn("end", F.when(last, F.col("third")).otherwise(""))
    row = lambda step, text: F.struct((n * 2 + step).alias("seq"), text.alias("line"))
    noise = F.when(n % 62 == 17, F.lit("\x07 noise, no start")).otherwise("")
    rows = rows.select(
        "device_id",
        "ts",
        F.inline(F.array(row(0, F.concat("before", "first")), row(1, F.concat("second", "end", noise)))),
    )
    return rows.where(F.col("line") != "").select("device_id", "seq", "ts", "line")


def raw_registers(events: DataFrame) -> DataFrame:
    """Each event as one burst of eight register bytes from the device ``user_id``."""
    n, k = F.col("event_id"), _k()
    temp = F.lit(519_888) + (_cents(F.col("value")) * 100).cast("bigint") % 40_000
    press = F.lit(415_148) - (n * 13) % 14_400
    hum = F.lit(20_000) + k.cast("bigint") * 200
    text = F.concat(F.lpad(F.hex(press * 16), 6, "0"), F.lpad(F.hex(temp * 16), 6, "0"), F.lpad(F.hex(hum), 4, "0"))
    return events.select(F.col("user_id").alias("device_id"), n.alias("reading_id"), F.unhex(text).alias("burst"))


#: Typical calibration constants, as in the sensor's data sheet (fixed values).
TYPICAL = dict(
    dig_T1=27504, dig_T2=26435, dig_T3=-1000,
    dig_P1=36477, dig_P2=-10685, dig_P3=3024, dig_P4=2855, dig_P5=140, dig_P6=-7, dig_P7=15500, dig_P8=-14600, dig_P9=6000,
    dig_H1=75, dig_H2=355, dig_H3=0, dig_H4=340, dig_H5=50, dig_H6=30,
)


def calibration(events: DataFrame) -> DataFrame:
    """One row of constants per device; the first two vary a little with the device."""
    vary = {"dig_T1": F.col("device_id") % 100, "dig_P1": F.col("device_id") % 50}
    devices = events.select(F.col("user_id").alias("device_id")).distinct()
    return devices.select(
        "device_id", *[(F.lit(v) + vary.get(c, F.lit(0))).cast("int").alias(c) for c, v in TYPICAL.items()]
    )


#: Constants that have the other sign in devices with an odd number.
TURNED = ["dig_H2", "dig_H4", "dig_H5", "dig_H6"]


def calibration_blocks(events: DataFrame) -> DataFrame:
    """The constants as a sensor holds them: a block of 26 bytes and one of 7."""
    turned = F.when(F.col("device_id") % 2 == 1, -1).otherwise(1)
    rows = calibration(events).withColumns({c: F.col(c) * turned for c in TURNED})

    def byte(c: Column) -> Column:
        return F.lpad(F.hex(F.pmod(c, F.lit(256))), 2, "0")

    def word(name: str) -> list[Column]:
        return [byte(F.col(name)), byte(F.shiftright(name, 8))]

    words = [n for n in TYPICAL if n[4] in "TP"]
    low = F.col("dig_H4").bitwiseAND(F.lit(15)) + F.col("dig_H5").bitwiseAND(F.lit(15)) * 16
    first = [*(b for n in words for b in word(n)), F.lit("00"), byte(F.col("dig_H1"))]
    second = [*word("dig_H2"), byte(F.col("dig_H3")), byte(F.shiftright("dig_H4", 4)), byte(low)]
    second += [byte(F.shiftright("dig_H5", 4)), byte(F.col("dig_H6"))]
    return rows.select("device_id", *[F.unhex(F.concat(*b)).alias(n) for n, b in (("first", first), ("second", second))])
