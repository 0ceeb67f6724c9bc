"""Every query by name. Each one reads the whole ``events`` table and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.functions.values import naive, size_text, strip_unit
from barograph.operators import calibration, dashboard, filters, gps, live, monitor, offsets, profile, readings, rollup, sketches, upkeep
from barograph.plans import hourly_job
from barograph.plans.hourly_job import build_marts
from barograph.schema import HOUR_KEY, HOURLY_COLUMNS, HOURLY_TABLE
from barograph.session import shared_dir
from barograph.sinks.tables import export_csv, overwrite_parquet
from barograph.sources import events
from barograph.sources.messages import read_log, stream_log
from barograph.sources.tables import load_hourly, stored_or_fresh, tables_of_schema
from barograph.streaming import calibrated, changes, devices, hourly, landing, last_points, late, progress, receiver
from barograph.streaming import live as live_streams

Query = Callable[[SparkSession, str], DataFrame]

PARSED_COLUMNS = [c for c in readings.READING_COLUMNS if c != "spark_process_datetime"]
PROFILED = ["date", "year", "month", "day", "hour", "count", "avg_bme_temp", "max_bme_hum", "min_bme_press"]


def plain(df: DataFrame) -> DataFrame:
    """Times without zone and numbers as DOUBLE, as both engines return them."""

    def column(f: T.StructField):
        if isinstance(f.dataType, T.TimestampType):
            return naive(F.col(f.name)).alias(f.name)
        return F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)

    return df.select(*[column(f) for f in df.schema])


def _readings(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return readings.parse_readings(events.messages(spark, sf_dir), columns)


def _landed(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: what is used more than once is parsed once."""
    out = shared_dir(spark, name)
    overwrite_parquet(df, out)
    return spark.read.schema(df.schema).parquet(out)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.hourly_rollup(_readings(spark, sf_dir, rollup.HOURLY_INPUT))


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.messages_by_source(_readings(spark, sf_dir, rollup.SOURCE_INPUT))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_projection(events.messages(spark, sf_dir))


def _gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.gps_lines(events.read_events(spark, sf_dir))


def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(rollup.newest_first(_hourly(spark, sf_dir)))


def hourly_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's unrounded parts merged into those of the time before: the same table as in one go."""
    rows = _landed(spark, _readings(spark, sf_dir, rollup.HOURLY_INPUT), "hourly_merged")
    cut = rows.agg(F.max("read_datetime")).scalar() - F.expr("INTERVAL 1 DAY")
    before, after = (rows.where(c) for c in (F.col("read_datetime") <= cut, F.col("read_datetime") > cut))
    parts = rollup.hourly_parts(before).unionByName(rollup.hourly_parts(after))
    return plain(rollup.finish_hours(rollup.merge_parts(parts)))


def hourly_job_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's hourly table from the readings that it landed, and how many these are."""
    marts = build_marts(spark, events.messages(spark, sf_dir), f"{shared_dir(spark, 'hourly_job_marts')}/readings")
    return plain(marts.hourly).withColumn("landed", F.lit(marts.readings).cast("bigint"))


def _three_runs(spark: SparkSession, sf_dir: str) -> str:
    """The job run on three parts of the log that overlap: its first half, the middle half, all of it."""
    out = shared_dir(spark, "three_runs")
    log = events.messages(spark, sf_dir)
    end = log.agg(F.max("offset")).scalar()
    at = F.col("offset")
    for part in (log.where(at * 2 < end), log.where((at * 4 >= end) & (at * 4 < end * 3)), log):
        hourly_job.run_incremental(spark, part, out)
    return out


def hourly_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly table after three runs, each of which adds what the ones before have not read."""
    return plain(hourly_job.load_versioned(spark, _three_runs(spark, sf_dir)).hourly)


def offset_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the three runs has read: every offset once."""
    ledger = hourly_job.ledger(spark, _three_runs(spark, sf_dir))
    return ledger.select("*", F.left("taken_by", F.lit(8)).cast("int").alias("run")).drop("taken_by")


def missing_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holes of a log that has lost some stretches."""
    return offsets.missing(events.messages(spark, sf_dir).where("offset % 101 not in (50, 51, 52) and offset % 1009 <> 7"))


def hourly_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly table written and read back."""
    out = shared_dir(spark, "hourly_stored")
    overwrite_parquet(_hourly(spark, sf_dir), f"{out}/{HOURLY_TABLE}")
    return plain(load_hourly(spark, out))


def sources_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table per source as the CSV file that a viewer downloads."""
    rows, out = _by_source(spark, sf_dir), shared_dir(spark, "sources_exported")
    export_csv(rows, out)
    return spark.read.schema(rows.schema).option("header", True).csv(out)


def datetimes_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column of times becomes one of times, another text stays, and a time loses its zone."""
    rows = _hourly(spark, sf_dir)
    label = F.concat(F.lit("h"), "hour").alias("label")
    return filters.coerce_datetimes(rows.select("datetime", F.col("datetime").cast("string").alias("seen"), label))


def messages_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(spark, sf_dir)


def parsed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_readings(spark, sf_dir, PARSED_COLUMNS))


def reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.reject_report(events.messages(spark, sf_dir))


def payload_version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.payload_versions(events.messages(spark, sf_dir))


def device_clock_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.clock_skew(_readings(spark, sf_dir, ["id", "read_datetime", "device_datetime", "picow_local_ip"]))


def hour_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.hour_headline(_hourly(spark, sf_dir))


def hour_delta_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.hour_delta_series(_hourly(spark, sf_dir))


def source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.source_share(_by_source(spark, sf_dir))


def heatmap_date_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.heatmap_date_hour(_hourly(spark, sf_dir))


def heatmap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.heatmap_matrix(_hourly(spark, sf_dir), "avg_picow_temp")


def heatmap_weekday_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.heatmap_weekday_hour(_hourly(spark, sf_dir))


def metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(dashboard.metric_long(_hourly(spark, sf_dir), "datetime", dashboard.LINE_METRICS))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(_hourly(spark, sf_dir), PROFILED)


def sketch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile from merged daily sketches: what is exact, and whether its estimates are as near as is stated."""
    columns = ["id", "bme280_temperature"]
    rows = _readings(spark, sf_dir, ["read_date", *columns])
    merged = sketches.merged_profile(_landed(spark, sketches.daily_sketches(rows, F.col("read_date"), columns), "sketches"))
    merged = _landed(spark, merged, "sketch_profile")
    values = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null")
    counts = values.join(merged, "column").groupBy("column").agg(
        F.count_distinct("value").alias("different"),
        *[(F.count_if(F.col("value") < F.col(q)) / F.count("*")).alias(f"below_{q}") for q in ("q25", "q50", "q75")],
        *[(F.count_if(F.col("value") <= F.col(q)) / F.count("*")).alias(f"upto_{q}") for q in ("q25", "q50", "q75")],
    )
    # four standard errors of the sketch of different values; the stated error in rank
    distinct_close = F.abs(F.col("n_distinct") / F.col("different") - 1) < 0.0325
    near = [(F.col(f"below_q{p}") <= p / 100 + 0.01) & (F.col(f"upto_q{p}") >= p / 100 - 0.01) for p in (25, 50, 75)]
    both = merged.join(counts, "column")
    return both.select("column", "rows", "n_null", "low", "high", distinct_close.alias("distinct_close"), (near[0] & near[1] & near[2]).alias("quartiles_close"))


def hourly_in_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly table by its name in the session's catalog, where it is found instead of the fresh frame beside it."""
    rows, name = _landed(spark, _hourly(spark, sf_dir), "hourly_in_catalog"), "barograph_hourly_in_catalog"
    assert stored_or_fresh(spark, name, rows) is rows
    rows.createOrReplaceTempView(name)
    found = stored_or_fresh(spark, name, rows.limit(0))
    spark.catalog.dropTempView(name)
    return plain(found)


def tables_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema's names in a catalog listing that has a schema for each day and a table for each source heard on it."""
    rows = _readings(spark, sf_dir, ["id", "read_date", "picow_local_ip"])
    listing = rows.select(F.col("read_date").cast("string").alias("TABLE_SCHEMA"), F.concat(F.lit("from_"), "picow_local_ip").alias("TABLE_NAME"))
    return tables_of_schema(listing.distinct(), "2024-01-10")


def filter_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No filter leaves every row."""
    return plain(filters.apply_filters(_hourly(spark, sf_dir), []))


def filter_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(filters.apply_filters(_hourly(spark, sf_dir), [filters.OneOf("hour", [0, 6, 12, 18, None])]))


def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(filters.apply_filters(_hourly(spark, sf_dir), [filters.Between("avg_bme_temp", 40.0, 60.0)]))


def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filters.DateBetween("datetime", "2024-01-05", "2024-01-12")
    return plain(filters.apply_filters(_hourly(spark, sf_dir), [chosen]))


def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(_by_source(spark, sf_dir), [filters.Matches("source_ip", r"\.1\.\d*[05]$")])


def filter_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each filter comes from the rows that the filters before it left."""
    choices = [
        filters.Choice("year"),
        filters.Choice("hour", low=6, high=20),
        filters.Choice("datetime", dates=("2024-01-03", "2024-01-25")),
        filters.Choice("avg_bme_temp", low=45.0, high=55.0),
    ]
    return plain(filters.filter_by_choice(_landed(spark, _hourly(spark, sf_dir), "filter_composed"), choices))


def date_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["kafka_offset", "id", "read_datetime", "read_date", "bme280_temperature", "picow_local_ip"]
    return plain(readings.before_date(_readings(spark, sf_dir, columns), "2024-01-14"))


def live_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_live(spark, sf_dir))


def last_30_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(live.last_points(_live(spark, sf_dir)))


def last_30_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(live.last_points_per_source(_live(spark, sf_dir)))


def latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(live.latest_reading(_live(spark, sf_dir)))


def latest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.latest_source(_live(spark, sf_dir))


def humidity_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(live.humidity_gauge(_live(spark, sf_dir)))


def memory_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.memory_split(_live(spark, sf_dir))


def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir, ["kafka_offset", "id", "picow_mem_alloc_bytes", "picow_mem_free_bytes"])
    return rows.select(
        "kafka_offset",
        size_text(F.col("picow_mem_alloc_bytes")).alias("allocated"),
        size_text(F.col("picow_mem_free_bytes") * F.lit(1024.0 * 64)).alias("free_times_64k"),
    )


def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir, ["id", "read_datetime", "picow_local_ip"])
    return plain(monitor.source_freshness(rows, threshold=6 * 3600))


def topic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(monitor.topic_profile(events.messages(spark, sf_dir)))


def cadence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["id", "read_datetime", "picow_local_ip", "kafka_partition", "kafka_offset"]
    return plain(monitor.cadence_gaps(_readings(spark, sf_dir, columns), factor=1800.0))


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.top_sources(_by_source(spark, sf_dir))


def _stored_and_fresh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    """The table as a run 90 minutes ago left it, a run over what a week's retention still holds, and where that begins."""
    rows = _landed(spark, _readings(spark, sf_dir, rollup.HOURLY_INPUT), "stored_and_fresh")
    newest = rows.agg(F.max("read_datetime")).scalar()
    at = F.col("read_datetime")
    stored = rollup.hourly_rollup(rows.where(at <= newest - F.expr("INTERVAL 90 MINUTES")))
    begin = F.date_trunc("hour", newest - F.expr("INTERVAL 7 DAYS"))
    return stored, rollup.hourly_rollup(rows.where(at >= begin)), begin


def mart_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, fresh, _ = _stored_and_fresh(spark, sf_dir)
    return plain(upkeep.mart_match(stored, fresh))


def mart_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.mart_diff(*_stored_and_fresh(spark, sf_dir))


def mart_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(upkeep.mart_upsert(*_stored_and_fresh(spark, sf_dir)))


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "stream_hourly")
    rows = hourly.hourly_stream(events.message_stream(spark, sf_dir))
    keys = ["year", "month", "day", "hour"]
    changes.run_available(changes.change_writer(rows, f"{out}/changes", f"{out}/checkpoint", keys))
    return plain(changes.current_rows(spark, f"{out}/changes", rows.schema, keys).select(*HOURLY_COLUMNS))


def _late_stream(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A stream over a log of several files, of which the last brings a tenth of all messages too late for it."""
    out = shared_dir(spark, "late_stream")
    arrived = events.arrived_log(spark, sf_dir, f"{out}/arrived")
    rows = hourly.hourly_stream(stream_log(spark, *arrived))
    changes.run_available(changes.change_writer(rows, f"{out}/changes", f"{out}/checkpoint", HOUR_KEY))
    changes.run_available(late.log_writer(stream_log(spark, *arrived), out, f"{out}/landing"))
    return out, changes.current_rows(spark, f"{out}/changes", rows.schema, HOUR_KEY).select(*HOURLY_COLUMNS)


def late_hours_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's own table: what came after the watermark is missing from it."""
    return plain(_late_stream(spark, sf_dir)[1])


def late_hours_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table after the hours that the ledger names were computed anew; a second repair finds none."""
    out, streamed = _late_stream(spark, sf_dir)
    while late.repair(spark, out):
        pass
    return plain(late.repaired_table(spark, out, streamed))


def stream_last_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "stream_last_30")
    stream = events.message_stream(spark, sf_dir)
    changes.run_available(last_points.points_writer(stream, f"{out}/points", f"{out}/checkpoint", per_source=False))
    return plain(last_points.written_points(spark, f"{out}/points", per_source=False))


def stream_last_30_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "stream_last_30_per_source")
    stream = events.message_stream(spark, sf_dir)
    changes.run_available(last_points.points_writer(stream, f"{out}/points", f"{out}/checkpoint"))
    return plain(last_points.written_points(spark, f"{out}/points"))


def stream_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 points from the state store, after a stream over a log of several files that come out of order."""
    out = shared_dir(spark, "stream_buffer")
    log = stream_log(spark, *events.arrived_log(spark, sf_dir, f"{out}/arrived"))
    rows = last_points.last_points_stream(log, per_source=True)
    keys = last_points.buffer_keys(per_source=True)
    changes.run_available(changes.change_writer(rows, f"{out}/changes", f"{out}/checkpoint", keys))
    return plain(last_points.buffered_points(changes.current_rows(spark, f"{out}/changes", rows.schema, keys), per_source=True))


def device_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each device came and went: offline by a timer, after six hours of silence."""
    out = shared_dir(spark, "device_status_changes")
    log = stream_log(spark, *events.arrived_log(spark, sf_dir, f"{out}/arrived", late_ones=False))
    found = devices.status_changes(readings.parse_readings(log, ["id", "read_datetime", "picow_local_ip"]), 6 * 3600)
    writer = found.writeStream.format("parquet").option("path", f"{out}/changes").option("checkpointLocation", f"{out}/checkpoint")
    changes.run_available(writer.outputMode("append"))
    return plain(spark.read.schema(found.schema).parquet(f"{out}/changes"))


def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed from a log of several files that brings some messages twice; a second run must add nothing."""
    out = shared_dir(spark, "stream_landing")
    arrived = events.repeated_log(spark, sf_dir, f"{out}/arrived")
    for _ in range(2):
        stream = stream_log(spark, *arrived)
        changes.run_available(landing.landing_writer(stream, f"{out}/log", f"{out}/checkpoint"))
    return plain(monitor.topic_profile(landing.without_repeats(read_log(spark, f"{out}/log"))))


def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "stream_live")
    stream = events.message_stream(spark, sf_dir)
    changes.run_available(live_streams.live_writer(stream, f"{out}/rows", f"{out}/checkpoint"))
    return plain(spark.read.schema(live.live_projection(stream).schema).parquet(f"{out}/rows"))


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text lines of the live page, written by a stream over a log of several files that come out of order."""
    out = shared_dir(spark, "stream_lines")
    log = stream_log(spark, *events.arrived_log(spark, sf_dir, f"{out}/arrived"))
    changes.run_available(live_streams.line_writer(log, f"{out}/rows", f"{out}/checkpoint"))
    return plain(spark.read.schema(live.event_lines(live.live_projection(log)).schema).parquet(f"{out}/rows"))


def stream_live_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rows of a stream that brings some messages twice, in one batch or in two."""
    out = shared_dir(spark, "stream_live_once")
    log = stream_log(spark, *events.repeated_log(spark, sf_dir, f"{out}/arrived"))
    once = live_streams.without_repeats(log, "2 hours")
    changes.run_available(live_streams.live_writer(once, f"{out}/rows", f"{out}/checkpoint"))
    return plain(spark.read.schema(live.live_projection(once).schema).parquet(f"{out}/rows"))


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch took in and gave out: readings and rejects together are the messages."""
    out = shared_dir(spark, "stream_progress")
    log = stream_log(spark, *events.arrived_log(spark, sf_dir, f"{out}/arrived"))
    changes.run_available(progress.counted_writer(log, out, f"{out}/checkpoint"))
    return plain(spark.read.schema(progress.COUNTS).parquet(f"{out}/counts"))


def stream_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings calibrated as they arrive; the constants are replaced in the middle, and the new ones hold from then on."""
    out = shared_dir(spark, "stream_calibrated")
    constants = events.calibration(events.read_events(spark, sf_dir))
    first = T.StructType([T.StructField("device_id", T.LongType()), T.StructField("reading_id", T.LongType()), T.StructField("burst", T.BinaryType())])
    for parts, shift in ((range(2), 0), (range(2, events.ARRIVALS), 10)):
        overwrite_parquet(constants.withColumn("dig_T1", F.col("dig_T1") + shift), f"{out}/constants")
        files = events.arrived_bursts(spark, sf_dir, f"{out}/arrived", parts)
        bursts = spark.readStream.schema(first).option("maxFilesPerTrigger", files).parquet(f"{out}/arrived")
        changes.run_available(calibrated.calibrated_writer(bursts, f"{out}/constants", f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows").drop("batch")


def nmea_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps.sentence_quality(_gps(spark, sf_dir))


def nmea_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps.fixes(_gps(spark, sf_dir))


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in rows cut anywhere, put together again."""
    return gps.rejoined(events.gps_chunks(events.read_events(spark, sf_dir)))


def nmea_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence quality of a log whose rows are cut anywhere, some sentences broken off: the others count as if whole."""
    return gps.sentence_quality(_chunked(spark, sf_dir))


def nmea_chunk_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from the same log; a sentence is known by the row that it begins in."""
    return gps.fixes(_chunked(spark, sf_dir)).withColumn("seq", F.expr("seq div 2"))


def nmea_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps.readouts(_gps(spark, sf_dir).drop("ts"))


def nmea_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps.track(_gps(spark, sf_dir), hour_offset=5)


RECEIVER_COLUMNS = ["altitude", "geoid_height", "satellites_in_use", "hdop", "pdop", "vdop", "fix_stat", "fix_type"]
RECEIVER_COLUMNS += ["satellites_used", "satellites_in_view", "sv_sentences", "sv_sentence"]


def nmea_receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = gps.receiver_state(_gps(spark, sf_dir).drop("ts"), columns=RECEIVER_COLUMNS)
    return state.withColumn("satellites_used", F.array_join("satellites_used", " "))


def nmea_receiver_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over several files, in which every seventh sentence comes a file late."""
    out = shared_dir(spark, "nmea_receiver_stream")
    lines = _gps(spark, sf_dir).drop("ts")
    step, files = events.arrived_lines(lines, f"{out}/arrived")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/arrived")
    changes.run_available(receiver.receiver_writer(stream, f"{out}/tables", f"{out}/checkpoint", 2 * step, columns=RECEIVER_COLUMNS))
    state = receiver.written_states(lines, f"{out}/tables", RECEIVER_COLUMNS, to_the_end=True)
    return state.withColumn("satellites_used", F.array_join("satellites_used", " "))


def nmea_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps.satellite_groups(_gps(spark, sf_dir).drop("ts"))


def _calibrated(spark: SparkSession, sf_dir: str, t2_preshift: bool = True) -> DataFrame:
    rows = events.read_events(spark, sf_dir)
    raw = calibration.unpack_readings(events.raw_registers(rows))
    return calibration.calibrate(raw, events.calibration(rows), t2_preshift)


def calibration_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.unpack_constants(events.calibration_blocks(events.read_events(spark, sf_dir)))


def calibrated_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir)


def calibrated_datasheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, t2_preshift=False)


def calibrate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with units read back by the parse: what a device sends is what the pipeline computes with."""
    units = {"temperature": "C", "pressure": "hPa", "humidity": "%"}
    rows = _calibrated(spark, sf_dir)
    return rows.select("reading_id", *[strip_unit(F.col(f"{n}_text"), u).cast("double").alias(n) for n, u in units.items()])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        hourly_rollup, hourly_merged, messages_by_source, parsed_readings, reject_report, payload_version_counts,
        device_clock_skew, hour_headline, hour_delta_series, source_share, heatmap_date_hour, heatmap_matrix,
        heatmap_weekday_hour, metric_long, column_profile, sketch_profile, hourly_in_catalog, tables_listed, filter_none, filter_isin, filter_range, filter_dates, filter_regex,
        filter_composed, date_cutoff, live_projection, last_30_points, last_30_per_source, latest_reading, latest_source,
        humidity_band, memory_split, size_texts, source_freshness, topic_profile, cadence_gaps, top_sources, mart_match,
        mart_diff, mart_upsert, stream_hourly, late_hours_lost, late_hours_repaired, stream_last_30, stream_last_30_per_source, stream_buffer, stream_landing, stream_live,
        stream_lines, stream_live_once, stream_progress, stream_calibrated, device_status_changes,
        nmea_quality, nmea_fixes, nmea_chunks, nmea_chunk_fixes, nmea_readouts, nmea_track, nmea_receiver, nmea_receiver_stream, nmea_satellites, calibrated_readings, calibrated_datasheet,
        calibrate_roundtrip, calibration_unpacked, hourly_job_marts, hourly_incremental, offset_ledger, missing_offsets, hourly_stored, sources_exported, datetimes_coerced,
    )
}

