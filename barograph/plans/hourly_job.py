"""The hourly job: read the log once, land the readings, build both result tables from what was landed.

``spark-submit barograph/plans/hourly_job.py --log PATH --out PATH`` or ``--servers HOST:PORT --topic NAME``.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# started by its file name, a script has only its own folder to import from
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from barograph.operators import offsets  # noqa: E402
from barograph.operators.readings import READING_COLUMNS, parse_readings, rejects  # noqa: E402
from barograph.operators.rollup import hourly_rollup, messages_by_source  # noqa: E402
from barograph.schema import HOURLY_TABLE, MESSAGES, SOURCE_TABLE  # noqa: E402
from barograph.session import pin_utc  # noqa: E402
from barograph.sinks import versions  # noqa: E402
from barograph.sinks.messages import counted  # noqa: E402
from barograph.sinks.tables import jdbc_writer, overwrite_parquet  # noqa: E402
from barograph.sources.messages import read_log, read_topic  # noqa: E402


@dataclass(frozen=True)
class Marts:
    hourly: DataFrame
    by_source: DataFrame
    readings: int


def land_readings(messages: DataFrame, path: str) -> int:
    """Parse once and write the readings by day; days too big for one task are split, small ones put together."""
    rows, seen = counted(parse_readings(messages, READING_COLUMNS), "landed_readings")
    rows.hint("rebalance", "read_date").write.mode("overwrite").partitionBy("read_date").parquet(path)
    return seen.get["rows"]


def build_marts(spark: SparkSession, messages: DataFrame, readings_path: str) -> Marts:
    n = land_readings(messages, readings_path)
    landed = spark.read.parquet(readings_path)
    return Marts(hourly_rollup(landed), messages_by_source(landed), n)


def run(
    spark: SparkSession, messages: DataFrame, out: str, jdbc: dict[str, str] | None = None, keep_rejects: bool = False
) -> Marts:
    """Both tables replaced, as Parquet below ``out`` or over JDBC; readings (and rejects) land below ``out``."""
    marts = build_marts(spark, messages, f"{out}/readings")
    for name, table in ((HOURLY_TABLE, marts.hourly), (SOURCE_TABLE, marts.by_source)):
        if jdbc:
            jdbc_writer(table, {**jdbc, "dbtable": name}).save()
        else:
            overwrite_parquet(table, f"{out}/{name}")
    if keep_rejects:
        overwrite_parquet(rejects(messages), f"{out}/rejects")
    return marts


OFFSETS, READINGS = "offsets", "readings"


def run_incremental(spark: SparkSession, messages: DataFrame, out: str, last_skipped_offset: int | None = 2) -> Marts:
    """Adds what no earlier run has read to the tables below ``out`` and switches them to it at once.

    The run's extent is measured first and read up to there. Its readings are added to their days; of the hourly table
    only the days concerned are computed anew, from all readings of these days; counts per source are added up. The
    ledger of offsets is switched with the tables: a run that dies leaves them as they were, and is simply run again.
    Older hours stay, whatever part of the log is handed in. ``load_versioned`` reads the tables.
    """
    old = versions.current(spark, out)
    run = f"{old.number + 1:08d}-{uuid4().hex[:8]}"
    fresh = offsets.unread(messages, _ledger(spark, out, old))
    extent = offsets.extent(fresh).withColumn("taken_by", F.lit(run))
    read = versions.stage(extent, out, OFFSETS, "taken_by", run)
    if not read:
        return _versioned(spark, out, old, 0)
    bounds = versions.read(spark, out, versions.Version(0, tuple(read)), OFFSETS, extent.schema)
    rows = parse_readings(offsets.within(fresh, bounds), READING_COLUMNS, last_skipped_offset)
    landed = versions.stage(rows, out, READINGS, "read_date", run)
    own = versions.Version(0, tuple(landed))
    days = own.parts(READINGS)
    whole = versions.read(spark, out, old.with_folders(landed), READINGS, rows.schema, days)
    hourly = versions.stage(hourly_rollup(whole), out, HOURLY_TABLE, "date", run)

    mine = versions.read(spark, out, own, READINGS, rows.schema)
    added = messages_by_source(mine)
    before = versions.read(spark, out, old, SOURCE_TABLE, added.schema)
    total = before.unionByName(added).groupBy("source_ip").agg(F.sum("messages").alias("messages"))
    sources = versions.stage(total.withColumn("part", F.lit("all")), out, SOURCE_TABLE, "part", run)
    new = old.with_folders([*read, *landed, *hourly, *sources], replaced=[HOURLY_TABLE, SOURCE_TABLE])
    versions.switch(spark, out, new)
    # how many rows its own files have is in their footers
    return _versioned(spark, out, new, mine.count())


def _ledger(spark: SparkSession, out: str, version: versions.Version) -> DataFrame:
    return versions.read(spark, out, version, OFFSETS, T.StructType.fromDDL(f"{offsets.EXTENT}, taken_by string"))


def _versioned(spark: SparkSession, out: str, version: versions.Version, readings: int) -> Marts:
    none = parse_readings(spark.createDataFrame([], MESSAGES), READING_COLUMNS)
    hourly = versions.read(spark, out, version, HOURLY_TABLE, hourly_rollup(none).schema)
    return Marts(hourly, versions.read(spark, out, version, SOURCE_TABLE, messages_by_source(none).schema), readings)


def load_versioned(spark: SparkSession, out: str) -> Marts:
    """Both tables as the last finished run left them, with no new readings."""
    return _versioned(spark, out, versions.current(spark, out), 0)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """What each finished run has read."""
    return _ledger(spark, out, versions.current(spark, out))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--log", help="folder of a landed log")
    p.add_argument("--servers")
    p.add_argument("--topic")
    p.add_argument("--starting", help="offsets to start from; pins the run to a part of the topic")
    p.add_argument("--ending", help="offsets to stop at; with it, readings and rejects are of one snapshot")
    p.add_argument("--min-partitions", type=int)
    p.add_argument("--out", required=True)
    p.add_argument("--jdbc-url")
    p.add_argument("--jdbc-driver")
    p.add_argument("--jdbc-user")
    p.add_argument("--jdbc-password")
    p.add_argument("--keep-rejects", action="store_true")
    p.add_argument("--incremental", action="store_true", help="add to the tables what no earlier run has read, instead of replacing them")
    a = p.parse_args(argv)
    if a.incremental and (a.jdbc_url or a.keep_rejects):
        p.error("--incremental keeps its tables below --out, without rejects")
    if a.starting and not a.incremental:
        p.error("--starting reads a part of the topic, which would replace the whole tables: add --incremental")
    spark = pin_utc(SparkSession.builder.appName("hourly").getOrCreate())
    starting = a.starting
    if a.incremental and not starting:
        starting = offsets.starting_offsets(ledger(spark, a.out.rstrip("/")))
    messages = read_log(spark, a.log) if a.log else read_topic(spark, a.servers, a.topic, starting, a.ending, a.min_partitions)
    if a.incremental:
        run_incremental(spark, messages, a.out.rstrip("/"))
        return
    jdbc = None
    if a.jdbc_url:
        jdbc = {"url": a.jdbc_url, "driver": a.jdbc_driver, "user": a.jdbc_user, "password": a.jdbc_password}
        jdbc = {k: v for k, v in jdbc.items() if v is not None}
    run(spark, messages, a.out.rstrip("/"), jdbc, a.keep_rejects)


if __name__ == "__main__":
    main()
