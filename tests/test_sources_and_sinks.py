"""Files are written and read back. Kafka and JDBC need a broker or a database, which tests do not start: their
options are checked, and that a batch frame is turned into the records that the connector expects."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import csv
import glob

import pytest
from conftest import SMALL, document
from pyspark.sql import functions as F

from barograph.operators import readings, rollup
from barograph.operators.upkeep import mart_upsert
from barograph.plans import hourly_job
from barograph.schema import DOCUMENT, HOURLY_COLUMNS, HOURLY_TABLE, SOURCE_TABLE
from barograph.session import shared_dir
from barograph.sinks import messages as message_sinks
from barograph.sinks import tables as table_sinks
from barograph.sources import events, messages, tables


class Recorder:
    """Stands in for a reader or writer and remembers what it was told."""

    def __init__(self):
        self.told = {}

    def format(self, name):
        self.told["format"] = name
        return self

    mode = lambda self, m: self.option("mode", m)

    def option(self, k, v):
        self.told[k] = v
        return self

    def options(self, **kw):
        self.told |= kw
        return self

    def load(self):
        return self


def test_kafka_options():
    assert messages.kafka_options("h:1", "t") == {"kafka.bootstrap.servers": "h:1", "subscribe": "t"}
    assert messages.kafka_options("h:1", "t", min_partitions=64)["minPartitions"] == "64"
    pinned = messages.kafka_options("h:1", "t", "earliest", '{"t": {"0": 9}}')
    assert (pinned["startingOffsets"], pinned["endingOffsets"]) == ("earliest", '{"t": {"0": 9}}')


def test_records_to_publish(log):
    df = message_sinks.payload_rows(log(document(1)))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("key", "binary"), ("value", "binary")]
    r = df.first()
    assert r.key is None and bytes(r.value) == document(1).encode()


def test_documents_survive_writing_and_parsing(log, spark):
    docs = log(document(5)).select(F.from_json(F.col("value").cast("string"), DOCUMENT).alias("d"))
    again = docs.select(message_sinks.document_bytes(F.col("d")).alias("value")).select(F.from_json(F.col("value").cast("string"), DOCUMENT).alias("d"))
    assert again.first() == docs.first()


def test_jdbc_writer_options():
    class Frame:
        write = Recorder()

    options = tables.jdbc_options("jdbc:x:y", "t", "a.Driver", "u", "p", rewriteBatchedStatements="true")
    told = table_sinks.jdbc_writer(Frame, options, connections=3).told
    assert told["format"] == "jdbc" and told["mode"] == "overwrite" and told["truncate"] == "true"
    assert (told["numPartitions"], told["dbtable"], told["driver"], told["user"], told["password"]) == ("3", "t", "a.Driver", "u", "p")
    assert told["rewriteBatchedStatements"] == "true"


def test_jdbc_reader_options(monkeypatch):
    monkeypatch.setattr(tables, "pin_utc", lambda spark: spark)

    class Session:
        read = Recorder()

    told = tables.read_jdbc(Session, {"url": "u", "dbtable": "t"}, "year", (2020, 2030), 4).told
    assert (told["partitionColumn"], told["lowerBound"], told["upperBound"], told["numPartitions"]) == ("year", "2020", "2030", "4")
    Session.read = Recorder()
    assert tables.load_hourly(Session, {"url": "u"}).told["dbtable"] == HOURLY_TABLE
    assert tables.load_by_source(Session, {"url": "u"}).told["dbtable"] == SOURCE_TABLE


def test_catalog_probe(spark):
    listing = spark.createDataFrame([("data", "a"), ("other", "b")], "TABLE_SCHEMA string, TABLE_NAME string")
    assert tables.table_exists(listing, "data", "a") and not tables.table_exists(listing, "data", "b")
    fresh = spark.range(3)
    assert tables.stored_or_fresh(spark, "no_such_table", fresh) is fresh
    spark.range(5).createOrReplaceTempView("stored_view")
    assert tables.stored_or_fresh(spark, "stored_view", fresh).count() == 5


def test_job_lands_once_and_writes_both_tables(spark, folder):
    log = events.messages(spark, SMALL)
    marts = hourly_job.run(spark, log, folder, keep_rejects=True)
    assert marts.readings == 974
    hourly, by_source = tables.load_hourly(spark, folder), tables.load_by_source(spark, folder)
    assert hourly.columns == HOURLY_COLUMNS
    want = rollup.hourly_rollup(readings.parse_readings(log, rollup.HOURLY_INPUT))
    assert sorted(hourly.collect()) == sorted(want.collect())
    assert by_source.agg(F.sum("messages")).first()[0] == hourly.agg(F.sum("count")).first()[0] == 974
    assert spark.read.parquet(f"{folder}/rejects").count() == 1000 - 974
    # the tables are built from landed readings: nothing is parsed again, and a day's folder is all that is read
    plan = marts.hourly._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "ReadSchema" in plan
    day = spark.read.parquet(f"{folder}/readings").where(F.col("read_date") == "2024-01-05")
    assert "PartitionFilters: [isnotnull(read_date" in day._jdf.queryExecution().executedPlan().toString()


def test_command_line(spark, folder):
    events.messages(spark, SMALL).write.parquet(f"{folder}/log")
    hourly_job.main(["--log", f"{folder}/log", "--out", f"{folder}/out/"])
    assert tables.load_hourly(spark, f"{folder}/out").count() == 527


def test_only_the_given_days_are_replaced(spark, folder):
    path = f"{folder}/hourly"
    hourly = rollup.hourly_rollup(readings.parse_readings(events.messages(spark, SMALL), rollup.HOURLY_INPUT))
    table_sinks.overwrite_days(hourly, path)
    stored = spark.read.parquet(path).select(*HOURLY_COLUMNS)
    fresh = stored.where("date = '2024-01-03' AND hour < 12").withColumn("count", F.lit(0).cast("bigint"))
    changed = mart_upsert(stored.where("date = '2024-01-03'"), fresh)
    before = stored.where("date <> '2024-01-03'").count()
    table_sinks.overwrite_days(changed, path)
    after = spark.read.parquet(path)
    assert after.where("date <> '2024-01-03'").count() == before
    assert after.where("date = '2024-01-03'").agg(F.sum(F.when(F.col("hour") < 12, F.col("count")))).first()[0] == 0


def test_csv_is_one_file_with_a_header(spark, folder):
    table_sinks.export_csv(spark.createDataFrame([("a", 1), (None, 2)], "source_ip string, messages long"), f"{folder}/csv")
    (file,) = glob.glob(f"{folder}/csv/*.csv")
    assert list(csv.reader(open(file))) == [["source_ip", "messages"], ["a", "1"], ["", "2"]]


def test_rows_are_counted_while_written(spark, folder):
    df, seen = message_sinks.counted(spark.range(12), "written")
    table_sinks.overwrite_parquet(df, f"{folder}/t")
    assert seen.get == {"rows": 12}


class Cluster:
    """A session on a cluster, with or without the setting."""

    class sparkContext:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    def __init__(self, **settings):
        self.conf = self
        self.get = lambda name, default=None: settings.get(name.replace(".", "_"), default)


def test_shared_folder_comes_from_the_session(spark):
    cluster = Cluster(spark_checkpoint_dir="hdfs:///shared/")
    assert shared_dir(cluster, "x").startswith("hdfs:///shared/barograph/x-")
    assert shared_dir(cluster, "x") != shared_dir(cluster, "x")
    assert "/barograph/x-" in shared_dir(spark, "x")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster(), "x")


def test_the_job_starts_from_any_folder(tmp_path):
    script = Path(__file__).resolve().parents[1] / "barograph/plans/hourly_job.py"
    done = subprocess.run([sys.executable, str(script), "--help"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "--min-partitions" in done.stdout
