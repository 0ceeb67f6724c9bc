from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import document, optimized
from pyspark.sql import functions as F

from barograph.operators import readings
from barograph.operators.rollup import SOURCE_INPUT
from barograph.schema import document_schema

V1 = '{"bme280": {"pressure": "1011.5hPa", "temperature": "19.25C", "humidity": "47.5%", "read_datetime": "2024-1-5 06:07:08"}, "picow": {"local_ip": "10.1.2.3", "temperature": 26.5}}'
V3 = '{"bme280": {"read_datetime": "2024-2-29 7:08:09", "altitude": 84.5, "pressure": 1003.125, "temperature": 18.5125, "humidity": 52.0625}, "id": 31415, "picow": {"mem_alloc_bytes": 60000, "free_storage_kb": 409.5, "mem_free_bytes": 90000, "cpu_freq_mhz": 0, "local_ip": "10.9.8.7", "temperature": 28.75}}'
BAD = V3.replace('"10.9.8.7"', "10.9.8.7")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_suffixed_values(log):
    r = only(readings.parse_readings(log(document(7))))
    assert (r.id, r.kafka_offset, r.kafka_partition, r.kafka_topic) == (7, 3, 0, "t")
    assert (r.bme280_temperature, r.bme280_humidity, r.bme280_pressure) == (Decimal("19.25"), Decimal("47.5"), Decimal("1011.5"))
    assert r.picow_temperature == Decimal("24.5") and r.picow_free_storage_kb == 409.5
    assert r.picow_local_ip == "10.0.0.1" and r.read_date == date(2024, 3, 1)
    assert r.spark_process_datetime is not None


def test_event_time_is_the_brokers_and_the_devices_is_kept(log):
    r = only(readings.parse_readings(log(document())).select(F.col("read_datetime").cast("timestamp_ntz"), F.col("device_datetime").cast("timestamp_ntz")))
    assert r[0] == datetime(2024, 3, 1, 10) and r[1] == datetime(2024, 3, 1, 9, 5, 7)


def test_broker_zone(log):
    df = readings.parse_readings(log(document()), ["id", "read_datetime"], broker_zone="America/New_York")
    assert only(df.select(F.col("read_datetime").cast("string")))[0] == "2024-03-01 15:00:00"


def test_plain_numbers(log):
    r = only(readings.parse_readings(log(V3)))
    assert (r.bme280_pressure, r.bme280_temperature, r.bme280_humidity) == (Decimal("1003.125"), Decimal("18.5125"), Decimal("52.0625"))


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (V1, "missing_id"),
        (BAD, "malformed_json"),
        (V3[:60], "malformed_json"),
        ("", "malformed_json"),
        (None, "malformed_json"),
        (document('"x"'), "bad_number"),
        (document("1.0"), "bad_number"),
        (document("3000000000"), "bad_number"),
        (document("null"), "missing_id"),
    ],
)
def test_rejects(log, text, reason):
    messages = log(text)
    assert readings.parse_readings(messages).count() == 0
    assert only(readings.rejects(messages)).reason == reason


@pytest.mark.parametrize("text", ['"--C"', '"C"', '""', "null", "{}"])
def test_unreadable_measure_is_null_and_the_row_stays(log, text):
    r = only(readings.parse_readings(log(document(temperature=text))))
    assert r.bme280_temperature is None and r.bme280_humidity == Decimal("47.5")


def test_wrong_type_spoils_only_its_field(log):
    r = only(readings.parse_readings(log(document(board='"hot"'))))
    assert r.picow_temperature is None and r.picow_local_ip == "10.0.0.1"


def test_more_corner_cases(log):
    df = readings.parse_readings(
        log(document(1, temperature='"-3.50C"'), document(2) + document(3), '{"id": 4, "bme280": {"temperature": "1.5C"}}')
    ).orderBy("kafka_offset")
    a, b, c = df.collect()
    assert a.bme280_temperature == Decimal("-3.5") and b.id == 2
    assert c.id == 4 and c.picow_local_ip is None and c.bme280_pressure is None


def test_readings_and_rejects_are_all_messages(log):
    messages = log(document(0), document(1), document(2), document(3), V1, BAD, V3, None, first=0)
    reasons = [r.reason for r in readings.rejects(messages).orderBy("offset").collect()]
    assert reasons == ["warm_up"] * 3 + ["missing_id", "malformed_json", "malformed_json"]
    assert readings.parse_readings(messages).count() == 2
    assert readings.parse_readings(messages, last_skipped_offset=None).count() == 5
    assert readings.rejects(messages, last_skipped_offset=None).count() == 3


def test_versions(log):
    messages = log(document(1), document(2), V1, V3, BAD, "", document('"x"'))
    got = {r.version: r.messages for r in readings.payload_versions(messages).collect()}
    assert got == {"v2": 2, "v1": 1, "v3": 1, "bad": 2, "other": 1}


def test_the_document_is_parsed_once(log):
    text = optimized(readings.parse_readings(log(document())))
    assert text.count("from_json") == 1


def test_schema_is_narrowed_to_what_is_asked_for(log):
    assert document_schema(SOURCE_INPUT).simpleString() == "struct<id:int,picow:struct<local_ip:string>>"
    assert "pressure" not in optimized(readings.parse_readings(log(document()), SOURCE_INPUT))
    r = only(readings.parse_readings(log(V3), SOURCE_INPUT))
    assert tuple(r) == (31415, "10.9.8.7")
    assert readings.parse_readings(log(BAD), SOURCE_INPUT).count() == 0


def test_cutoff_and_skew(log):
    df = readings.parse_readings(log(document(1), document(2)))
    assert readings.before_date(df, "2024-03-01").count() == 0 and readings.before_date(df, "2024-03-02").count() == 2
    r = only(readings.clock_skew(df))
    assert (r.messages, r.min_skew_us, r.max_skew_us) == (2, 3_293_000_000, 3_294_000_000)
