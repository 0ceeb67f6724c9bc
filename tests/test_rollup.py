from __future__ import annotations

from datetime import date

import pytest
from conftest import SMALL, document, optimized, plan
from pyspark.sql import functions as F

from barograph.operators import readings, rollup
from barograph.schema import HOURLY_COLUMNS
from barograph.sources import events


@pytest.fixture
def parsed(spark):
    return readings.parse_readings(events.messages(spark, SMALL), [*rollup.HOURLY_INPUT, "picow_local_ip"])


def test_columns_and_order(spark, parsed):
    hourly = rollup.newest_first(rollup.hourly_rollup(parsed))
    assert hourly.columns == HOURLY_COLUMNS
    keys = [(r.year, r.month, r.day, r.hour) for r in hourly.collect()]
    assert keys == sorted(keys, reverse=True) and len(set(keys)) == len(keys)


def test_values_of_one_hour(log):
    texts = [document(i, temperature=f'"{t}C"') for i, t in enumerate(["10.00", "10.01", "20.50"])]
    r = rollup.hourly_rollup(readings.parse_readings(log(*texts, document(9, temperature='"--"')))).first()
    assert (r["count"], r.date, r.hour) == (4, date(2024, 3, 1), 10)
    # the unreadable value takes no part: (10.00 + 10.01 + 20.50) / 3 = 13.503...
    assert (r.min_bme_temp, r.avg_bme_temp, r.max_bme_temp) == (10.0, 13.5, 20.5)


def test_ties_round_up_whatever_the_order_of_rows(log, spark):
    # the mean of 0.01 and 0.02 is 0.015: up to 0.02, which binary floating point gets wrong for some of these
    for low in (1, 3, 57, 1001):
        texts = [document(1, temperature=f'"{low / 100:.2f}C"'), document(2, temperature=f'"{(low + 1) / 100:.2f}C"')]
        for t in (texts, texts[::-1]):
            assert rollup.hourly_rollup(readings.parse_readings(log(*t))).first().avg_bme_temp == (low + 1) / 100


def test_row_order_and_partitions_do_not_matter(parsed):
    want = sorted(rollup.hourly_rollup(parsed).collect())
    assert sorted(rollup.hourly_rollup(parsed.repartition(7).orderBy(F.rand(3))).collect()) == want


def test_parts_of_any_split_merge_exactly(parsed):
    want = sorted(rollup.hourly_rollup(parsed).collect())
    split = [parsed.where(c) for c in (F.hash("id") % 3 == 0, F.hash("id") % 3 != 0)]
    parts = rollup.hourly_parts(split[0]).unionByName(rollup.hourly_parts(split[1]))
    assert sorted(rollup.finish_hours(rollup.merge_parts(parts)).collect()) == want


def test_missing_address_is_a_group(log):
    df = rollup.messages_by_source(readings.parse_readings(log(document(1), document(2, ip="null"), document(3))))
    assert {r.source_ip: r.messages for r in df.collect()} == {"10.0.0.1": 2, None: 1}


def test_no_sort_and_a_partial_aggregate_below_the_shuffle(log):
    df = rollup.hourly_rollup(readings.parse_readings(log(document(1))))
    assert "Sort" not in optimized(df)
    assert "partial_sum" in plan(df) and plan(df).count("Exchange") == 1


def test_empty_log(log, spark):
    empty = log(document(1)).where("false")
    assert rollup.hourly_rollup(readings.parse_readings(empty)).count() == 0
    assert rollup.messages_by_source(readings.parse_readings(empty)).count() == 0
