"""The receiver's state over batches beside the state of one table."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from barograph.operators import gps
from barograph.streaming import receiver

COLUMNS = ["altitude", "hdop", "latitude", "satellites_used", "fix_type"]
SCHEMA = "device_id long, seq long, line string, ts timestamp"


def sentence(body: str) -> str:
    total = 0
    for ch in body:
        total ^= ord(ch)
    return f"${body}*{total:02X}"


def line(device, seq):
    north = f"48{seq % 60:02d}.50,N,00915.25,E"
    kinds = [f"GPGGA,101112,{north},1,07,1.{seq % 10},{100 + seq}.5,M,47.0,M,,", "GPGSA,A,3,04,05,,09,,,,,,,,,2.5,1.3,2.1", f"GPGLL,{north},101112,A", "GPXYZ,1"]
    at = datetime(2024, 3, 1, 10) + timedelta(seconds=seq)
    return (device, seq, sentence(kinds[(seq + (device or 0)) % 4]), at)


def rows_of(df):
    return sorted(df.collect(), key=repr)


@pytest.fixture
def sent():
    return [line(d, s) for d in (1, 2, None) for s in range(60)]


def advanced(spark, folder, batches, wait, repeat=()):
    for i, batch in enumerate(batches):
        rows = gps.decode(spark.createDataFrame(batch, SCHEMA).coalesce(1), columns=COLUMNS)
        for _ in range(2 if i in repeat else 1):
            receiver.advance(rows, i, folder, COLUMNS, wait)
    return spark.createDataFrame([], SCHEMA)


def test_out_of_order_and_repeated_batches(spark, folder, sent):
    mixed = sorted(sent, key=lambda r, rng=random.Random(3): r[1] + rng.randint(0, 12))
    batches = [mixed[:50], mixed[50:55], [], mixed[55:]]
    lines = advanced(spark, folder, batches, wait=30, repeat=(1, 3))
    want = rows_of(gps.receiver_state(spark.createDataFrame(sent, SCHEMA), columns=COLUMNS))
    got = receiver.written_states(lines, folder, COLUMNS, to_the_end=True)
    assert got.columns == gps.receiver_state(lines, columns=COLUMNS).columns and rows_of(got) == want
    # what is in order already is final: the rest still waits for the device's newest clean, supported sentence
    newest = {d: max(r["seq"] for r in want if r["device_id"] == d) for d in (1, 2, None)}
    assert newest == {1: 59, 2: 59, None: 58}
    settled = rows_of(receiver.written_states(lines, folder, COLUMNS))
    assert settled == [r for r in want if r["seq"] <= newest[r["device_id"]] - 30]
    assert receiver.late_sentences(lines, folder, COLUMNS).count() == 0


def test_a_sentence_after_its_turn_is_told_and_changes_nothing(spark, folder, sent):
    late = [r for r in sent if r[0] == 1 and r[1] == 8]
    on_time = [r for r in sent if r not in late]
    first, second = [r for r in on_time if r[1] < 40], [r for r in on_time if r[1] >= 40]
    lines = advanced(spark, folder, [first, late + second], wait=10)
    want = rows_of(gps.receiver_state(spark.createDataFrame(on_time, SCHEMA), columns=COLUMNS))
    assert rows_of(receiver.written_states(lines, folder, COLUMNS, to_the_end=True)) == want
    told = receiver.late_sentences(lines, folder, COLUMNS).collect()
    assert [(r["device_id"], r["seq"], r["batch"]) for r in told] == [(1, 8, 1)]
