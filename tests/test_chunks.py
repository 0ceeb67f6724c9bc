"""A serial line cut into rows anywhere gives what its whole lines give."""

from __future__ import annotations

import random

import pytest
from conftest import SMALL, plan
from pyspark.sql import functions as F
from test_gps import GGA, GSA, GSV, RMC, sentence

from barograph.operators import chunks, gps
from barograph.sources import events


def cut(rng: random.Random, text: str, most: int) -> list[str]:
    out = []
    while text:
        n = rng.randint(1, most)
        out.append(text[:n])
        text = text[n:]
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    """(device, seq, text from a row's first dollar sign to the next one after its end) by one walk per device."""
    out: dict[tuple, str] = {}
    for device in {r[0] for r in rows}:
        now = None
        for _, seq, text in sorted((r for r in rows if r[0] == device), key=lambda r: r[1]):
            text = "".join(c for c in text or "" if 10 <= ord(c) <= 126)
            head, sign, rest = text.partition("$")
            if now is not None:
                out[device, now] += head
            if sign:
                now = seq
                out[device, now] = sign + rest
    return [(*k, v) for k, v in out.items()]


def sentences(rows: list[tuple]) -> list[tuple]:
    """What counts of each: the first characters after its dollar sign."""
    return sorted((d or -1, s, i, p[:91]) for d, s, text in rows for i, p in enumerate(text.split("$")[1:]))


@pytest.mark.parametrize(("bucket", "most"), [(1, 3), (3, 40), (64, 7), (100_000, 200)])
def test_rejoined_equals_one_walk(spark, bucket, most):
    rng, rows = random.Random(bucket), []
    for device in (1, 2, None):
        stream = "noise\x01é"
        for _ in range(60):
            one = sentence(rng.choice([RMC, GGA, GSA, *GSV]))
            stream += rng.choice([one, one, one + "\r\n", one[: rng.randrange(len(one))], "x" * rng.choice([5, 300]), "$", ""])
        # gaps in the sequence, so that some buckets are empty
        seq = 0
        for piece in cut(rng, stream, most):
            seq += rng.choice([1, 1, 1, 9])
            rows.append((device, seq, piece))
    rows.append((1, 10**9, None))
    df = spark.createDataFrame(rows, "device_id long, seq long, line string").withColumn("ts", F.col("seq") * 10)
    got = chunks.rejoined(df.repartition(4), F.expr(f"seq div {bucket}"))
    assert got.columns == ["device_id", "seq", "ts", "line"]
    got = got.collect()
    assert all(r["ts"] == r["seq"] * 10 for r in got)
    assert sentences([(r["device_id"], r["seq"], r["line"]) for r in got]) == sentences(plain(rows))


def test_whole_lines_stay_as_they_are(spark):
    whole = events.gps_lines(events.read_events(spark, SMALL))
    want = gps.receiver_state(whole.drop("ts"))
    got = gps.receiver_state(gps.rejoined(whole.drop("ts")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_cut_log_gives_the_receivers_states_of_whole_lines(spark):
    """Each sentence in rows of seven characters, dealt without regard to where sentences end."""
    text = "".join(sentence(b) + "\r\n" for b in [RMC, GGA, GSA, *GSV] * 3)
    rows = [(1, i, text[a : a + 7]) for i, a in enumerate(range(0, len(text), 7))]
    state = gps.receiver_state(gps.rejoined(spark.createDataFrame(rows, "device_id long, seq long, line string")))
    lines = [(1, i, line) for i, line in enumerate(text.split("\r\n")[:-1])]
    want = gps.receiver_state(spark.createDataFrame(lines, "device_id long, seq long, line string"))
    bare = lambda df: [r[3:] for r in df.orderBy("seq", "part").collect()]
    assert bare(state) == bare(want) and len(bare(want)) == 18


def test_noise_has_no_rows_and_does_not_grow(spark):
    """A long stretch without a beginning leaves only what a sentence can reach."""
    rows = [(1, 0, "$GPRMC,"), *((1, i, "zz") for i in range(1, 4000))]
    got = chunks.rejoined(spark.createDataFrame(rows, "device_id long, seq long, line string"), F.expr("seq div 10")).collect()
    assert [(r["seq"], r["line"]) for r in got] == [(0, "$GPRMC," + "z" * 91)]
    assert chunks.rejoined(spark.createDataFrame([], "device_id long, seq long, line string"), F.lit(0)).collect() == []


def test_rows_are_dealt_out_once(spark):
    df = spark.createDataFrame([(1, 0, "$a")], "device_id long, seq long, line string")
    text = plan(gps.rejoined(df))
    assert "CartesianProduct" not in text and text.count("Scan ExistingRDD") + text.count("ReusedExchange") >= 2


@pytest.mark.parametrize("second", ["36f", "36d", "36F", "36.5D", "0x1p3", "3 6", ""])
@pytest.mark.parametrize("kind", ["clock", "coordinate"])
def test_numbers_in_other_languages_forms_are_none(spark, kind, second):
    body = RMC.replace("081836", f"0818{second}") if kind == "clock" else RMC.replace("3751.65", f"37{second}")
    df = spark.createDataFrame([(1, 0, sentence(body))], "device_id long, seq long, line string")
    assert [r["parsed"] for r in gps.decode(df, columns=[]).collect()] == [False]
