from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from barograph.functions import compensation as C
from barograph.functions.values import strip_unit
from barograph.operators import calibration
from barograph.sources.events import TYPICAL


def expected(rt, rp, rh, d, preshift):
    """The maker's integer formulas with numbers of any size."""
    a = (rt >> 3) - 2 * d["dig_T1"]
    t = a * (d["dig_T2"] >> 11) if preshift else (a * d["dig_T2"]) >> 11
    b = (rt >> 4) - d["dig_T1"]
    fine = t + (((b * b >> 12) * d["dig_T3"]) >> 14)
    v = fine - 128000
    off = v * v * d["dig_P6"] + (v * d["dig_P5"] << 17) + (d["dig_P4"] << 35)
    scale = ((1 << 47) + ((v * v * d["dig_P3"]) >> 8) + (v * d["dig_P2"] << 12)) * d["dig_P1"] >> 33
    press = 0
    if scale:
        q = (((1048576 - rp) << 31) - off) * 3125 // scale
        press = (q + (d["dig_P9"] * (q >> 13) * (q >> 13) >> 25) + (d["dig_P8"] * q >> 19) >> 8) + (d["dig_P7"] << 4)
    w = fine - 76800
    x = ((rh << 14) - (d["dig_H4"] << 20) - d["dig_H5"] * w + 16384) >> 15
    x *= ((((w * d["dig_H6"] >> 10) * ((w * d["dig_H3"] >> 11) + 32768) >> 10) + 2097152) * d["dig_H2"] + 8192) >> 14
    x -= ((x >> 15) * (x >> 15) >> 7) * d["dig_H1"] >> 4
    return fine, (fine * 5 + 128) >> 8, press, max(0, min(x, 419430400)) >> 12


@pytest.fixture
def constants(spark):
    def make(**change):
        rows = [(i, *{**TYPICAL, **change}.values()) for i in (1, 2, 3)]
        return spark.createDataFrame(rows, "device_id long, " + ", ".join(f"{c} int" for c in TYPICAL))

    return make


def raw(spark, rows):
    return spark.createDataFrame(rows, "device_id long, reading_id long, raw_temp int, raw_press int, raw_hum int")


@pytest.mark.parametrize("preshift", [True, False])
def test_values(spark, constants, preshift):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.randrange(380_000, 600_000), rng.randrange(250_000, 480_000), rng.randrange(0, 65_536)) for i in range(500)]
    got = calibration.calibrate(raw(spark, rows), constants(), preshift)
    want = {i: expected(t, p, h, TYPICAL, preshift) for _, i, t, p, h in rows}
    assert {r.reading_id: (r.t_fine, r.temperature, r.pressure, r.humidity) for r in got.collect()} == want
    assert {w[3] for w in want.values()} >= {0, 102400}


def test_datasheet_example(spark, constants):
    rows = raw(spark, [(1, 1, 519888, 415148, 30000)])
    assert calibration.calibrate(rows, constants(), t2_preshift=False).first().temperature == 2508
    assert calibration.calibrate(rows, constants()).first().temperature == 2331


def test_no_divisor_gives_no_pressure(spark, constants):
    r = calibration.calibrate(raw(spark, [(1, 1, 519888, 415148, 30000)]), constants(dig_P1=0)).first()
    assert (r.pressure, r.pressure_text) == (0, "0.00hPa")


@pytest.mark.parametrize("spread", [1, 16])
def test_every_reading_once_whatever_the_spread(spark, constants, spread):
    rows = [(1 if i % 3 else 2, i, 519888, 415148, 30000) for i in range(300)]
    assert calibration.calibrate(raw(spark, rows), constants(), spread=spread).count() == 300
    assert calibration.calibrate(raw(spark, [(9, 1, 1, 1, 1)]), constants(), spread=spread).count() == 0


def test_constants_are_not_forced_into_a_broadcast(spark, constants):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = calibration.calibrate(raw(spark, [(1, 1, 519888, 415148, 30000)]), constants())
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_burst(spark):
    df = spark.createDataFrame([(1, 1, bytes.fromhex("655AC07EED007530"))], "device_id long, reading_id long, burst binary")
    r = calibration.unpack_readings(df).first()
    assert (r.raw_press, r.raw_temp, r.raw_hum) == (415148, 519888, 30000)


def test_floor_division_for_all_signs(spark):
    pairs = [(x, y) for x in (-7, -6, -1, 0, 1, 6, 7) for y in (-3, -2, 2, 3)]
    df = spark.createDataFrame(pairs, "x long, y long").select("x", "y", C._floor_divide(F.col("x"), F.col("y")).alias("q"))
    assert all(r.q == r.x // r.y for r in df.collect())


def test_texts_read_back(spark):
    df = spark.createDataFrame([(v,) for v in (0, 5, 99, 100, 2190, 2192, -350, -5)], "t long")
    text = C.temperature_text(F.col("t"))
    rows = df.select("t", text.alias("text"), strip_unit(text, "C").alias("back")).collect()
    assert [r.text for r in rows][-4:] == ["21.9C", "21.92C", "-3.5C", "-0.05C"]
    assert all(r.back * 100 == r.t for r in rows)
    p = spark.sql("SELECT 89007L * 256 + 3 AS p, 45910L AS h").select(C.pressure_text(F.col("p")), C.humidity_text(F.col("h"))).first()
    assert tuple(p) == ("890.07hPa", "44.83%")


def test_register_blocks(spark):
    """Both signs of every value that has one, and the ends of each range."""
    rng, rows, want = random.Random(3), [], {}
    ends = {16: (-32768, 32767), 12: (-2048, 2047), 8: (-128, 127)}
    for device in range(40):
        pick = lambda bits: rng.choice([*ends[bits], -1, 0, rng.randint(*ends[bits])])  # noqa: B023, E731
        words = [pick(16) for _ in range(12)]
        words[0], words[3] = words[0] & 0xFFFF, words[3] & 0xFFFF
        h1, h2, h3, h4, h5, h6 = rng.choice([0, 128, 255]), pick(16), rng.choice([0, 128, 255]), pick(12), pick(12), pick(8)
        first = struct.pack("<HhhHhhhhhhhhBB", *words, 0, h1)
        second = struct.pack("<hBbBbb", h2, h3, h4 >> 4, (h4 & 15) | (h5 & 15) << 4, h5 >> 4, h6)
        rows.append((device, first, second))
        want[device] = (*words, h1, h2, h3, h4, h5, h6)
    got = calibration.unpack_constants(spark.createDataFrame(rows, "device_id long, first binary, second binary"))
    assert {r.device_id: tuple(r)[1:] for r in got.collect()} == want
