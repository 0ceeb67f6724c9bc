from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import functions as F

from barograph.functions import positions as P
from barograph.operators import gps

RMC = "GPRMC,081836,A,3751.65,S,14507.36,E,000.0,360.0,130998,011.3,E"
GGA = "GPGGA,180050.896,3749.1802,N,08338.7865,W,1,07,1.1,397.4,M,-32.5,M,,0000"
GSA = "GPGSA,A,3,07,11,28,24,26,08,17,,,,,,2.0,1.1,1.7"
GSV = ["GPGSV,3,1,12,28,72,355,39,01,52,063,33,17,51,272,44,08,46,184,38", "GPGSV,3,2,12,24,42,058,33,11,34,053,33,07,20,171,40,20,15,116,", "GPGSV,3,3,12,04,12,204,34,27,11,324,35,32,11,089,,26,10,264,40"]


def sentence(body: str) -> str:
    return f"${body}*{reduce(lambda a, c: a ^ ord(c), body, 0):02X}"


@pytest.fixture
def lines(spark):
    def make(*texts: str, device: int = 1, timed: bool = False):
        start = datetime(2024, 1, 1)
        rows = [(device, i, t, start + timedelta(seconds=i)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "device_id long, seq long, line string, ts timestamp_ntz")
        return df if timed else df.drop("ts")

    return make


def states(df, **kw):
    return gps.receiver_state(df, **kw).orderBy("seq", "part").collect()


@pytest.mark.parametrize(
    ("line", "status"),
    [
        (sentence(RMC), "clean"),
        (sentence(RMC).replace("3751", "3752"), "crc_failed"),
        (sentence(RMC)[:-2] + "zz", "bad_hex"),
        (sentence(RMC)[:-1], "incomplete"),
        ("$" + RMC, "incomplete"),
        ("noise without a start", "incomplete"),
        (sentence("G" + "x" * 87), "clean"),
        (sentence("G" + "x" * 88), "incomplete"),
        ("\x07" + sentence(RMC)[:5] + "\x01é" + sentence(RMC)[5:] + "\r\n", "clean"),
    ],
)
def test_framing(lines, line, status):
    assert [r.status for r in gps.framed(lines(line)).collect()] == [status]


def test_several_sentences_in_a_line(lines):
    rows = gps.framed(lines(sentence(RMC) + "$GPRM" + sentence(GGA))).orderBy("part").collect()
    assert [(r.part, r.status, r.fields[0] if r.fields else None) for r in rows] == [(0, "clean", "GPRMC"), (1, "incomplete", None), (2, "clean", "GPGGA")]


def test_quality(lines):
    bad = [sentence(RMC)[:-2] + "00", sentence(RMC)[:-2] + "q!", "$GPRMC,1"]
    texts = [sentence(b) for b in (RMC, GGA, GSA, *GSV, "GNGSV,1,1,01,05,1,2,3", "GPTXT,hello", RMC.replace("081836", "08x836"))] + bad
    r = gps.sentence_quality(lines(*texts)).first()
    assert (r.sentences, r.clean, r.crc_failed, r.bad_hex, r.incomplete, r.parsed) == (12, 9, 1, 1, 1, 6)
    assert (r.rmc, r.gga, r.gsa, r.gsv, r.vtg, r.gll) == (1, 1, 1, 3, 0, 0)


def test_recommended_minimum(lines):
    r = states(lines(sentence(RMC)), hour_offset=-10)[0]
    assert tuple(r.time) == (22, 18, 36.0) and tuple(r.date) == (13, 9, 98)
    assert tuple(r.latitude) == (37, 51.65, "S") and tuple(r.longitude) == (145, 7.36, "E")
    assert (r.speed_knots, r.course, r.valid, r.parsed) == (0.0, 360.0, True, True)
    assert (r.fix_type, r.satellites_used, r.altitude) == (1, [], 0.0)


def test_an_inactive_sentence_clears_the_position(lines):
    r = states(lines(sentence(RMC), sentence("GPRMC,,V,,,,,,,,,")))[1]
    assert tuple(r.latitude) == (0, 0.0, "N") and tuple(r.longitude) == (0, 0.0, "W")
    assert tuple(r.time) == (0, 0, 0.0) and tuple(r.date) == (0, 0, 0) and r.valid is False and r.parsed


@pytest.mark.parametrize("change", [("3751.65", "x"), (",S,", ",Q,"), ("000.0", ""), ("360.0", "w"), ("14507.36", "")])
def test_a_broken_active_sentence_sets_only_time_and_date(lines, change):
    r = states(lines(sentence(GGA), sentence(RMC.replace(*change))))[1]
    assert not r.parsed and tuple(r.time) == (8, 18, 36.0) and tuple(r.date) == (13, 9, 98)
    assert tuple(r.latitude) == (37, 49.1802, "N") and r.valid is False


def test_a_broken_date_sets_only_the_time_and_a_broken_time_nothing(lines):
    a, b = states(lines(sentence(RMC.replace("130998", "1309xx")), sentence(RMC.replace("081836", "0818"))))
    assert not a.parsed and tuple(a.time) == (8, 18, 36.0) and tuple(a.date) == (0, 0, 0)
    assert not b.parsed and tuple(b.time) == (8, 18, 36.0) and tuple(b.date) == (0, 0, 0)


def test_position_and_course_sentences(lines):
    gll, vtg = "GNGLL,4916.45,N,12311.12,W,225444,A", "GPVTG,054.7,T,034.4,M,005.5,N,010.2,K"
    a, b, c, d = states(lines(sentence(gll), sentence(vtg), sentence("GPVTG,,T,,M,,N,,K"), sentence(gll.replace("A", "V"))))
    assert tuple(a.latitude) == (49, 16.45, "N") and a.valid and (b.course, b.speed_knots) == (54.7, 5.5)
    assert (c.course, c.speed_knots, c.parsed) == (0.0, 0.0, True)
    assert tuple(d.longitude) == (0, 0.0, "W") and not d.valid and d.parsed


def test_fix_data(lines):
    none = "GPGGA,180051,,,,,0,03,,,M,,M,,"
    a, b, c = states(lines(sentence(GGA), sentence(none), sentence(GGA.replace("397.4", ""))))
    assert (a.satellites_in_use, a.fix_stat, a.hdop, a.altitude, a.geoid_height) == (7, 1, 1.1, 397.4, -32.5)
    assert (b.satellites_in_use, b.fix_stat, b.hdop, b.altitude) == (3, 0, 0.0, 397.4)
    assert tuple(b.latitude) == (37, 49.1802, "N") and tuple(b.time) == (18, 0, 51.0)
    assert (c.altitude, c.geoid_height) == (0.0, 0.0)
    broken = states(lines(sentence(GGA.replace("3749.1802", "")), sentence(GGA.replace(",07,", ",,"))))
    assert [(r.parsed, r.satellites_in_use, tuple(r.time)) for r in broken] == [(False, 0, (0, 0, 0.0))] * 2


def test_active_satellites(lines):
    a, b, c = states(lines(sentence(GSA), sentence(GSA.replace("11,28", "x,28")), sentence(GSA.replace("2.0", ""))))
    assert (a.fix_type, a.satellites_used, a.pdop, a.hdop, a.vdop) == (3, [7, 11, 28, 24, 26, 8, 17], 2.0, 1.1, 1.7)
    assert not b.parsed and not c.parsed and b.satellites_used == a.satellites_used


def test_satellite_groups(lines):
    newer = "GPGSV,3,2,12,28,01,002,,,,,,,,,,,,,"
    out = gps.satellite_groups(lines(sentence(GSV[1]), *[sentence(b) for b in (GSV[0], newer, GSV[2], GSV[0])]))
    rows = {(r.group_seq, r.prn): r for r in out.collect()}
    assert {k[1] for k in rows if k[0] is None} == {24, 11, 7, 20}
    first = {k[1]: r for k, r in rows.items() if k[0] == 1}
    assert set(first) == {28, 1, 17, 8, 4, 27, 32, 26} and all(r.complete for r in first.values())
    assert (first[28].elevation, first[28].azimuth, first[28].snr) == (1, 2, None)
    assert (first[1].elevation, first[1].azimuth, first[1].snr) == (52, 63, 33)
    assert not rows[(4, 28)].complete and rows[(4, 28)].snr == 39


def test_last_sentence_holds_the_rest(lines):
    out = gps.satellite_groups(lines(sentence("GPGSV,2,1,05,01,10,100,30,02,10,100,30,03,10,100,30,04,10,100,30"), sentence("GPGSV,2,2,05,09,20,200,40,77,1,1,1")))
    assert sorted(r.prn for r in out.collect()) == [1, 2, 3, 4, 9]
    assert gps.satellite_groups(lines(sentence("GPGSV,1,1,00"))).count() == 0


def test_time_since_fix(lines):
    texts = [sentence(b) for b in ("GPRMC,,V,,,,,,,,,", RMC, "GPVTG,,T,,M,,N,,K", GSA.replace(",3,07", ",1,07"), GSA)]
    assert [r.ms_since_fix for r in states(lines(*texts, timed=True))] == [-1.0, 0.0, 1000.0, 2000.0, 0.0]


def test_state_over_many_buckets_equals_one_bucket(lines, monkeypatch):
    texts = [sentence(b) for b in (RMC, GGA, GSA, *GSV, "GPRMC,,V,,,,,,,,,", "GPVTG,1.0,T,,M,2.0,N,,K")] * 6
    want = states(lines(*texts))
    monkeypatch.setattr(gps, "BUCKET_LINES", 3)
    assert states(lines(*texts)) == want


def position(d, m, h):
    return F.struct(F.lit(d).alias("degrees"), F.lit(m).alias("minutes"), F.lit(h).alias("hemisphere"))


def test_display_forms(spark):
    p, zero = position(40, 26.767, "S"), position(0, 30.0, "N")
    day = lambda d, m, y: F.struct(F.lit(d).alias("day"), F.lit(m).alias("month"), F.lit(y).alias("year"))
    got = spark.range(1).select(
        P.position_text(p), P.position_text(p, "dms"), P.signed_degrees_text(p), P.signed_degrees_text(zero),
        P.signed_degrees_text(zero, zero_degrees_is_no_data=False), P.position_text(position(10, 30.0, "N"), "dd"),
        P.speed_text(F.lit(1.0), "knot"), P.speed_text(F.lit(2.5), "knot"), P.speed_text(F.lit(10.0)), P.speed_text(F.lit(1.0), "mph"),
        P.date_text(day(3, 2, 5)), P.date_text(day(3, 2, 5), "s_dmy"), P.date_text(day(3, 2, 5), "long"),
        P.date_text(day(23, 12, 98), "long", century=19), P.date_text(day(11, 1, 24), "long"), P.date_text(day(0, 0, 0), "long"),
    ).first()
    assert tuple(got) == (
        "40° 26.767' S", "40° 26' 46\" S", "-40.446117", None, "0.500000", "10.5° N",
        "1.0 knot", "2.5 knots", "18.52 km/h", "1.151 mph",
        "02/03/05", "03/02/05", "February 3rd, 2005", "December 23rd, 1998", "January 11th, 2024", None,
    )


@pytest.mark.parametrize(("course", "point"), [(0.0, "N"), (11.24, "N"), (11.25, "NNE"), (90.0, "E"), (348.74, "NNW"), (348.75, "N"), (360.0, "N")])
def test_compass(spark, course, point):
    assert spark.range(1).select(P.compass_point(F.lit(course))).first()[0] == point
