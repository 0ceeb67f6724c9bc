"""NMEA 0183 sentences as column expressions: framing, checksum and the fields of each kind.

A receiver's state changes by the fields that a sentence sets. Each kind is therefore described by the
values it sets (NULL: leaves as it is) and by whether it was understood to the end (``parsed``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Talker and kind codes that are understood (fixed values). GN satellites-in-view is not among them.
SUPPORTED = [t + k for k in ("RMC", "GGA", "VTG", "GSA", "GLL") for t in ("GP", "GL", "GN")] + ["GPGSV", "GLGSV"]
HEMISPHERES = ["N", "S", "E", "W"]
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]

#: A sentence counts if its second checksum digit is at most the 91st character after the dollar sign.
LAST_CHECKSUM_CHARACTER = 91
NO_FIX = 1

#: The receiver's values before any sentence, as SQL (fixed values).
INITIAL_STATE = {
    "time": "named_struct('hour', 0, 'minute', 0, 'second', 0.0D)",
    "date": "named_struct('day', 0, 'month', 0, 'year', 0)",
    "latitude": "named_struct('degrees', 0, 'minutes', 0.0D, 'hemisphere', 'N')",
    "longitude": "named_struct('degrees', 0, 'minutes', 0.0D, 'hemisphere', 'W')",
    "speed_knots": "0.0D",
    "course": "0.0D",
    "valid": "false",
    "altitude": "0.0D",
    "geoid_height": "0.0D",
    "satellites_in_use": "0",
    "hdop": "0.0D",
    "pdop": "0.0D",
    "vdop": "0.0D",
    "fix_stat": "0",
    "fix_type": "1",
    "satellites_used": "cast(array() as array<int>)",
    "satellites_in_view": "0",
    "sv_sentences": "0",
    "sv_sentence": "0",
}


def checksum(body: Column) -> Column:
    """Exclusive or over the characters between the dollar sign and the star."""
    return F.aggregate(F.split(body, ""), F.lit(0), lambda acc, ch: acc.bitwiseXOR(F.ascii(ch)))


def sentence_starts(line: Column) -> Column:
    """What follows each dollar sign of a line, characters outside 10..126 taken out."""
    parts = F.split(F.regexp_replace(line, r"[^\x0A-\x7E]", ""), r"\$")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def body_of(piece: Column) -> Column:
    return F.when(F.contains(piece, F.lit("*")), F.substring_index(piece, "*", 1))


def sentence_status(piece: Column, body: Column, expected: Column) -> Column:
    """``clean``, ``crc_failed``, ``bad_hex``, or ``incomplete`` (no star, no two digits, or too long).

    ``expected`` is the body's checksum.
    """
    digits = F.substring(piece, F.length(body) + 2, F.lit(2))
    too_long = F.length(body) + 3 > LAST_CHECKSUM_CHARACTER
    return (
        F.when(body.isNull() | (F.length(digits) < 2) | too_long, "incomplete")
        .when(~digits.rlike("^[0-9A-Fa-f]{2}$"), "bad_hex")
        .when(F.conv(digits, 16, 10).cast("int") == expected, "clean")
        .otherwise("crc_failed")
    )


#: Where each kind carries a value: field number, counted from 0 at the sentence's name (fixed values).
PLACES = {
    "clock": {"RMC": 1, "GLL": 5, "GGA": 1},
    "day": {"RMC": 9},
    "flag": {"RMC": 2, "GLL": 6},
    "lat": {"RMC": 3, "GLL": 1, "GGA": 2},
    "lat_hemisphere": {"RMC": 4, "GLL": 2, "GGA": 3},
    "lon": {"RMC": 5, "GLL": 3, "GGA": 4},
    "lon_hemisphere": {"RMC": 6, "GLL": 4, "GGA": 5},
    "speed": {"RMC": 7, "VTG": 5},
    "course": {"RMC": 8, "VTG": 1},
    "fix_stat": {"GGA": 6},
    "used": {"GGA": 7},
    "hdop": {"GGA": 8, "GSA": 16},
    "altitude": {"GGA": 9},
    "geoid": {"GGA": 11},
    "fix_type": {"GSA": 2},
    "pdop": {"GSA": 15},
    "vdop": {"GSA": 17},
    "sv_total": {"GSV": 1},
    "sv_index": {"GSV": 2},
    "sv_view": {"GSV": 3},
}
KINDS = ["RMC", "GLL", "VTG", "GGA", "GSA", "GSV"]
SET_COLUMNS = [*INITIAL_STATE, "satellites"]


def _all_known(*cols: Column) -> Column:
    return reduce(and_, [c.isNotNull() for c in cols])


#: A number as sentences have it. A cast alone would also take Java's own forms, such as 12.5f, 12.5d or 0x1p3.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def _real(t: Column) -> Column:
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def _clock(t: Column, hour_offset: int) -> Column:
    """Hours are shifted without touching the date; a blank is midnight."""
    h, m = F.substring(t, 1, 2).try_cast("int"), F.substring(t, 3, 2).try_cast("int")
    s = _real(F.substring(t, 5, 90))
    return F.when(t == "", F.expr(INITIAL_STATE["time"])).when(
        _all_known(h, m, s),
        F.struct(F.pmod(h + hour_offset, F.lit(24)).alias("hour"), m.alias("minute"), s.alias("second")),
    )


def _day(t: Column) -> Column:
    d, m, y = (F.substring(t, at, 2).try_cast("int") for at in (1, 3, 5))
    return F.when(t == "", F.expr(INITIAL_STATE["date"])).when(
        _all_known(d, m, y), F.struct(d.alias("day"), m.alias("month"), y.alias("year"))
    )


def _coordinate(t: Column, hemisphere: Column, degree_digits: int) -> Column:
    degrees = F.substring(t, 1, degree_digits).try_cast("int")
    minutes = _real(F.substring(t, degree_digits + 1, 90))
    return F.when(
        _all_known(degrees, minutes) & hemisphere.isin(HEMISPHERES),
        F.struct(degrees.alias("degrees"), minutes.alias("minutes"), hemisphere.alias("hemisphere")),
    )


def number_texts(kind: Column, fields: Column) -> Column:
    """Satellite numbers as written: up to twelve in GSA, one per block of four fields in GSV.

    GSV lists four satellites per sentence and the rest in the last one; only what the sentence holds is read.
    """
    total, index, view = (F.get(fields, F.lit(PLACES[n]["GSV"])).try_cast("int") for n in ("sv_total", "sv_index", "sv_view"))
    blocks = F.when(total == index, view - (total - 1) * 4).otherwise(4)
    in_view = F.filter(fields, lambda t, i: (i >= 4) & (i % 4 == 0) & (i < blocks * 4 + 4))
    return F.when(kind == "GSA", F.slice(fields, 4, 12)).when(kind == "GSV", in_view)


def whole_numbers_until_blank(texts: Column) -> Column:
    """The first blank ends the list; a text that is no number is NULL."""
    blank = F.array_position(texts, "").cast("int")
    listed = F.slice(texts, F.lit(1), F.when(blank > 0, blank - 1).otherwise(F.size(texts)))
    return F.transform(listed, lambda t: t.try_cast("int"))


def all_read(numbers: Column) -> Column:
    return ~F.exists(numbers, lambda n: n.isNull())


def _satellites(prns: Column, fields: Column) -> Column:
    """A satellite's elevation, azimuth and signal follow its number; each is NULL where it does not read."""
    whole = lambda at: F.get(fields, at).try_cast("int")
    return F.transform(
        prns,
        lambda prn, j: F.struct(
            prn.alias("prn"),
            whole(j * 4 + 5).alias("elevation"),
            whole(j * 4 + 6).alias("azimuth"),
            whole(j * 4 + 7).alias("snr"),
        ),
    )


def read_values(kind: Column, fields: Column, hour_offset: int = 0) -> dict[str, Column]:
    """Every value a sentence of this kind carries, read once; NULL if it is missing or does not read."""

    def text(name: str) -> Column:
        hits = [(kind == k, F.get(fields, F.lit(i))) for k, i in PLACES[name].items()]
        first = F.when(*hits[0])
        return reduce(lambda w, hit: w.when(*hit), hits[1:], first)

    def number(name: str, blank: float | None = None) -> Column:
        t = text(name)
        read = _real(t)
        return read if blank is None else F.when(t == "", F.lit(blank)).otherwise(read)

    whole = {n: text(n).try_cast("int") for n in ("fix_stat", "used", "fix_type", "sv_total", "sv_index", "sv_view")}
    return whole | {
        "clock": _clock(text("clock"), hour_offset),
        "day": _day(text("day")),
        "flag": text("flag"),
        "lat": _coordinate(text("lat"), text("lat_hemisphere"), 2),
        "lon": _coordinate(text("lon"), text("lon_hemisphere"), 3),
        # a blank speed is an error in RMC and zero in VTG
        "speed": F.when((kind == "VTG") & (text("speed") == ""), F.lit(0.0)).otherwise(number("speed")),
        "course": number("course", blank=0.0),
        "hdop": number("hdop"),
        "altitude": number("altitude"),
        "geoid": number("geoid"),
        "pdop": number("pdop"),
        "vdop": number("vdop"),
    }


def _cleared(name: str) -> Column:
    return F.expr(INITIAL_STATE[name])


def verdicts(kind: Column, v: dict[str, Column]) -> dict[str, Column]:
    """What each sentence amounts to, from the values that were read; every verdict is true or false.

    RMC and GLL are active or clear the position; a broken active one does neither.
    """
    place = _all_known(v["lat"], v["lon"])
    rmc, gll, vtg, gga, gsa, gsv = (kind == k for k in KINDS)
    flagged = v["clock"].isNotNull() & v["flag"].isNotNull() & (gll | v["day"].isNotNull())
    moving = _all_known(v["speed"], v["course"])
    listed = v["prns_read"]
    gga_good = gga & _all_known(v["clock"], v["used"], v["fix_stat"]) & ((v["fix_stat"] == 0) | place)
    found = {
        "active": (rmc | gll) & flagged & (v["flag"] == "A") & place & (gll | moving),
        "cleared": (rmc | gll) & flagged & (v["flag"] != "A"),
        "vtg_good": vtg & moving,
        "gga_good": gga_good,
        "gga_fixed": gga_good & (v["fix_stat"] != 0),
        "gsa_good": gsa & _all_known(v["fix_type"], v["pdop"], v["hdop"], v["vdop"]) & listed,
        "gsv_good": gsv & _all_known(v["sv_total"], v["sv_index"], v["sv_view"]) & listed,
    }
    return {n: F.coalesce(c, F.lit(False)) for n, c in found.items()}


def is_parsed(verdict: dict[str, Column]) -> Column:
    return reduce(or_, [verdict[n] for n in ("active", "cleared", "vtg_good", "gga_good", "gsa_good", "gsv_good")])


def state_changes(kind: Column, fields: Column, v: dict[str, Column], verdict: dict[str, Column]) -> dict[str, Column]:
    """What each sentence sets, NULL where it leaves a value as it is; and whether it is understood and has a fix.

    GGA: without a fix the old position stays; height and geoid are both 0 unless both read.
    """
    rmc, gll = kind == "RMC", kind == "GLL"
    active, cleared = verdict["active"], verdict["cleared"]
    gga_good, gga_fixed = verdict["gga_good"], verdict["gga_fixed"]
    gsa_good, gsv_good = verdict["gsa_good"], verdict["gsv_good"]
    heights = _all_known(v["altitude"], v["geoid"])

    def position(name: str, value: Column) -> Column:
        return F.when(active | gga_fixed, value).when(cleared, _cleared(name))

    def motion(name: str, value: Column) -> Column:
        return F.when((rmc & active) | verdict["vtg_good"], value).when(rmc & cleared, _cleared(name))

    return {
        "time": F.when(rmc | gll | gga_good, v["clock"]),
        "date": F.when(v["clock"].isNotNull(), v["day"]),
        "latitude": position("latitude", v["lat"]),
        "longitude": position("longitude", v["lon"]),
        "speed_knots": motion("speed_knots", v["speed"]),
        "course": motion("course", v["course"]),
        "valid": F.when(active, True).when(cleared, False),
        "altitude": F.when(gga_fixed, F.when(heights, v["altitude"]).otherwise(0.0)),
        "geoid_height": F.when(gga_fixed, F.when(heights, v["geoid"]).otherwise(0.0)),
        "satellites_in_use": F.when(gga_good, v["used"]),
        "hdop": F.when(gga_good, F.coalesce(v["hdop"], F.lit(0.0))).when(gsa_good, v["hdop"]),
        "pdop": F.when(gsa_good, v["pdop"]),
        "vdop": F.when(gsa_good, v["vdop"]),
        "fix_stat": F.when(gga_good, v["fix_stat"]),
        "fix_type": F.when(gsa_good, v["fix_type"]),
        "satellites_used": F.when(gsa_good, v["prns"]),
        "satellites_in_view": F.when(gsv_good, v["sv_view"]),
        "sv_sentences": F.when(gsv_good, v["sv_total"]),
        "sv_sentence": F.when(gsv_good, v["sv_index"]),
        "satellites": F.when(gsv_good, _satellites(v["prns"], fields)),
        "parsed": is_parsed(verdict),
        "has_fix": active | gga_fixed | (gsa_good & (v["fix_type"] > NO_FIX)),
    }
