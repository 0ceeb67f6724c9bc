"""Position, speed, course and date in the forms a display shows.

A position is ``struct<degrees, minutes, hemisphere>``, a date ``struct<day, month, year>`` with two year digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barograph.functions.sentences import COMPASS

#: Factors from knots as the display uses them (fixed values).
MPH_PER_KNOT = 1.151
KMH_PER_KNOT = 1.852


def decimal_degrees(p: Column) -> Column:
    return p.getField("degrees") + p.getField("minutes") / F.lit(60.0)


def whole_seconds(p: Column) -> Column:
    minutes = p.getField("minutes")
    return F.rint((minutes - F.floor(minutes)) * 60).cast("int")


def position_text(p: Column, form: str = "ddm") -> Column:
    """``ddm`` 40° 26.767' N, ``dms`` 40° 26' 46" N, ``dd`` 40.446° N."""
    degrees, minutes, hemisphere = (p.getField(n) for n in ("degrees", "minutes", "hemisphere"))
    if form == "dd":
        return F.concat(decimal_degrees(p).cast("string"), F.lit("° "), hemisphere)
    if form == "dms":
        whole = F.floor(minutes).cast("int")
        return F.concat(degrees, F.lit("° "), whole, F.lit("' "), whole_seconds(p), F.lit('" '), hemisphere)
    return F.concat(degrees, F.lit("° "), minutes.cast("string"), F.lit("' "), hemisphere)


def signed_degrees_text(p: Column, zero_degrees_is_no_data: bool = True) -> Column:
    """Six decimals, south and west negative. A whole degree of 0 counts as no data unless told otherwise."""
    sign = F.when(p.getField("hemisphere").isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0))
    text = F.format_string("%.6f", decimal_degrees(p) * sign)
    return F.when(p.getField("degrees") != 0, text) if zero_degrees_is_no_data else text


def mph(knots: Column) -> Column:
    return knots * F.lit(MPH_PER_KNOT)


def kmh(knots: Column) -> Column:
    return knots * F.lit(KMH_PER_KNOT)


def speed_text(knots: Column, unit: str = "kph") -> Column:
    if unit == "mph":
        return F.concat(mph(knots).cast("string"), F.lit(" mph"))
    if unit == "knot":
        return F.concat(knots.cast("string"), F.when(knots == 1, " knot").otherwise(" knots"))
    return F.concat(kmh(knots).cast("string"), F.lit(" km/h"))


def compass_point(course: Column) -> Column:
    """One of sixteen points; each spans 22.5 degrees around its direction."""
    return F.get(F.array(*[F.lit(n) for n in COMPASS]), F.pmod(F.floor((course + 11.25) / 22.5), F.lit(16)).cast("int"))


def date_text(d: Column, form: str = "s_mdy", century: int = 20) -> Column:
    """``s_mdy`` 11/01/14, ``s_dmy`` 01/11/14, ``long`` November 1st, 2014; ``long`` is NULL for no valid date."""
    day, month, year = (F.lpad(d.getField(n).cast("string"), 2, "0") for n in ("day", "month", "year"))
    if form != "long":
        first, second = (day, month) if form == "s_dmy" else (month, day)
        return F.concat_ws("/", first, second, year)
    at = F.try_to_timestamp(F.concat(F.lit(str(century)), year, month, day), F.lit("yyyyMMdd"))
    n = F.dayofmonth(at)
    suffix = (
        F.when(n.isin(11, 12, 13), "th")
        .when(n % 10 == 1, "st")
        .when(n % 10 == 2, "nd")
        .when(n % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(F.date_format(at, "MMMM d"), suffix, F.date_format(at, ", yyyy"))


def clock_text(t: Column) -> Column:
    """``hh:mm:ss`` with the seconds as received."""
    second = t.getField("second")
    return F.concat(
        F.lpad(t.getField("hour").cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(t.getField("minute").cast("string"), 2, "0"),
        F.lit(":"),
        second.cast("string"),
    )
