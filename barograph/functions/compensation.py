"""Raw sensor registers to temperature, pressure and humidity, in 64-bit whole numbers.

The formulas are the sensor maker's published integer compensation. Factors and shift widths are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALIBRATION = ["dig_T1", "dig_T2", "dig_T3"] + [f"dig_P{i}" for i in range(1, 10)] + [f"dig_H{i}" for i in range(1, 7)]
HUMIDITY_LIMIT = 419_430_400


def _right(c: Column, n: int) -> Column:
    return F.shiftright(c, n)


def _times_power(c: Column, n: int) -> Column:
    """A product instead of a shift, so that an overflow is an error and not a wrong number."""
    return c * F.lit(1 << n)


def _floor_divide(x: Column, y: Column) -> Column:
    """Whole division rounding down for either sign; NULL for a divisor of 0."""
    y = F.nullif(y, F.lit(0).cast("bigint"))
    q, r = F.call_function("div", x, y), x % y
    return F.when((r != 0) & ((r < 0) != (y < 0)), q - 1).otherwise(q)


def unpack_burst(burst: Column) -> dict[str, Column]:
    """The eight bytes from the sensor: 20 bits of pressure, 20 of temperature, 16 of humidity."""

    def bits(first_byte: int, n_bytes: int) -> Column:
        part = F.hex(F.substring(burst, first_byte, n_bytes))
        return F.conv(part, 16, 10).cast("bigint")

    return {"raw_press": _right(bits(1, 3), 4), "raw_temp": _right(bits(4, 3), 4), "raw_hum": bits(7, 2)}


def unpack_constants(first: Column, second: Column) -> dict[str, Column]:
    """The constants from the sensor's two register blocks of 26 and 7 bytes.

    Words are little-endian. Only T1, P1, H1 and H3 are without a sign; H4 and H5 share a byte for their lowest four bits.
    """

    def byte(block: Column, i: int) -> Column:
        return F.conv(F.hex(F.substring(block, i + 1, 1)), 16, 10).cast("int")

    def signed(c: Column, bits: int) -> Column:
        return F.when(c >= 1 << (bits - 1), c - (1 << bits)).otherwise(c)

    def word(block: Column, i: int) -> Column:
        return byte(block, i) + byte(block, i + 1) * 256

    out = {n: word(first, 2 * i) for i, n in enumerate(CALIBRATION[:12])}
    out = {n: c if n in ("dig_T1", "dig_P1") else signed(c, 16) for n, c in out.items()}
    shared = byte(second, 4)
    return out | {
        "dig_H1": byte(first, 25),
        "dig_H2": signed(word(second, 0), 16),
        "dig_H3": byte(second, 2),
        "dig_H4": signed(byte(second, 3), 8) * 16 + shared % 16,
        "dig_H5": signed(byte(second, 5), 8) * 16 + _right(shared, 4),
        "dig_H6": signed(byte(second, 6), 8),
    }


def fine_temperature(raw: Column, t: list[Column], preshift: bool = True) -> Column:
    """``preshift`` shifts the second constant before multiplying; without it this is the data sheet's form."""
    t1, t2, t3 = t
    coarse = _right(raw, 3) - _times_power(t1, 1)
    linear = coarse * _right(t2, 11) if preshift else _right(coarse * t2, 11)
    d = _right(raw, 4) - t1
    return linear + _right(_right(d * d, 12) * t3, 14)


def temperature(fine: Column) -> Column:
    """Hundredths of a degree Celsius."""
    return _right(fine * 5 + 128, 8)


def pressure_terms(fine: Column, p: list[Column]) -> dict[str, Column]:
    """First stage of the pressure: what is taken off the raw value and what it is divided by."""
    p1, p2, p3, p4, p5, p6 = p[:6]
    v = fine - 128_000
    offset = v * v * p6 + _times_power(v * p5, 17) + _times_power(p4, 35)
    scale = _right((F.lit(1 << 47) + _right(v * v * p3, 8) + _times_power(v * p2, 12)) * p1, 33)
    return {"p_offset": offset, "p_scale": scale}


def pressure_quotient(raw: Column, offset: Column, scale: Column) -> Column:
    return _floor_divide((_times_power(F.lit(1_048_576) - raw, 31) - offset) * 3125, scale)


def pressure(quotient: Column, scale: Column, p: list[Column]) -> Column:
    """Pascal times 256; 0 where the calibration admits no result."""
    p7, p8, p9 = p[6:]
    square = _right(p9 * _right(quotient, 13) * _right(quotient, 13), 25)
    return F.when(scale == 0, F.lit(0).cast("bigint")).otherwise(
        _right(quotient + square + _right(p8 * quotient, 19), 8) + _times_power(p7, 4)
    )


def humidity_product(raw: Column, fine: Column, h: list[Column]) -> Column:
    """First stage of the humidity."""
    _, h2, h3, h4, h5, h6 = h
    v = fine - 76_800
    signal = _right(_times_power(raw, 14) - _times_power(h4, 20) - h5 * v + 16_384, 15)
    slope = _right(_right(v * h6, 10) * (_right(v * h3, 11) + 32_768), 10) + 2_097_152
    return signal * _right(slope * h2 + 8_192, 14)


def humidity(product: Column, h: list[Column]) -> Column:
    """Percent times 1024, kept between 0 and 100 %."""
    x = product - _right(_right(_right(product, 15) * _right(product, 15), 7) * h[0], 4)
    return _right(F.least(F.greatest(x, F.lit(0).cast("bigint")), F.lit(HUMIDITY_LIMIT).cast("bigint")), 12)


def temperature_text(hundredths: Column) -> Column:
    return F.concat((hundredths / F.lit(100.0)).cast("string"), F.lit("C"))


def pressure_text(pascal_256: Column) -> Column:
    pascal = _right(pascal_256, 8)
    return F.format_string("%d.%02dhPa", _floor_divide(pascal, F.lit(100)), F.pmod(pascal, F.lit(100)))


def humidity_text(percent_1024: Column) -> Column:
    whole = _right(percent_1024, 10)
    return F.format_string("%d.%02d%%", whole, _right(percent_1024 * 100, 10) - whole * 100)
