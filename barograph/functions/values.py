"""Small value expressions used across the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from barograph.schema import MEASURE


def strip_unit(c: Column, unit: str) -> Column:
    """Every occurrence of the unit taken out, the rest read as a number; NULL if it is none."""
    return F.replace(c, F.lit(unit), F.lit("")).try_cast(MEASURE)


def half_up_mean(total: Column, n: Column, digits: int = 2) -> Column:
    """Mean from an exact sum and a count, rounded once, NULL for an empty group."""
    return F.round(F.try_divide(total, n), digits).cast("double")


def size_text(size: Column, suffix: str = "B") -> Column:
    """Bytes as text in the largest fitting binary unit, two decimals (half to even); NULL from 1024 P upwards."""
    out = F.lit(None).cast("string")
    for power, unit in reversed(list(enumerate(["", "K", "M", "G", "T", "P"]))):
        scaled = F.bround(size / F.lit(float(1024**power)), 2)
        out = F.when(size < F.lit(float(1024 ** (power + 1))), F.format_string(f"%.2f{unit}{suffix}", scaled)).otherwise(out)
    return out


def online_text(alive: Column) -> Column:
    return F.when(alive, "ONLINE").otherwise("OFFLINE")


def status_text(error_code: Column) -> Column:
    """Controller error code to a word: 0 is good, anything else (also none) is bad."""
    return F.when(error_code == 0, "Good").otherwise("Bad")


def port_list(ports: Column) -> Column:
    """Array of ``80/tcp`` like names as one comma-separated text without the protocol."""
    return F.array_join(F.transform(ports, lambda p: F.replace(p, F.lit("/tcp"), F.lit(""))), ",")


def band(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the first band whose upper edge is not below the value; the last name lies beyond all edges."""
    steps = sorted(zip(edges, names[: len(edges)]))
    above = F.when(value.isNotNull(), F.lit(names[len(edges)]))
    return reduce(lambda rest, s: F.when(value <= s[0], F.lit(s[1])).otherwise(rest), reversed(steps), above)


def naive(c: Column) -> Column:
    """UTC wall time without a zone, the form in which result tables leave Spark."""
    return c.cast("timestamp_ntz")
