"""Raw readings and per-device constants to physical values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.functions import compensation as C
from barograph.operators.once import computed_once


def unpack_readings(bursts: DataFrame) -> DataFrame:
    """``(device_id, reading_id, burst BINARY)`` to raw register values."""
    return bursts.select("device_id", "reading_id", *[c.alias(n) for n, c in C.unpack_burst(F.col("burst")).items()])


def unpack_constants(blocks: DataFrame) -> DataFrame:
    """``(device_id, first BINARY, second BINARY)``, a device's two register blocks, to its constants."""
    constants = C.unpack_constants(F.col("first"), F.col("second"))
    return blocks.select("device_id", *[constants[n].alias(n) for n in C.CALIBRATION])


def with_constants(raw: DataFrame, calibration: DataFrame, spread: int = 16) -> DataFrame:
    """Each reading beside its device's constants.

    Spark broadcasts the constants while their size is below its broadcast threshold. Beyond that the join
    shuffles; a device's readings are spread over ``spread`` copies of its one row of constants, so a device
    with very many readings does not end in one task.
    """
    copies = calibration.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    spread_out = raw.withColumn("_copy", F.pmod(F.hash("reading_id"), F.lit(spread)))
    return spread_out.join(copies, ["device_id", "_copy"]).drop("_copy")


def calibrate(raw: DataFrame, calibration: DataFrame, t2_preshift: bool = True, spread: int = 16) -> DataFrame:
    """Temperature in hundredths of a degree, pressure in Pa * 256, humidity in % * 1024, and each as text with its unit."""
    both = with_constants(raw, calibration, spread)
    constant = {n: F.col(n).cast("bigint") for n in C.CALIBRATION}
    raw_values = [F.col(n).cast("bigint").alias(n) for n in ("raw_temp", "raw_press", "raw_hum")]
    wide = both.select("device_id", "reading_id", *raw_values, *[c.alias(n) for n, c in constant.items()])

    def group(letter: str) -> list:
        return [F.col(n) for n in C.CALIBRATION if n.startswith(f"dig_{letter}")]

    # each stage is worked out once: written as one expression the stages would be repeated in each other
    raw_press, t_fine, p, h = F.col("raw_press"), F.col("t_fine"), group("P"), group("H")
    fine = computed_once(wide, {"t_fine": C.fine_temperature(F.col("raw_temp"), group("T"), t2_preshift)})
    terms = C.pressure_terms(t_fine, p) | {"h_product": C.humidity_product(F.col("raw_hum"), t_fine, h)}
    staged = computed_once(fine, terms)
    staged = computed_once(staged, {"p_quotient": C.pressure_quotient(raw_press, F.col("p_offset"), F.col("p_scale"))})
    results = {
        "temperature": C.temperature(t_fine),
        "pressure": C.pressure(F.col("p_quotient"), F.col("p_scale"), p),
        "humidity": C.humidity(F.col("h_product"), h),
    }
    values = computed_once(staged, results).select("device_id", "reading_id", "t_fine", *results)
    return values.select(
        "*",
        C.temperature_text(F.col("temperature")).alias("temperature_text"),
        C.pressure_text(F.col("pressure")).alias("pressure_text"),
        C.humidity_text(F.col("humidity")).alias("humidity_text"),
    )
