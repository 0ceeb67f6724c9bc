"""A log of GPS sentences ``(device_id, seq, line[, ts])`` to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barograph.functions import positions as P
from barograph.functions.sentences import (
    INITIAL_STATE,
    KINDS,
    SET_COLUMNS,
    SUPPORTED,
    all_read,
    body_of,
    checksum,
    is_parsed,
    number_texts,
    read_values,
    sentence_starts,
    sentence_status,
    state_changes,
    verdicts,
    whole_numbers_until_blank,
)
from barograph.operators import chunks
from barograph.operators.once import computed_once
from barograph.operators.ordered import carry_forward

ORDER = ["seq", "part"]

#: Sequence numbers per bucket when one device's sentences are walked in order: a window never holds more lines.
BUCKET_LINES = 65_536


def framed(lines: DataFrame) -> DataFrame:
    """One row per sentence start (``part`` counts within a line), with its status, name and fields."""
    extra = [c for c in lines.columns if c != "line"]
    pieces = lines.select(*extra, F.posexplode_outer(sentence_starts(F.col("line"))).alias("part", "piece"))
    bodies = computed_once(pieces, {"body": body_of(F.col("piece"))})
    part = F.coalesce("part", F.lit(0)).alias("part")
    summed = bodies.select(*extra, part, "piece", "body", checksum(F.col("body")).alias("expected"))
    status = sentence_status(F.col("piece"), F.col("body"), F.col("expected"))
    return computed_once(summed, {"status": status, "fields": F.split("body", ",")}).drop("piece", "body", "expected")


def rejoined(lines: DataFrame) -> DataFrame:
    """A log whose rows were cut anywhere, as one whose rows hold whole sentences: see ``chunks``. Frame what it gives."""
    return chunks.rejoined(lines, _line_bucket())


def _supported(rows: DataFrame, kinds: list[str]) -> DataFrame:
    name = F.col("fields")[0]
    names = [n for n in SUPPORTED if n[2:] in kinds]
    clean = rows.where((F.col("status") == "clean") & name.isin(names))
    return clean.withColumn("kind", F.right(name, F.lit(3)))


def _judged(rows: DataFrame, hour_offset: int) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Sentences with the values read and the verdicts on them, in stages so that each is worked out once."""
    kind, fields = F.col("kind"), F.col("fields")
    single = read_values(kind, fields, hour_offset)
    read = (
        computed_once(rows, {f"_{n}": c for n, c in single.items()})
        .withColumn("_texts", number_texts(kind, fields))
        .withColumn("_prns", whole_numbers_until_blank(F.col("_texts")))
        .withColumn("_prns_read", all_read(F.col("_prns")))
    )
    values = {n: F.col(f"_{n}") for n in [*single, "prns", "prns_read"]}
    found = verdicts(kind, values)
    judged = computed_once(read, {f"_is_{n}": c for n, c in found.items()})
    return judged, values, {n: F.col(f"_is_{n}") for n in found}


def decode(
    lines: DataFrame, hour_offset: int = 0, columns: list[str] | None = None, kinds: list[str] = KINDS
) -> DataFrame:
    """Clean sentences of the supported (or fewer) kinds with the values each one sets."""
    rows = _supported(framed(lines), kinds)
    extra = [c for c in rows.columns if c not in ("status", "fields", "kind")]
    judged, values, verdict = _judged(rows, hour_offset)
    changes = state_changes(F.col("kind"), F.col("fields"), values, verdict)
    wanted = [*(columns if columns is not None else SET_COLUMNS), "parsed", "has_fix"]
    return judged.select(*extra, "kind", *[changes[c].alias(c) for c in wanted])


def sentence_quality(lines: DataFrame) -> DataFrame:
    """Per device: sentences begun, clean ones, checksum failures, unreadable checksums, understood ones per kind."""
    rows = framed(lines)
    name = F.col("fields")[0]
    supported = (F.col("status") == "clean") & name.isin(SUPPORTED)
    judged, _, verdict = _judged(rows.withColumn("kind", F.when(supported, F.right(name, F.lit(3)))), 0)
    counted = judged.select("device_id", "status", F.when(is_parsed(verdict), F.col("kind")).alias("kind"))
    return counted.groupBy("device_id").agg(
        F.count("*").alias("sentences"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("clean", "crc_failed", "bad_hex", "incomplete")],
        F.count("kind").alias("parsed"),
        *[F.count_if(F.col("kind") == k).alias(k.lower()) for k in KINDS],
    )


def fixes(lines: DataFrame, hour_offset: int = 0) -> DataFrame:
    """Every sentence that brings a position of its own."""
    rows = decode(lines, hour_offset, ["time", "latitude", "longitude"], ["RMC", "GLL", "GGA"])
    lat, lon = F.col("latitude"), F.col("longitude")
    return rows.where("has_fix").select(
        "device_id",
        *ORDER,
        "kind",
        P.clock_text(F.col("time")).alias("time"),
        P.decimal_degrees(lat).alias("latitude"),
        lat.getField("hemisphere").alias("lat_hemisphere"),
        P.decimal_degrees(lon).alias("longitude"),
        lon.getField("hemisphere").alias("lon_hemisphere"),
        P.position_text(lat, "dms").alias("latitude_dms"),
        P.position_text(lon, "dms").alias("longitude_dms"),
        P.signed_degrees_text(lat).alias("latitude_text"),
        P.signed_degrees_text(lon).alias("longitude_text"),
    )


def readouts(lines: DataFrame) -> DataFrame:
    """What a display shows of each RMC sentence with a position: decimal degrees, the speed in every unit, day first."""
    rows = decode(lines, columns=["latitude", "longitude", "speed_knots", "date"], kinds=["RMC"]).where("has_fix")
    return rows.select(
        "device_id",
        *ORDER,
        *[P.position_text(F.col(c), "dd").alias(f"{c}_dd") for c in ("latitude", "longitude")],
        *[P.speed_text(F.col("speed_knots"), unit).alias(f"speed_{unit}") for unit in ("kph", "mph", "knot")],
        P.date_text(F.col("date"), "s_dmy").alias("date_dmy"),
    )


def _line_bucket() -> Column:
    return F.expr(f"seq div {BUCKET_LINES}")


def receiver_state(lines: DataFrame, hour_offset: int = 0, columns: list[str] | None = None) -> DataFrame:
    """The receiver's values after each clean, supported sentence; before the first one of a kind, the initial ones.

    With a ``ts`` column there is also ``ms_since_fix``: event time since the last sentence with a fix, -1 before it.
    """
    columns = columns or list(INITIAL_STATE)
    timed = ["ts"] if "ts" in lines.columns else []
    return state_of(decode(lines, hour_offset, columns), columns, ["kind", "parsed", *timed])


def state_of(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The same from decoded sentences, with the columns ``keep`` of them."""
    carried, timed = list(columns), "ts" in rows.columns
    if timed:
        rows, carried = rows.withColumn("fix_ts", F.when(F.col("has_fix"), F.col("ts"))), [*carried, "fix_ts"]
    out = list(dict.fromkeys(["device_id", *ORDER, *keep, *(["ts"] if timed else [])]))
    state = carry_forward(rows.select(*out, *carried), ["device_id"], ORDER, _line_bucket(), carried)
    cols: list[Column] = [F.col(c) for c in ["device_id", *ORDER, *keep]]
    cols += [F.coalesce(F.col(c), F.expr(INITIAL_STATE[c])).alias(c) for c in columns]
    if timed:
        micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("fix_ts").cast("timestamp"))
        cols.append(F.coalesce(micros / F.lit(1000.0), F.lit(-1.0)).alias("ms_since_fix"))
    return state.select(*cols)


def track(lines: DataFrame, hour_offset: int = 0) -> DataFrame:
    """The state in the forms a display shows: position, speed, course, date and clock as text and numbers."""
    columns = ["time", "date", "latitude", "longitude", "speed_knots", "course", "altitude", "valid", "hdop"]
    state = state_of(decode(lines, hour_offset, columns), columns, ["kind"])
    lat, lon, knots = F.col("latitude"), F.col("longitude"), F.col("speed_knots")
    keep = ["device_id", *ORDER, "kind", "valid", "altitude", "hdop", "course", "speed_knots"]
    keep += ["ms_since_fix"] if "ms_since_fix" in state.columns else []
    return state.select(
        *keep,
        P.signed_degrees_text(lat).alias("latitude_text"),
        P.signed_degrees_text(lon).alias("longitude_text"),
        P.position_text(lat).alias("latitude_ddm"),
        P.position_text(lon).alias("longitude_ddm"),
        P.kmh(knots).alias("speed_kmh"),
        P.mph(knots).alias("speed_mph"),
        P.compass_point(F.col("course")).alias("compass"),
        P.date_text(F.col("date")).alias("date_mdy"),
        P.date_text(F.col("date"), "long").alias("date_long"),
        P.clock_text(F.col("time")).alias("clock"),
    )


def satellite_groups(lines: DataFrame) -> DataFrame:
    """Satellites in view per group of GSV sentences: one row per device, group and satellite.

    A group begins with a sentence numbered 1 (``group_seq`` is its sequence number, NULL before a device's
    first one); a satellite named again within the group replaces what was known of it. ``complete`` tells
    whether the group's last sentence has arrived.
    """
    gsv = decode(lines, columns=["sv_sentences", "sv_sentence", "satellites"], kinds=["GSV"]).where("parsed")
    group = F.when(F.col("sv_sentence") == 1, F.struct("seq", "part")).alias("group")
    start = gsv.select("device_id", *ORDER, "sv_sentences", "sv_sentence", "satellites", group)
    rows = carry_forward(start, ["device_id"], ORDER, _line_bucket(), ["group"])
    keys = ["device_id", "group"]
    seen = rows.select(*keys, *ORDER, "sv_sentences", "sv_sentence", F.posexplode_outer("satellites").alias("at", "sat"))
    # one row per satellite first; the window then only sees a group's different satellites
    newest = seen.groupBy(*keys, F.col("sat.prn").alias("prn")).agg(
        F.max_by("sat", F.struct(*ORDER, "at")).alias("sat"),
        F.max(F.struct(*ORDER, F.col("sv_sentences").alias("n"), F.col("sv_sentence").alias("i"))).alias("end"),
    )
    last = F.max("end").over(W.partitionBy(*keys))
    return (
        newest.withColumn("end", last)
        .where(F.col("prn").isNotNull())
        .select(
            "device_id",
            F.col("group.seq").alias("group_seq"),
            F.col("group.part").alias("group_part"),
            "prn",
            "sat.elevation",
            "sat.azimuth",
            "sat.snr",
            ((F.col("end.n") > 0) & (F.col("end.n") == F.col("end.i"))).alias("complete"),
        )
    )
