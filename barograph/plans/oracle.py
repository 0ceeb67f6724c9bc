"""The SQL that must give the same results, worked out from the columns of ``events`` alone.

No statement parses a document or a sentence: it states what the parsed values must be. Measures are whole
hundredths, and means are rounded half up by whole-number division, so nothing depends on the order of rows.
"""

from __future__ import annotations

from barograph.sources.events import TURNED, TYPICAL

_EVENTS = r"""
e AS (
  SELECT event_id AS n, ts, user_id AS u, '192.168.1.' || user_id AS ip,
         CAST(regexp_extract(props, '\d+') AS INTEGER) AS k,
         CAST(round(value * 100) AS BIGINT) AS c
  FROM events
),
"""

_READ = (
    _EVENTS
    + """
m AS (
  SELECT *, k * 100 + 50 AS h, (870 + u % 50) * 100 + 25 AS b, c + 225 AS p FROM e
),
r AS (SELECT * FROM m WHERE n > 2 AND n % 97 <> 13 AND n % 89 <> 7),
"""
)


def _mean(total: str, n: str) -> str:
    return f"((2 * ({total}) + ({n})) // (2 * ({n}))) / 100.0"


def _hours(name: str, rows: str) -> str:
    measures = ", ".join(
        f"min({c}) / 100.0 AS min_{m}, {_mean(f'sum({c})', 'count(*)')} AS avg_{m}, max({c}) / 100.0 AS max_{m}"
        for m, c in (("bme_temp", "c"), ("picow_temp", "p"), ("bme_hum", "h"), ("bme_press", "b"))
    )
    return f"""
{name} AS (
  SELECT max(ts) AS datetime, CAST(date_trunc('hour', ts) AS DATE) AS date,
         CAST(year(date_trunc('hour', ts)) AS INTEGER) AS year, CAST(month(date_trunc('hour', ts)) AS INTEGER) AS month,
         CAST(day(date_trunc('hour', ts)) AS INTEGER) AS day, CAST(hour(date_trunc('hour', ts)) AS INTEGER) AS hour,
         count(*) AS count, {measures}
  FROM {rows} GROUP BY date_trunc('hour', ts)
)"""


_HOURLY = "WITH " + _READ + _hours("hourly", "r")
_SOURCES = "WITH " + _READ + "by_source AS (SELECT ip AS source_ip, count(*) AS messages FROM r GROUP BY ip)"

_LIVE = (
    "WITH "
    + _READ
    + """
live AS (
  SELECT ts AS "timestamp", 0 AS "partition", n AS "offset",
         year(ts) || '-' || month(ts) || '-' || day(ts) || ' ' || hour(ts) || ':' || minute(ts) || ':' || second(ts) AS time,
         c / 100.0 AS bme_280_temperature, h / 100.0 AS bme_280_humidity, b / 100.0 AS bme_280_pressure,
         p / 100.0 AS picow_temperature,
         (50000 + n % 1000 * 16) / 1024.0 AS picow_mem_alloc_bytes,
         (150000 - n % 1000 * 16) / 1024.0 AS picow_mem_free_bytes,
         CAST(409.5 AS DOUBLE) AS picow_free_storage_kb, CAST(125.0 AS DOUBLE) AS picow_free_cpu_freq_mhz,
         ip AS picow_local_ip
  FROM m WHERE n % 97 <> 13
)"""
)

_STORED_FRESH = (
    "WITH "
    + _READ
    + "s AS (SELECT * FROM r WHERE ts <= (SELECT max(ts) FROM r) - INTERVAL 90 MINUTE),"
    + "w AS (SELECT * FROM r WHERE ts >= date_trunc('hour', (SELECT max(ts) FROM r) - INTERVAL 7 DAY)),"
    + _hours("stored", "s")
    + ","
    + _hours("fresh", "w")
)

_POINTS = (
    "{live} SELECT picow_local_ip, \"timestamp\", \"partition\", \"offset\", time, bme_280_temperature, "
    "picow_temperature, bme_280_pressure, CAST(30 - rn AS INTEGER) AS slot FROM ("
    "SELECT *, row_number() OVER ({part} ORDER BY \"timestamp\" DESC, \"partition\" DESC, \"offset\" DESC) AS rn FROM live) WHERE rn <= 30"
)
_ALL_POINTS = (
    "{live} SELECT * EXCLUDE (rn), CAST(30 - rn AS INTEGER) AS slot FROM ("
    "SELECT *, row_number() OVER ({part} ORDER BY \"timestamp\" DESC, \"partition\" DESC, \"offset\" DESC) AS rn FROM live) WHERE rn <= 30"
)
_PER_SOURCE = "PARTITION BY picow_local_ip"

_LATEST = _LIVE + (
    ", newest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY picow_local_ip "
    "ORDER BY \"timestamp\" DESC, \"partition\" DESC, \"offset\" DESC) AS rn FROM live) WHERE rn = 1)"
)


def _size(c: str) -> str:
    whens = " ".join(
        f"WHEN {c} < {1024 ** (i + 1)} THEN printf('%.2f', {c} / {float(1024**i)}) || '{u}B'"
        for i, u in enumerate(["", "K", "M", "G", "T", "P"])
    )
    return f"CASE {whens} END"


def _unpivot(metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT datetime, '{m}' AS metric, {m} AS value FROM hourly" for m in metrics)


def _profile(columns: dict[str, str]) -> str:
    def one(name: str, kind: str) -> str:
        step = f"(CAST(max({name}) AS DOUBLE) - CAST(min({name}) AS DOUBLE)) / 100" if kind == "number" else "CAST(NULL AS DOUBLE)"
        few = f"count(DISTINCT {name}) < 10"
        return f"""
SELECT '{name}' AS "column", CASE WHEN {few} THEN 'category' ELSE '{kind}' END AS kind,
       count(DISTINCT {name}) AS n_distinct, count(*) - count({name}) AS n_null,
       CAST(min({name}) AS VARCHAR) AS min_value, CAST(max({name}) AS VARCHAR) AS max_value, {step} AS step,
       CASE WHEN {few} THEN string_agg(DISTINCT CAST({name} AS VARCHAR), '|' ORDER BY CAST({name} AS VARCHAR)) END AS categories
FROM hourly"""

    return " UNION ALL ".join(one(n, k) for n, k in columns.items())


# GPS: what each event's sentence says, and which sentences are clean.
_GPS = (
    "WITH "
    + _EVENTS
    + """
g AS (
  SELECT u AS device_id, n AS seq, ts, k, c / 100.0 AS value, n % 6 AS kind_no,
         ['RMC', 'GLL', 'VTG', 'GGA', 'GSA', 'GSV'][n % 6 + 1] AS kind,
         n % 50 > 1 AS clean, n % 7 <> 0 AS active,
         n % 120 = 66 OR (n % 120 = 67 AND n % 7 <> 0) AS broken,
         CASE WHEN n % 120 = 66 THEN 'nothing' WHEN n % 120 = 67 AND n % 7 <> 0 THEN 'clock'
           ELSE ['RMC', 'GLL', 'VTG', 'GGA', 'GSA', 'GSV'][n % 6 + 1] END AS sets, n % 11 <> 0 AS fixed, 1 + n % 3 AS fix_type,
         u % 90 AS lat_d, (n * 7) % 6000 AS lat_m, CASE WHEN u % 2 = 0 THEN 'N' ELSE 'S' END AS lat_h,
         u % 180 AS lon_d, (n * 11) % 6000 AS lon_m, CASE WHEN u % 3 = 0 THEN 'E' ELSE 'W' END AS lon_h,
         (n % 3600) / 10.0 AS course, k % 13 AS used, k / 10.0 AS hdop, 1 + n // 6 % 3 AS sv_index
  FROM e
),
"""
)


def _signed(d: str, m: str, h: str) -> str:
    return f"CASE WHEN {d} <> 0 THEN printf('%.6f', ({d} + {m} / 100.0 / 60.0) * CASE WHEN {h} IN ('S', 'W') THEN -1.0 ELSE 1.0 END) END"


def _dms(d: str, m: str, h: str) -> str:
    return f"{d} || '° ' || ({m} // 100) || ''' ' || CAST(round(({m} % 100) * 60 / 100.0) AS INTEGER) || '\" ' || {h}"


def _ddm(d: str, m: str, h: str) -> str:
    return f"{d} || '° ' || CAST({m} / 100.0 AS VARCHAR) || ''' ' || {h}"


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 2, '0')"


_CLOCK = "lpad(CAST({h} AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} AS VARCHAR), 2, '0') || ':' || CAST({s} AS VARCHAR)"


def _carried(columns: list[str]) -> str:
    over = "OVER (PARTITION BY device_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return ", ".join(f"last_value({c} IGNORE NULLS) {over} AS {c}" for c in columns)


_TRACK = (
    _GPS
    + """
s AS (
  SELECT device_id, seq, kind, ts,
    CASE WHEN sets IN ('RMC', 'GLL', 'GGA', 'clock') THEN ts END AS clock_ts,
    CASE WHEN sets = 'RMC' THEN ts END AS date_ts,
    CASE WHEN sets IN ('RMC', 'GLL') THEN active END AS valid,
    CASE WHEN sets IN ('RMC', 'GLL') THEN CASE WHEN active THEN lat_d ELSE 0 END WHEN sets = 'GGA' AND fixed THEN lat_d END AS lat_d,
    CASE WHEN sets IN ('RMC', 'GLL') THEN CASE WHEN active THEN lat_m ELSE 0 END WHEN sets = 'GGA' AND fixed THEN lat_m END AS lat_m,
    CASE WHEN sets IN ('RMC', 'GLL') THEN CASE WHEN active THEN lat_h ELSE 'N' END WHEN sets = 'GGA' AND fixed THEN lat_h END AS lat_h,
    CASE WHEN sets IN ('RMC', 'GLL') THEN CASE WHEN active THEN lon_d ELSE 0 END WHEN sets = 'GGA' AND fixed THEN lon_d END AS lon_d,
    CASE WHEN sets IN ('RMC', 'GLL') THEN CASE WHEN active THEN lon_m ELSE 0 END WHEN sets = 'GGA' AND fixed THEN lon_m END AS lon_m,
    CASE WHEN sets IN ('RMC', 'GLL') THEN CASE WHEN active THEN lon_h ELSE 'W' END WHEN sets = 'GGA' AND fixed THEN lon_h END AS lon_h,
    CASE WHEN sets = 'RMC' THEN CASE WHEN active THEN value ELSE 0.0 END WHEN sets = 'VTG' THEN value END AS knots,
    CASE WHEN sets = 'RMC' THEN CASE WHEN active THEN course ELSE 0.0 END WHEN sets = 'VTG' THEN course END AS course,
    CASE WHEN sets = 'GGA' AND fixed THEN value END AS altitude,
    CASE WHEN sets IN ('GGA', 'GSA') THEN hdop END AS hdop,
    CASE WHEN (sets IN ('RMC', 'GLL') AND active) OR (sets = 'GGA' AND fixed) OR (sets = 'GSA' AND fix_type > 1) THEN ts END AS fix_ts
  FROM g WHERE clean
),
f AS (SELECT device_id, seq, kind, ts, """
    + _carried(
        ["clock_ts", "date_ts", "valid", "lat_d", "lat_m", "lat_h", "lon_d", "lon_m", "lon_h", "knots", "course"]
        + ["altitude", "hdop", "fix_ts"]
    )
    + """ FROM s),
t AS (
  SELECT device_id, seq, kind, ts, clock_ts, date_ts, fix_ts, coalesce(valid, false) AS valid,
    coalesce(lat_d, 0) AS lat_d, coalesce(lat_m, 0) AS lat_m, coalesce(lat_h, 'N') AS lat_h,
    coalesce(lon_d, 0) AS lon_d, coalesce(lon_m, 0) AS lon_m, coalesce(lon_h, 'W') AS lon_h,
    CAST(coalesce(knots, 0) AS DOUBLE) AS knots, CAST(coalesce(course, 0) AS DOUBLE) AS course,
    CAST(coalesce(altitude, 0) AS DOUBLE) AS altitude, CAST(coalesce(hdop, 0) AS DOUBLE) AS hdop
  FROM f
)
SELECT device_id, seq, 0 AS part, kind, valid, altitude, hdop, course, knots AS speed_knots,
  CASE WHEN fix_ts IS NULL THEN -1.0 ELSE (epoch_us(ts) - epoch_us(fix_ts)) / 1000.0 END AS ms_since_fix,
"""
    + f"{_signed('lat_d', 'lat_m', 'lat_h')} AS latitude_text, {_signed('lon_d', 'lon_m', 'lon_h')} AS longitude_text,"
    + f"{_ddm('lat_d', 'lat_m', 'lat_h')} AS latitude_ddm, {_ddm('lon_d', 'lon_m', 'lon_h')} AS longitude_ddm,"
    + """
  knots * CAST(1.852 AS DOUBLE) AS speed_kmh, knots * CAST(1.151 AS DOUBLE) AS speed_mph,
  ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW']
    [CAST(floor((course + 11.25) / 22.5) AS INTEGER) % 16 + 1] AS compass,
  CASE WHEN date_ts IS NULL THEN '00/00/00' ELSE strftime(date_ts, '%m/%d/%y') END AS date_mdy,
  CASE WHEN date_ts IS NOT NULL THEN monthname(date_ts) || ' ' || day(date_ts) || CASE
    WHEN day(date_ts) IN (1, 21, 31) THEN 'st' WHEN day(date_ts) IN (2, 22) THEN 'nd'
    WHEN day(date_ts) IN (3, 23) THEN 'rd' ELSE 'th' END || ', ' || year(date_ts) END AS date_long,
  CASE WHEN clock_ts IS NULL THEN '00:00:0.0' ELSE """
    + _CLOCK.format(h="(hour(clock_ts) + 5) % 24", m="minute(clock_ts)", s="CAST(second(clock_ts) AS DOUBLE)")
    + """ END AS clock
FROM t"""
)

_RECEIVER = (
    _GPS
    + """
s AS (
  SELECT device_id, seq, kind, broken,
    CASE WHEN kind = 'GGA' AND fixed THEN value END AS altitude,
    CASE WHEN kind = 'GGA' AND fixed THEN -20.5 END AS geoid_height,
    CASE WHEN kind = 'GGA' THEN used END AS satellites_in_use,
    CASE WHEN kind IN ('GGA', 'GSA') THEN hdop END AS hdop,
    CASE WHEN kind = 'GSA' THEN 2.5 END AS pdop, CASE WHEN kind = 'GSA' THEN 1.5 END AS vdop,
    CASE WHEN kind = 'GGA' THEN CASE WHEN fixed THEN 1 ELSE 0 END END AS fix_stat,
    CASE WHEN kind = 'GSA' THEN fix_type END AS fix_type,
    CASE WHEN kind = 'GSA' THEN (k % 32 + 1) || ' ' || (device_id % 32 + 1) END AS satellites_used,
    CASE WHEN kind = 'GSV' THEN 10 END AS satellites_in_view,
    CASE WHEN kind = 'GSV' THEN 3 END AS sv_sentences, CASE WHEN kind = 'GSV' THEN sv_index END AS sv_sentence
  FROM g WHERE clean
),
f AS (SELECT device_id, seq, kind, broken, """
    + _carried(
        ["altitude", "geoid_height", "satellites_in_use", "hdop", "pdop", "vdop", "fix_stat", "fix_type"]
        + ["satellites_used", "satellites_in_view", "sv_sentences", "sv_sentence"]
    )
    + """ FROM s)
SELECT device_id, seq, 0 AS part, kind, NOT broken AS parsed, """
    + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in ("altitude", "geoid_height", "hdop", "pdop", "vdop"))
    + ", "
    + ", ".join(
        f"CAST(coalesce({c}, {0 if c != 'fix_type' else 1}) AS INTEGER) AS {c}"
        for c in ("satellites_in_use", "fix_stat", "fix_type", "satellites_in_view", "sv_sentences", "sv_sentence")
    )
    + ", coalesce(satellites_used, '') AS satellites_used FROM f"
)

_SATELLITES = (
    _GPS
    + """
v AS (
  SELECT device_id, seq, sv_index, k,
    last_value(CASE WHEN sv_index = 1 THEN seq END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS group_seq
  FROM g WHERE clean AND kind = 'GSV'
),
x AS (
  SELECT *, last_value(sv_index) OVER (PARTITION BY device_id, group_seq ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS end_index FROM v
),
j AS (
  SELECT x.*, i.j, seq % 20 + sv_index * 4 + i.j AS prn FROM x, (SELECT unnest([0, 1, 2, 3]) AS j) i
  WHERE sv_index <> 3 OR i.j < 2
),
n AS (SELECT *, row_number() OVER (PARTITION BY device_id, group_seq, prn ORDER BY seq DESC, j DESC) AS rn FROM j)
SELECT device_id, group_seq, CASE WHEN group_seq IS NOT NULL THEN 0 END AS group_part, CAST(prn AS INTEGER) AS prn,
  CAST(k % 90 AS INTEGER) AS elevation, CAST(device_id % 360 AS INTEGER) AS azimuth,
  CASE WHEN (seq + j) % 5 <> 0 THEN CAST(k % 50 AS INTEGER) END AS snr, end_index = 3 AS complete
FROM n WHERE rn = 1"""
)

_FIXES = (
    _GPS
    + """
f AS (
  SELECT * FROM g WHERE clean AND NOT broken AND ((kind IN ('RMC', 'GLL') AND active) OR (kind = 'GGA' AND fixed))
)
SELECT device_id, seq, 0 AS part, kind, """
    + _CLOCK.format(h="hour(ts)", m="minute(ts)", s="CAST(second(ts) AS DOUBLE)")
    + """ AS time,
  lat_d + lat_m / 100.0 / 60.0 AS latitude, lat_h AS lat_hemisphere,
  lon_d + lon_m / 100.0 / 60.0 AS longitude, lon_h AS lon_hemisphere, """
    + f"{_dms('lat_d', 'lat_m', 'lat_h')} AS latitude_dms, {_dms('lon_d', 'lon_m', 'lon_h')} AS longitude_dms, "
    + f"{_signed('lat_d', 'lat_m', 'lat_h')} AS latitude_text, {_signed('lon_d', 'lon_m', 'lon_h')} AS longitude_text FROM f"
)

_QUALITY = (
    _GPS.rstrip().rstrip(",")
    + """
SELECT device_id, count(*) AS sentences, count(*) FILTER (clean) AS clean, count(*) FILTER (seq % 50 = 1) AS crc_failed,
  count(*) FILTER (seq % 50 = 0) AS bad_hex, CAST(0 AS BIGINT) AS incomplete, count(*) FILTER (clean AND NOT broken) AS parsed, """
    + ", ".join(f"count(*) FILTER (clean AND NOT broken AND kind = '{k}') AS {k.lower()}" for k in ("RMC", "GLL", "VTG", "GGA", "GSA", "GSV"))
    + " FROM g GROUP BY device_id"
)

# The log in chunks: the same, but for the sentences that break off.
_CHUNKS = (
    _QUALITY.replace("n % 50 > 1 AS clean", "n % 50 > 1 AND n % 31 <> 17 AS clean")
    .replace("FILTER (seq % 50 = 1)", "FILTER (seq % 50 = 1 AND seq % 31 <> 17)")
    .replace("FILTER (seq % 50 = 0)", "FILTER (seq % 50 = 0 AND seq % 31 <> 17)")
    .replace("CAST(0 AS BIGINT) AS incomplete", "count(*) FILTER (seq % 31 = 17) AS incomplete")
)
_CHUNK_FIXES = _FIXES.replace("n % 50 > 1 AS clean", "n % 50 > 1 AND n % 31 <> 17 AS clean")


def _calibrated(preshift: bool, select: str, later: str = "") -> str:
    """Compensation in whole numbers of any size; every division rounds down. ``later`` is added to the first constant."""
    d = {n: str(v) for n, v in TYPICAL.items()}
    d["dig_T1"] += later
    d["dig_T1"] += " + u % 100"
    d["dig_P1"] += " + u % 50"
    constants = ", ".join(f"CAST({v} AS HUGEINT) AS {n[4:]}" for n, v in d.items())

    def floor_div(x: str, y: str) -> str:
        # whole division that rounds down: take the non-negative remainder off first
        return f"(({x}) - ((({x}) % ({y})) + ({y})) % ({y})) // ({y})"

    def sh(x: str, n: int) -> str:
        return "(" + floor_div(x, str(2**n)) + ")"

    linear = f"({sh('rt', 3)} - T1 * 2) * {sh('T2', 11)}" if preshift else sh(f"({sh('rt', 3)} - T1 * 2) * T2", 11)
    steps = [
        ("a", f"SELECT u, n, CAST(519888 + c % 40000 AS HUGEINT) AS rt, CAST(415148 - (n * 13) % 14400 AS HUGEINT) AS rp, "
              f"CAST(20000 + k * 200 AS HUGEINT) AS rh, {constants} FROM e"),
        ("b", f"SELECT *, {sh('rt', 4)} - T1 AS td FROM a"),
        ("c1", f"SELECT *, {linear} + {sh(sh('td * td', 12) + ' * T3', 14)} AS fine FROM b"),
        ("d", f"SELECT *, {sh('fine * 5 + 128', 8)} AS temp, fine - 128000 AS v, fine - 76800 AS w FROM c1"),
        ("f", f"SELECT *, v * v * P6 + v * P5 * {2**17} + P4 * {2**35} AS off, "
              f"{sh(f'({2**47} + {sh('v * v * P3', 8)} + v * P2 * {2**12}) * P1', 33)} AS scale FROM d"),
        ("g", f"SELECT *, {floor_div(f'((1048576 - rp) * {2**31} - off) * 3125', 'scale')} AS q FROM f"),
        ("h", f"SELECT *, {sh('q', 13)} AS q13, {sh('P8 * q', 19)} AS q19, "
              f"{sh(f'rh * {2**14} - H4 * {2**20} - H5 * w + 16384', 15)} AS signal, "
              f"{sh(sh('w * H6', 10) + ' * (' + sh('w * H3', 11) + ' + 32768)', 10)} + 2097152 AS slope FROM g"),
        ("i", f"SELECT *, {sh('q + ' + sh('P9 * q13 * q13', 25) + ' + q19', 8)} + P7 * 16 AS press, "
              f"signal * {sh('slope * H2 + 8192', 14)} AS x0 FROM h"),
        ("j", f"SELECT *, {sh('x0', 15)} AS x15 FROM i"),
        ("l", f"SELECT *, x0 - {sh(sh('x15 * x15', 7) + ' * H1', 4)} AS x1 FROM j"),
        ("o", "SELECT u AS device_id, n AS reading_id, CAST(fine AS BIGINT) AS t_fine, CAST(temp AS BIGINT) AS temperature, "
              "CAST(press AS BIGINT) AS pressure, CAST(least(greatest(x1, 0), 419430400) // 4096 AS BIGINT) AS humidity FROM l"),
    ]
    texts = (
        "CAST(temperature / 100.0 AS VARCHAR) || 'C' AS temperature_text, "
        "printf('%d.%02dhPa', pressure // 256 // 100, pressure // 256 % 100) AS pressure_text, "
        "printf('%d.%02d%%', humidity // 1024, humidity * 100 // 1024 - humidity // 1024 * 100) AS humidity_text"
    )
    body = ", ".join(f"{n} AS ({sql})" for n, sql in steps)
    return f"WITH {_EVENTS} {body} " + select.format(texts=texts)


_LINES = [f"{stat}_{m}" for m in ("bme_temp", "picow_temp") for stat in ("min", "avg", "max")]
_HEADLINE = ("avg_bme_temp", "avg_bme_hum", "avg_bme_press")

ORACLE: dict[str, str] = {
    "hourly_rollup": _HOURLY + " SELECT * FROM hourly",
    "hourly_merged": _HOURLY + " SELECT * FROM hourly",
    "messages_by_source": _SOURCES + " SELECT * FROM by_source",
    "parsed_readings": "WITH "
    + _READ.rstrip().rstrip(",")
    + """
SELECT n AS kafka_offset, 0 AS kafka_partition, ts AS kafka_datetime, 'telemetry' AS kafka_topic, CAST(n AS INTEGER) AS id,
  b / 100.0 AS bme280_pressure, c / 100.0 AS bme280_temperature, h / 100.0 AS bme280_humidity,
  date_trunc('second', ts) AS device_datetime, ts AS read_datetime, CAST(ts AS DATE) AS read_date, ip AS picow_local_ip,
  p / 100.0 AS picow_temperature, CAST(50000 + n % 1000 * 16 AS DOUBLE) AS picow_mem_alloc_bytes,
  CAST(150000 - n % 1000 * 16 AS DOUBLE) AS picow_mem_free_bytes, CAST(125.0 AS DOUBLE) AS picow_cpu_freq_mhz,
  CAST(409.5 AS DOUBLE) AS picow_free_storage_kb FROM r""",
    "reject_report": """
SELECT CASE WHEN event_id <= 2 THEN 'warm_up' WHEN event_id % 97 = 13 THEN 'malformed_json' ELSE 'missing_id' END AS reason,
  count(*) AS messages, min(event_id) AS first_offset, max(event_id) AS last_offset
FROM events WHERE event_id <= 2 OR event_id % 97 = 13 OR event_id % 89 = 7 GROUP BY 1""",
    "payload_version_counts": """
SELECT CASE WHEN event_id % 97 = 13 THEN 'bad' WHEN event_id % 89 = 7 THEN 'v1' WHEN event_id % 83 = 5 THEN 'v3' ELSE 'v2' END AS version,
  count(*) AS messages FROM events WHERE event_id > 2 GROUP BY 1""",
    "device_clock_skew": "WITH "
    + _READ.rstrip().rstrip(",")
    + """
SELECT ip AS source_ip, count(*) AS messages, min(epoch_us(ts) % 1000000) AS min_skew_us, max(epoch_us(ts) % 1000000) AS max_skew_us
FROM r GROUP BY ip""",
    "hour_headline": _HOURLY
    + ", t AS (SELECT *, row_number() OVER (ORDER BY year DESC, month DESC, day DESC, hour DESC) AS rn FROM hourly) "
    + "SELECT l.avg_bme_temp, l.avg_bme_hum, (CAST(round(l.avg_bme_press * 100) AS BIGINT) + 5) // 10 / 10.0 AS avg_bme_press, "
    + ", ".join(f"round(q.{m} - l.{m}, 3) AS diff_{m}" for m in _HEADLINE)
    + " FROM (SELECT * FROM t WHERE rn = 1) l LEFT JOIN (SELECT * FROM t WHERE rn = 2) q ON true",
    "hour_delta_series": _HOURLY
    + " SELECT year, month, day, hour, avg_bme_temp, avg_bme_hum, avg_bme_press, "
    + ", ".join(f"round(lag({m}) OVER (ORDER BY year, month, day, hour) - {m}, 3) AS diff_{m}" for m in _HEADLINE)
    + " FROM hourly",
    "source_share": _SOURCES + " SELECT *, messages / CAST(sum(messages) OVER () AS DOUBLE) AS share FROM by_source",
    "heatmap_date_hour": _HOURLY + " SELECT date, hour, avg_bme_temp AS value FROM hourly",
    "heatmap_matrix": _HOURLY
    + " SELECT date, "
    + ", ".join(f"max(avg_picow_temp) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))
    + " FROM hourly GROUP BY date",
    "heatmap_weekday_hour": _HOURLY
    + ", q AS (SELECT *, CAST(round(avg_bme_temp * 100) AS BIGINT) AS v FROM hourly) SELECT CAST(dayofweek(date) AS INTEGER) AS weekday, hour, "
    + f"CAST(sum(count) AS BIGINT) AS count, {_mean('sum(v * count)', 'sum(count)')} AS value FROM q GROUP BY 1, 2",
    "metric_long": _HOURLY + " " + _unpivot(_LINES),
    "column_profile": _HOURLY
    + _profile({"date": "date"} | {c: "number" for c in ("year", "month", "day", "hour", "count", "avg_bme_temp", "max_bme_hum", "min_bme_press")}),
    "sketch_profile": "WITH "
    + _READ
    + "v AS (SELECT 'id' AS \"column\", CAST(n AS DOUBLE) AS value FROM r UNION ALL SELECT 'bme280_temperature', c / 100.0 FROM r) "
    + "SELECT \"column\", count(*) AS rows, count(*) - count(value) AS n_null, min(value) AS low, max(value) AS high, "
    + "true AS distinct_close, true AS quartiles_close FROM v GROUP BY 1",
    "filter_isin": _HOURLY + " SELECT * FROM hourly WHERE hour IN (0, 6, 12, 18)",
    "filter_range": _HOURLY + " SELECT * FROM hourly WHERE avg_bme_temp BETWEEN 40 AND 60",
    "filter_dates": _HOURLY + " SELECT * FROM hourly WHERE datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'",
    "filter_regex": _SOURCES + r" SELECT * FROM by_source WHERE regexp_matches(source_ip, '\.1\.\d*[05]$')",
    "filter_composed": _HOURLY
    + " SELECT * FROM hourly WHERE hour BETWEEN 6 AND 20 AND avg_bme_temp BETWEEN 45 AND 55"
    + " AND datetime BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'",
    "date_cutoff": "WITH "
    + _READ.rstrip().rstrip(",")
    + " SELECT n AS kafka_offset, CAST(n AS INTEGER) AS id, ts AS read_datetime, CAST(ts AS DATE) AS read_date,"
    + " c / 100.0 AS bme280_temperature, ip AS picow_local_ip FROM r WHERE ts < TIMESTAMP '2024-01-14'",
    "live_projection": _LIVE + " SELECT * FROM live",
    "stream_lines": _LIVE
    + """ SELECT "timestamp", "partition", "offset", 'data:{"time":"' || time || '",' || """
    + " || ',' || ".join(
        f"""'"{c}":' || coalesce(CAST({c} AS VARCHAR), 'null')"""
        for c in (
            *("bme_280_temperature", "bme_280_humidity", "bme_280_pressure", "picow_temperature", "picow_mem_alloc_bytes"),
            *("picow_mem_free_bytes", "picow_free_storage_kb", "picow_free_cpu_freq_mhz"),
        )
    )
    + """ || ',"picow_local_ip":' || coalesce('"' || picow_local_ip || '"', 'null') || '}' || chr(10) || chr(10) AS line FROM live""",
    "last_30_points": _ALL_POINTS.format(live=_LIVE, part=""),
    "last_30_per_source": _ALL_POINTS.format(live=_LIVE, part=_PER_SOURCE),
    "latest_reading": _LATEST + " SELECT * FROM newest",
    "latest_source": _LIVE + " SELECT picow_local_ip AS source_ip FROM live ORDER BY \"timestamp\" DESC, \"offset\" DESC LIMIT 1",
    "humidity_band": _LIVE
    + ' SELECT "timestamp", "partition", "offset", picow_local_ip, bme_280_humidity, CASE WHEN bme_280_humidity <= 10 THEN \'red\''
    + " WHEN bme_280_humidity <= 20 THEN 'orange' WHEN bme_280_humidity <= 30 THEN 'yellow' WHEN bme_280_humidity <= 50 THEN 'green'"
    + " ELSE 'over' END AS band, bme_280_humidity / 50.0 AS needle FROM live",
    "memory_split": _LATEST
    + " SELECT picow_local_ip, picow_mem_alloc_bytes AS allocated_kib, picow_mem_free_bytes AS free_kib,"
    + " picow_mem_alloc_bytes / (picow_mem_alloc_bytes + picow_mem_free_bytes) AS allocated_share FROM newest",
    "size_texts": "WITH "
    + _READ
    + "z AS (SELECT n, 50000 + n % 1000 * 16 AS a, (150000 - n % 1000 * 16) * 65536 AS f FROM r) "
    + f"SELECT n AS kafka_offset, {_size('a')} AS allocated, {_size('f')} AS free_times_64k FROM z",
    "source_freshness": "WITH "
    + _READ
    + """z AS (SELECT ip AS source_ip, max(ts) AS last_seen FROM r GROUP BY ip),
q AS (SELECT *, (epoch_us((SELECT max(ts) FROM r)) - epoch_us(last_seen)) / 1000000.0 AS silent_seconds FROM z)
SELECT *, CASE WHEN silent_seconds <= 21600 THEN 'ONLINE' ELSE 'OFFLINE' END AS status FROM q""",
    "topic_profile": """
SELECT 'telemetry' AS topic, 0 AS "partition", min(event_id) AS first_offset, max(event_id) AS last_offset, count(*) AS messages,
  max(event_id) - min(event_id) + 1 - count(*) AS gaps, min(ts) AS first_time, max(ts) AS last_time FROM events""",
    "cadence_gaps": "WITH "
    + _READ
    + """z AS (SELECT ip, ts, lag(ts) OVER (PARTITION BY ip ORDER BY ts, n) AS prev FROM r)
SELECT ip AS source_ip, prev AS gap_start, ts AS gap_end, (epoch_us(ts) - epoch_us(prev)) / 1000000.0 AS gap_seconds
FROM z WHERE epoch_us(ts) - epoch_us(prev) > 3600000000""",
    "top_sources": _SOURCES
    + " SELECT *, CAST(row_number() OVER (ORDER BY messages DESC, source_ip) AS INTEGER) AS place FROM by_source"
    + " ORDER BY messages DESC, source_ip LIMIT 10",
    "mart_match": _STORED_FRESH
    + " SELECT s.datetime, s.count AS stored_count, f.year, f.month, f.day, f.hour, f.count AS fresh_count"
    + " FROM stored s JOIN fresh f ON s.datetime = f.datetime",
    "mart_diff": _STORED_FRESH
    + " SELECT coalesce(s.year, f.year) AS year, coalesce(s.month, f.month) AS month, coalesce(s.day, f.day) AS day,"
    + " coalesce(s.hour, f.hour) AS hour, CASE WHEN s.count IS NULL THEN 'inserted' WHEN f.count IS NULL THEN 'stale'"
    + " WHEN s = f THEN 'same' ELSE 'changed' END AS status, s.count AS stored_count, f.count AS fresh_count"
    + " FROM stored s FULL JOIN fresh f ON s.year = f.year AND s.month = f.month AND s.day = f.day AND s.hour = f.hour",
    "mart_upsert": _STORED_FRESH
    + " SELECT * FROM fresh UNION ALL SELECT s.* FROM stored s WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE"
    + " s.year = f.year AND s.month = f.month AND s.day = f.day AND s.hour = f.hour)",
    "stream_hourly": _HOURLY + " SELECT * FROM hourly",
    "stream_last_30": _POINTS.format(live=_LIVE, part=""),
    "stream_last_30_per_source": _POINTS.format(live=_LIVE, part=_PER_SOURCE),
    "stream_live": _LIVE + " SELECT * FROM live",
    "nmea_quality": _QUALITY,
    "nmea_fixes": _FIXES,
    "nmea_chunks": _CHUNKS,
    "nmea_chunk_fixes": _CHUNK_FIXES,
    "nmea_track": _TRACK,
    "nmea_receiver": _RECEIVER,
    "nmea_receiver_stream": _RECEIVER,
    "nmea_satellites": _SATELLITES,
    "calibrated_readings": _calibrated(True, "SELECT *, {texts} FROM o"),
    "calibrated_datasheet": _calibrated(False, "SELECT *, {texts} FROM o"),
    "calibrate_roundtrip": _calibrated(
        True,
        "SELECT reading_id, temperature / 100.0 AS temperature, pressure // 256 / 100.0 AS pressure,"
        " (humidity * 100 // 1024) / 100.0 AS humidity FROM o",
    ),
}
_VARIED = {"dig_T1": " + user_id % 100", "dig_P1": " + user_id % 50"}
_TURN = " * CASE WHEN user_id % 2 = 1 THEN -1 ELSE 1 END"
ORACLE["calibration_unpacked"] = (
    "SELECT DISTINCT user_id AS device_id, "
    + ", ".join(f"CAST({v}{_VARIED.get(c, '')}{_TURN if c in TURNED else ''} AS INTEGER) AS {c}" for c, v in TYPICAL.items())
    + " FROM events"
)
ORACLE["hourly_job_marts"] = _HOURLY + " SELECT *, (SELECT count(*) FROM r) AS landed FROM hourly"
ORACLE["hourly_stored"] = ORACLE["hourly_rollup"]
ORACLE["sources_exported"] = ORACLE["messages_by_source"]
ORACLE["datetimes_coerced"] = _HOURLY + " SELECT datetime, datetime AS seen, 'h' || hour AS label FROM hourly"
ORACLE["hourly_in_catalog"] = ORACLE["filter_none"] = _HOURLY + " SELECT * FROM hourly"
ORACLE["tables_listed"] = (
    "WITH "
    + _READ.rstrip().rstrip(",")
    + " SELECT DISTINCT 'from_' || ip AS \"TABLE_NAME\" FROM r WHERE CAST(ts AS DATE) = DATE '2024-01-10'"
)
ORACLE["nmea_readouts"] = (
    _GPS.rstrip().rstrip(",")
    + """ SELECT device_id, seq, 0 AS part,
  CAST(lat_d + lat_m / 100.0 / 60.0 AS VARCHAR) || '° ' || lat_h AS latitude_dd,
  CAST(lon_d + lon_m / 100.0 / 60.0 AS VARCHAR) || '° ' || lon_h AS longitude_dd,
  CAST(CAST(value AS DOUBLE) * CAST(1.852 AS DOUBLE) AS VARCHAR) || ' km/h' AS speed_kph,
  CAST(CAST(value AS DOUBLE) * CAST(1.151 AS DOUBLE) AS VARCHAR) || ' mph' AS speed_mph,
  CAST(CAST(value AS DOUBLE) AS VARCHAR) || CASE WHEN value = 1 THEN ' knot' ELSE ' knots' END AS speed_knot,
  strftime(ts, '%d/%m/%y') AS date_dmy
FROM g WHERE clean AND active AND sets = 'RMC'"""
)
ORACLE["stream_landing"] = ORACLE["topic_profile"]
# The stream drops a message if its hour had ended two hours before the newest reading of the batches but the last one:
# Spark compares with the watermark of the batch before. The ledger takes the newest message of all batches before.
_LATE = (
    "WITH "
    + _READ
    + """on_time AS (SELECT max(ts) AS newest FROM m WHERE n % 10 <> 3),
kept_mark AS (SELECT max(ts) AS newest FROM r WHERE n % 10 <> 3 AND n * 4 // ((SELECT max(n) FROM e) + 1) < 3),
k AS (SELECT * FROM r WHERE n % 10 <> 3
  OR date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT date_trunc('millisecond', newest) FROM kept_mark) - INTERVAL 2 HOUR),
"""
)
ORACLE["late_hours_lost"] = _LATE + _hours("hourly", "k") + " SELECT * FROM hourly"
ORACLE["late_hours_repaired"] = (
    _LATE
    + _hours("hourly", "r")
    + """, late AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM m, on_time
  WHERE n % 10 = 3 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= newest - INTERVAL 2 HOUR)
SELECT hourly.*, CASE WHEN late.hour IS NULL THEN 'streamed' ELSE 'repaired' END AS status
FROM hourly LEFT JOIN late ON date_trunc('hour', hourly.datetime) = late.hour"""
)
ORACLE["hourly_incremental"] = ORACLE["hourly_rollup"]
ORACLE["offset_ledger"] = """
WITH e AS (SELECT event_id AS n, max(event_id) OVER () AS most FROM events),
r AS (SELECT n, CASE WHEN n * 2 < most THEN 1 WHEN n * 4 < most * 3 THEN 2 ELSE 3 END AS run FROM e)
SELECT 'telemetry' AS topic, 0 AS "partition", min(n) AS first_offset, max(n) AS last_offset, count(*) AS messages, CAST(run AS INTEGER) AS run
FROM r GROUP BY run"""
ORACLE["missing_offsets"] = """
WITH e AS (SELECT event_id AS n, lag(event_id) OVER (ORDER BY event_id) AS before FROM events
  WHERE event_id % 101 NOT IN (50, 51, 52) AND event_id % 1009 <> 7)
SELECT 'telemetry' AS topic, 0 AS "partition", before + 1 AS first_missing, n - 1 AS last_missing, n - before - 1 AS missing
FROM e WHERE n - before > 1"""
ORACLE["stream_buffer"] = ORACLE["stream_last_30_per_source"]
ORACLE["device_status_changes"] = (
    "WITH "
    + _READ
    + """g AS (SELECT ip, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM r WINDOW w AS (PARTITION BY ip ORDER BY ts, n)),
x AS (SELECT epoch_us(max(ts)) // 1000 AS mark FROM r)
SELECT ip AS source_ip, 'ONLINE' AS status, ts AS at FROM g WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 21600000000
UNION ALL
SELECT ip, 'OFFLINE', ts + INTERVAL 6 HOUR FROM g, x WHERE epoch_us(after) - epoch_us(ts) > 21600000000
  OR (after IS NULL AND (epoch_us(ts) + 21600000000) // 1000 + 1 <= mark)"""
)
ORACLE["stream_live_once"] = ORACLE["live_projection"]
ORACLE["stream_progress"] = (
    "WITH "
    + _READ
    + """x AS (SELECT *, CASE WHEN n % 10 = 3 THEN 4 ELSE n * 4 // ((SELECT max(n) FROM m) + 1) END AS batch,
  n > 2 AND n % 97 <> 13 AND n % 89 <> 7 AS good FROM m)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS messages, count(*) FILTER (good) AS readings, count(*) FILTER (NOT good) AS rejects,
  min(ts) AS first_time, max(ts) AS last_time FROM x GROUP BY batch"""
)
ORACLE["stream_calibrated"] = _calibrated(
    True, "SELECT *, {texts} FROM o", " + CASE WHEN n * 4 // ((SELECT max(event_id) FROM events) + 1) >= 2 THEN 10 ELSE 0 END"
)
