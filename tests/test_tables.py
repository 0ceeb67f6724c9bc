"""Dashboard, filters, profile and upkeep over a small hourly table."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from conftest import plan
from pyspark.sql import functions as F

from barograph.operators import dashboard, filters, upkeep
from barograph.operators.profile import column_profile
from barograph.schema import HOURLY_COLUMNS


def hour(at: datetime, count=10, temp=20.0, hum=40.0, press=890.0, board=25.0):
    stats = [None if v is None else v + d for v in (temp, board, hum, press) for d in (-1.0, 0.0, 1.0)]
    return (at, at.date(), at.year, at.month, at.day, at.hour, count, *stats)


@pytest.fixture
def table(spark):
    types = "datetime timestamp_ntz, date date, year int, month int, day int, hour int, count long, "
    types += ", ".join(f"{c} double" for c in HOURLY_COLUMNS[7:])
    return lambda *rows: spark.createDataFrame(list(rows), types)


JAN1, FEB1 = datetime(2024, 1, 31, 23, 59), datetime(2024, 2, 1, 0, 30)


def test_headline_is_previous_minus_latest(table):
    r = dashboard.hour_headline(table(hour(JAN1, temp=20.1, press=889.0), hour(FEB1, temp=20.4, hum=41.25, press=890.26))).first()
    assert (r.avg_bme_temp, r.avg_bme_hum, r.avg_bme_press) == (20.4, 41.25, 890.3)
    assert (r.diff_avg_bme_temp, r.diff_avg_bme_hum, r.diff_avg_bme_press) == (-0.3, -1.25, -1.26)
    other = dashboard.hour_headline(table(hour(JAN1, temp=20.1), hour(FEB1, temp=20.4)), sign="latest_minus_previous").first()
    assert other.diff_avg_bme_temp == 0.3


def test_headline_with_one_hour_and_with_none(table):
    r = dashboard.hour_headline(table(hour(JAN1))).first()
    assert r.avg_bme_temp == 20.0 and r.diff_avg_bme_temp is None
    assert dashboard.hour_headline(table(hour(JAN1)).where("false")).count() == 0


def test_delta_series_crosses_months_and_gaps(table):
    df = dashboard.hour_delta_series(table(hour(JAN1, temp=1.0), hour(FEB1, temp=3.5), hour(datetime(2024, 5, 1, 7), temp=3.0)))
    got = [r.diff_avg_bme_temp for r in df.orderBy("year", "month", "day", "hour").collect()]
    assert got == [None, -2.5, 0.5]


def test_share_sums_to_one_without_a_window(spark):
    df = dashboard.source_share(spark.createDataFrame([("a", 1), ("b", 2), (None, 5)], "source_ip string, messages long"))
    assert sum(r.share for r in df.collect()) == 1.0
    assert "Window" not in plan(df)


def test_heatmaps(table):
    monday, next_monday = datetime(2024, 1, 1, 5), datetime(2024, 1, 8, 5)
    hourly = table(hour(monday, count=1, temp=10.0), hour(next_monday, count=3, temp=20.0), hour(datetime(2024, 1, 7, 5)))
    assert {(r.date, r.hour): r.value for r in dashboard.heatmap_date_hour(hourly).collect()}[(date(2024, 1, 8), 5)] == 20.0
    week = {(r.weekday, r.hour): (r["count"], r.value) for r in dashboard.heatmap_weekday_hour(hourly).collect()}
    assert week == {(1, 5): (4, 17.5), (0, 5): (10, 20.0)}
    wide = dashboard.heatmap_matrix(hourly, "avg_picow_temp").orderBy("date").first()
    assert wide.h05 == 25.0 and wide.h04 is None


def test_chart_columns_are_checked(table):
    assert dashboard.metric_long(table(hour(JAN1)), "hour", ["avg_bme_temp", "max_picow_temp"]).count() == 2
    for bad in ({"x": "count"}, {"metrics": ["avg_bme_hum"]}):
        with pytest.raises(ValueError, match="none of"):
            dashboard.chart_columns(table(hour(JAN1)), **bad)
    with pytest.raises(ValueError, match="none of"):
        dashboard.heatmap_date_hour(table(hour(JAN1)), "count")


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"n{i % 12}" if i else None, None if i == 3 else i / 2, datetime(2024, 1, 1 + i % 15, i % 24)) for i in range(40)]
    return spark.createDataFrame(rows, "i int, name string, x double, at timestamp_ntz").cache()


def ids(df):
    return sorted(r.i for r in df.collect())


def test_one_of_treats_null_as_a_value(people):
    assert ids(filters.apply_filters(people, [filters.OneOf("name", ["n1", None])])) == [0, 1, 13, 25, 37]
    assert ids(filters.apply_filters(people, [filters.OneOf("name", ["n1"])])) == [1, 13, 25, 37]
    assert ids(filters.apply_filters(people, [filters.OneOf("name", [])])) == []


def test_between_takes_both_ends_and_no_nulls(people):
    assert ids(filters.apply_filters(people, [filters.Between("x", 1.0, 2.0)])) == [2, 4]


def test_dates_end_at_midnight_unless_asked(people):
    chosen = filters.DateBetween("at", "2024-01-14", date(2024, 1, 15))
    assert ids(filters.apply_filters(people, [chosen])) == [13, 28]
    whole = filters.DateBetween("at", "2024-01-14", "2024-01-15", end_of_day=True)
    assert ids(filters.apply_filters(people, [whole])) == [13, 14, 28, 29]


def test_text_is_searched_anywhere_and_null_has_a_text(people):
    assert ids(filters.apply_filters(people, [filters.Matches("name", "1$")])) == [1, 11, 13, 23, 25, 35, 37]
    assert ids(filters.apply_filters(people, [filters.Matches("name", "on")])) == [0]
    assert len(ids(filters.apply_filters(people, [filters.Matches("name", "")]))) == 40
    assert filters.apply_filters(people, []) is people


def test_kind_comes_from_the_rows_left_so_far(people):
    assert filters.column_kind(people, "name") == "text"
    assert filters.column_kind(people.where("i < 9"), "name") == "category"
    assert filters.column_kind(people, "x") == "number" and filters.column_kind(people, "at") == "date"
    first = filters.Choice("x", low=0.0, high=4.0)
    # after the first filter few names are left, so the second one is a choice of values
    assert ids(filters.filter_by_choice(people, [first, filters.Choice("name", values=["n5", None])])) == [0, 5]
    # before it there are many, so it is a text search; the three numbers then left are categories without a choice
    assert ids(filters.filter_by_choice(people, [filters.Choice("name", pattern="n5"), first])) == [5, 17, 29]


def test_untouched_widgets(people):
    assert ids(filters.filter_by_choice(people, [filters.Choice("x")])) == [i for i in range(40) if i != 3]
    assert len(ids(filters.filter_by_choice(people, [filters.Choice("name")]))) == 40
    # the last day counts up to its midnight only
    assert ids(filters.filter_by_choice(people, [filters.Choice("at")])) == [i for i in range(40) if i not in (14, 29)]
    assert len(ids(filters.filter_by_choice(people, [filters.Choice("at", dates=("2024-01-01",))]))) == 40


def one_by_one(df, choices):
    """Each kind decided on the rows really left, a job for each."""
    for c in choices:
        kind = filters.column_kind(df, c.column)
        if kind == "category":
            df = df if c.values is None else filters.apply_filters(df, [filters.OneOf(c.column, c.values)])
        elif kind == "number":
            df = df.where(F.col(c.column).between(-1e9 if c.low is None else c.low, 1e9 if c.high is None else c.high))
        elif kind == "date" and c.dates is None:
            first, last = df.agg(F.min(F.to_date(c.column)), F.max(F.to_date(c.column))).first()
            df = filters.apply_filters(df, [filters.DateBetween(c.column, first, last)])
        elif kind == "date":
            df = filters.apply_filters(df, [filters.DateBetween(c.column, *c.dates)])
        else:
            df = filters.apply_filters(df, [filters.Matches(c.column, c.pattern)])
    return df


def test_kinds_in_one_pass_are_those_of_one_filter_after_another(people):
    rng = random.Random(5)
    make = {
        "x": lambda: filters.Choice("x", values=rng.choice([None, [0.5, 1.0, 7.5, None]]), low=rng.choice([None, 1.0, 6.0]), high=rng.choice([None, 9.0, 15.0])),
        "name": lambda: filters.Choice("name", values=rng.choice([None, ["n1", "n3", "n5", None]]), pattern=rng.choice(["", "1", "[2-9]$"])),
        "at": lambda: filters.Choice("at", dates=rng.choice([None, None, ("2024-01-02", "2024-01-12")])),
        "i": lambda: filters.Choice("i", low=rng.choice([None, 2, 15]), high=rng.choice([None, 33])),
    }
    kept = set()
    for _ in range(12):
        choices = [make[c]() for c in rng.choices(list(make), k=rng.randint(1, 5))]
        expected = ids(one_by_one(people, choices))
        kept.add(len(expected))
        assert ids(filters.filter_by_choice(people, choices)) == expected, choices
        assert ids(filters.filter_by_choice(people, choices, block=2)) == expected, choices
    assert len(kept) > 4


def test_number_of_passes(people, monkeypatch):
    passes, decided = [], filters._decided
    monkeypatch.setattr(filters, "_decided", lambda df, choices, limit: passes.append(len(choices)) or decided(df, choices, limit))
    filters.filter_by_choice(people, [filters.Choice("x", low=1.0), filters.Choice("name"), filters.Choice("at")])
    filters.filter_by_choice(people, [filters.Choice("at"), filters.Choice("x")])
    assert passes == [3, 1, 1]
    assert filters.filter_by_choice(people, []) is people


def test_zeros_are_one_value_and_empty_tables_have_categories(spark):
    zeros = spark.createDataFrame([(float(i),) for i in range(9)] + [(-0.0,), (None,)], "x double")
    assert filters.filter_by_choice(zeros, [filters.Choice("x", low=5.0)]).count() == 11
    more = zeros.unionByName(spark.createDataFrame([(float("nan"),)], "x double"))
    assert filters.filter_by_choice(more, [filters.Choice("x", low=5.0, high=8.0)]).count() == 4
    assert filters.filter_by_choice(more.where("x > 1e9 and x < 0"), [filters.Choice("x", low=5.0)]).count() == 0


def test_coerce_datetimes(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('2024-01-02', '2024-01-02', 'x', timestamp'2024-01-01 00:00:00'), (NULL, 'no', 'y', NULL) AS t(a, b, c, d)"
    )
    out = filters.coerce_datetimes(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["timestamp_ntz", "string", "string", "timestamp_ntz"]
    assert out.first().a == datetime(2024, 1, 2)
    late = filters.coerce_datetimes(spark.sql("SELECT '3/4/2024' AS a"), ["d/M/yyyy"])
    assert late.first().a == datetime(2024, 4, 3)


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0, i) for i in range(30)] + [(None, None, 30)], "s string, x double, i int")
    got = {r.column: r for r in column_profile(df).collect()}
    assert (got["s"].kind, got["s"].n_distinct, got["s"].n_null, got["s"].categories) == ("category", 1, 1, "a")
    assert (got["i"].kind, got["i"].n_distinct, got["i"].categories, got["i"].step) == ("number", 31, None, 0.3)
    assert (got["x"].min_value, got["x"].max_value) == ("1.0", "1.0")
    nothing = {r.column: r for r in column_profile(df.where("false")).collect()}
    assert nothing["i"].n_distinct == 0 and nothing["i"].min_value is None


def test_upkeep(table):
    h = [datetime(2024, 1, 1, i) for i in range(4)]
    stored = table(hour(h[0]), hour(h[1]), hour(h[2], count=5))
    fresh = table(hour(h[1]), hour(h[2], count=6), hour(h[3]))
    got = {r.hour: (r.status, r.stored_count, r.fresh_count) for r in upkeep.mart_diff(stored, fresh).collect()}
    assert got == {0: ("stale", 10, None), 1: ("same", 10, 10), 2: ("changed", 5, 6), 3: ("inserted", None, 10)}
    after = upkeep.mart_upsert(stored, fresh)
    assert after.columns == HOURLY_COLUMNS
    assert {r.hour: r["count"] for r in after.collect()} == {0: 10, 1: 10, 2: 6, 3: 10}
    assert {r.hour for r in upkeep.mart_match(stored, fresh).collect()} == {1, 2}
    assert sorted(upkeep.mart_upsert(after, fresh).collect()) == sorted(after.collect())


def test_a_cut_off_hour_never_replaces_a_whole_one(table):
    h = [datetime(2024, 1, 1, i) for i in range(3)]
    stored, fresh = table(hour(h[1])), table(hour(h[0], count=2), hour(h[1], count=3), hour(h[2], count=4))
    begin = F.lit("2024-01-01 01:20:00").cast("timestamp")
    assert {r.hour: r["count"] for r in upkeep.mart_upsert(stored, fresh, begin).collect()} == {0: 2, 1: 10, 2: 4}
    assert {r.hour: r.status for r in upkeep.mart_diff(stored, fresh, begin).collect()} == {0: "inserted", 1: "stale", 2: "inserted"}
    assert {r.hour: r["count"] for r in upkeep.mart_upsert(stored, fresh, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()}[1] == 3


def test_a_null_measure_is_the_same_as_a_null_measure(table):
    empty = hour(datetime(2024, 1, 1), temp=None)
    assert upkeep.mart_diff(table(empty), table(empty)).first().status == "same"
    assert dashboard.heatmap_weekday_hour(table(empty)).first().value is None


def test_expressions(spark):
    from barograph.functions import values

    sizes = [0, 1023, 1024, 50304, 1253656, 1253656678, 1024**6 - 1024**5, 1024**6]
    df = spark.createDataFrame([(float(s),) for s in sizes], "s double").select(values.size_text(F.col("s")).alias("t"))
    assert [r.t for r in df.collect()] == ["0.00B", "1023.00B", "1.00KB", "49.12KB", "1.20MB", "1.17GB", "1023.00PB", None]
    one = spark.range(1).select(
        values.status_text(F.lit(0)), values.status_text(F.lit(3)), values.online_text(F.lit(True)),
        values.port_list(F.array(F.lit("80/tcp"), F.lit("9092/tcp"))),
    ).first()
    assert tuple(one) == ("Good", "Bad", "ONLINE", "80,9092")
    edges = spark.createDataFrame([(v,) for v in (5.0, 10.0, 10.5, 30.0, 50.0, 51.0, None)], "v double")
    got = [r.b for r in edges.select(values.band(F.col("v"), [10, 20, 30, 50], ["red", "orange", "yellow", "green", "over"]).alias("b")).collect()]
    assert got == ["red", "red", "orange", "yellow", "green", "over", None]
