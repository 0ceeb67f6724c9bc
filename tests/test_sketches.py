"""Merged daily sketches beside the exact figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.operators.sketches import QUARTILES, daily_sketches, merged_profile


def test_merged_days_are_near_the_exact_profile(spark):
    rows = spark.range(40000).select(
        (F.col("id") * 7919 % 40009).alias("many"),
        F.when(F.col("id") % 4 != 0, F.pow(F.lit(1.0003), F.col("id") % 20000)).alias("skewed"),
        (F.col("id") % 3).cast("int").alias("few"),
        F.when(F.col("id") % 2 == 0, float("nan")).alias("none"),
        F.when(F.col("id") % 9 > 0, F.col("id") % 9).alias("day"),
    )
    columns = ["many", "skewed", "few", "none"]
    days = daily_sketches(rows, F.col("day"), columns)
    assert days.count() == 9 * 4
    got = {r["column"]: r for r in merged_profile(days).collect()}
    for c in columns:
        values = sorted(r[0] for r in rows.select(F.col(c).cast("double")).collect() if r[0] is not None and r[0] == r[0])
        r = got[c]
        assert (r["rows"], r["n_null"]) == (40000, 40000 - len(values))
        if not values:
            assert r["low"] is r["high"] is r["q50"] is None and r["n_distinct"] == 0
            continue
        assert (r["low"], r["high"]) == (values[0], values[-1])
        assert abs(r["n_distinct"] / len(set(values)) - 1) < 0.0325
        for q in QUARTILES:
            found = r[f"q{int(q * 100)}"]
            below, upto = (sum(test(v) for v in values) / len(values) for test in (lambda v: v < found, lambda v: v <= found))
            assert below <= q + 0.01 and upto >= q - 0.01
    assert got["few"]["n_distinct"] == 3


def test_a_day_is_replaced_and_empty_tables_have_no_profile(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, -0.0), (2, 0.0), (2, 9.0)], "day int, v double")
    days = daily_sketches(rows, F.col("day"), ["v"])
    again = daily_sketches(rows.where("day = 2 and v < 9"), F.col("day"), ["v"])
    r = merged_profile(days.where("day <> 2").unionByName(again)).first()
    assert (r["rows"], r["low"], r["high"], r["n_distinct"]) == (3, 0.0, 1.0, 2)
    assert merged_profile(daily_sketches(rows.where("false"), F.col("day"), ["v"])).count() == 0
