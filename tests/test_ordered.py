from __future__ import annotations

import random

import pytest
from conftest import SMALL, plan
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barograph.operators import gps
from barograph.operators.ordered import carry_forward, previous_row
from barograph.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows, one key is NULL, and long stretches of buckets are empty."""
    rng, data = random.Random(5), []
    for seq in rng.sample(range(3000), 900):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        value = rng.choice([None, None, None, rng.randrange(100)])
        text = None if rng.random() < 0.95 else f"t{seq}"
        data.append((key, seq if rng.random() < 0.8 else seq + 50_000, rng.random(), value, text))
    data = list({(k, s): (k, s, a, v, t) for k, s, a, v, t in data}.values())
    return spark.createDataFrame(data, "k string, seq long, tie double, v int, t string").cache()


BUCKET = "seq div 64"


@pytest.mark.parametrize("columns", [["v"], ["seq"], ["seq", "v", "t"]])
def test_previous_row_equals_the_plain_window(rows, columns):
    w = W.partitionBy("k").orderBy("seq")
    want = rows.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])
    got = previous_row(rows, ["k"], ["seq"], F.expr(BUCKET), columns)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_without_key(rows):
    one = rows.groupBy("seq").agg(F.max("v").alias("v"))
    want = one.select("*", F.lag("v").over(W.orderBy("seq")).alias("prev_v"))
    got = previous_row(one, [], ["seq"], F.expr(BUCKET), ["v"])
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_carry_forward_equals_the_plain_window(rows):
    w = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    want = rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("v", "t")})
    got = carry_forward(rows, ["k"], ["seq"], F.expr(BUCKET), ["v", "t"])
    assert got.columns == want.columns
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_rows_that_tie_are_all_kept(spark):
    df = spark.createDataFrame([("a", 1, i) for i in range(20)], "k string, seq long, v int")
    assert previous_row(df, ["k"], ["seq"], F.col("seq"), ["v"]).count() == 20
    assert carry_forward(df, ["k"], ["seq"], F.col("seq"), ["v"]).count() == 20


@pytest.mark.parametrize("name", ["cadence_gaps", "nmea_track", "nmea_receiver", "nmea_satellites"])
def test_one_scan_and_one_decode(spark, name, monkeypatch):
    """Over several splits and buckets; the plan that was run, not the one before adaption."""
    monkeypatch.setattr(gps, "BUCKET_LINES", 64)
    for key, value in (("maxPartitionBytes", "8000"), ("openCostInBytes", "0")):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        df = QUERIES[name](spark, SMALL)
        assert df.collect() is not None
        ran = plan(df).split("== Initial Plan ==")[0]
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert ran.count("FileScan parquet") == 1
    assert ran.count("ReusedExchange") == 1
