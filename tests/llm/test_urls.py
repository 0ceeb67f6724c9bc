"""The sweep of url filters beside a plain loop over all rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barograph.llm import urls


def plain(url, rules):
    before, found, rest = (url or "").partition("://")
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]) if found else ""
    path = rest[cut:].split("?")[0].split("#")[0] if found else ""
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


@pytest.fixture
def partitions(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", usual)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_nested_hosts_and_paths_over_ranges(spark, partitions, ranges):
    """Deep nesting in hosts and paths at once; with 16 ranges most stacks are carried from an earlier one."""
    partitions(ranges)
    rng = random.Random(5)
    labels, steps = ["a", "b", "ab", "", "é", "\U0010ffff"], ["/", "x", "y/", "/é", "xy"]
    some = lambda parts, n, by: by.join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    rules = {(some(labels, 4, "."), some(steps, 4, "")): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [("a", "", "block"), ("b.a", "", "allow")]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    given = ["http://" + some(labels, 6, ".") + rng.choice(["", "/"]) + some(steps, 6, "") + rng.choice(["", "?q", "#r"]) for _ in range(700)]
    given += ["http://a/x"] * 100 + [None, "", "a/b"] * 30
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block"), ("a", "/", None), ("a/b", "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, table).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(given)}


def test_one_host_is_not_one_task(spark, partitions):
    partitions(8)
    points = spark.range(4000).select(F.encode(F.lit("com.one."), "utf-8").alias("key"), F.struct(F.lit("one.com").alias("host"), F.col("id").cast("string").alias("path")).alias("point"))
    intervals = spark.createDataFrame([("com.",), ("com.one.",)], "k string").select(F.encode("k", "utf-8").alias("key"), F.col("k").alias("interval"))
    rows = urls.covering(spark, points, intervals, innermost=False)
    assert {r["interval"]: r["count"] for r in rows.groupBy("interval").count().collect()} == {"com.": 4000, "com.one.": 4000}
    parts = [r["count"] for r in urls.in_ranges(spark, points, intervals).groupBy("part").count().collect()]
    assert len(parts) == 8 and max(parts) < 1000
    assert rows.groupBy("point").count().where("count <> 2").count() == 0
    assert urls.covering(spark, points, intervals, innermost=True).select("interval").distinct().collect()[0][0] == "com.one."


def test_columns_with_clashing_names_keep_their_values(spark):
    names = ["row", "at_host", "at_path", "r", "point", "interval", "key", "part", "level", "a.b"]
    pages = spark.createDataFrame([(1, "http://example.com/en/1"), (2, None)], "page_id long, url string")
    pages = pages.select("*", *[F.concat(F.lit(n), "page_id").alias(n) for n in names], F.create_map(F.lit("k"), "page_id").alias("m"))
    out = urls.judge(pages, urls.rule_table(spark))
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    for r in out.collect():
        assert all(r[n] == f"{n}{r['page_id']}" for n in names) and r["m"] == {"k": r["page_id"]}
        assert r["verdict"] == ("block" if r["page_id"] == 1 else "allow")
