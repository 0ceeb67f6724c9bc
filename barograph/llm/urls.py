"""URL filters: the longest rule on a host and all its subdomains and the beginning of a path.

Keys are compared byte by byte. A host's key is its labels in reverse, each with a dot after it; a rule's host and all its
subdomains are then the interval of keys that begin with the rule's key, and intervals nest. All hosts and intervals are
sorted together by ranges of the key. A sweep over that order counts how many intervals are open; the interval open at a
level of that stack is the last one that began at the level, in this range or, carried over, in an earlier one. A second
sweep of the same kind goes over the paths below each of the hosts found, and takes the innermost rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.operators.once import computed_once
from barograph.session import shared_dir

#: (host, path, verdict). The rules that op2 is to judge by.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: In the order of a sweep: an interval begins before a point with the same key.
BEGINS, POINT, ENDS = 0, 1, 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` is ``com.example.www.``"""
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")), "utf-8")


def path_key(of: Column, path: Column) -> Column:
    """A path below the host with the key ``of``. No host has a slash."""
    return F.concat(of, F.encode(F.concat(F.lit("/"), path), "utf-8"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A few rules as a table."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def usable(rules: DataFrame) -> DataFrame:
    """(of, path, r): rules by their host's key, with what a judged url is told of them.

    Rows with a null host, path or verdict, and those whose host is empty or has a slash, are no rules; of rules on the
    same host and path, the smallest verdict holds.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null and host <> '' and not contains(host, '/')")
    rules = rules.groupBy(F.lower("host").alias("host"), "path").agg(F.min("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    told = F.struct(F.length(rule).alias("long"), F.length("host").alias("of_host"), rule.alias("rule"), "verdict")
    return rules.select(host_key(F.col("host")).alias("of"), "path", told.alias("r"))


def in_ranges(spark: SparkSession, points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points, beginnings and ends of intervals in the order of their keys, with the number of the range they are in.

    Points with equal keys are spread over ranges by their whole rows, so no key is one task's.
    """
    none = F.lit(None).cast(points.schema["point"].dataType)
    closed = F.lit(None).cast(intervals.schema["interval"].dataType)
    # no text has the byte FF: every key that begins with an interval's comes before this end, every other one after it
    begin = F.struct(F.col("key"), F.lit(BEGINS).alias("kind"), F.lit(1).alias("step"), F.col("interval"))
    end = F.struct(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(ENDS).alias("kind"), F.lit(-1).alias("step"), closed.alias("interval"))
    edges = intervals.select(F.inline(F.array(begin, end))).select("key", "kind", "step", F.lit(0).cast("long").alias("tie"), none.alias("point"), "interval")
    events = edges.unionByName(points.select("key", F.lit(POINT).alias("kind"), F.lit(0).alias("step"), F.xxhash64("point").alias("tie"), "point", closed.alias("interval")))
    at = shared_dir(spark, "sweep")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, since ranges are drawn by sampling: every use below must see the same ones
    events.repartitionByRange(ranges, "key", "kind", "tie").withColumn("part", F.spark_partition_id()).write.parquet(at)
    return spark.read.parquet(at)


def covering(spark: SparkSession, points: DataFrame, intervals: DataFrame, innermost: bool) -> DataFrame:
    """(point, interval) for each point (key, point) and the intervals (key, interval) whose key its own begins with.

    All of them, or only the innermost. The keys of intervals are different; points may be equal.
    """
    events = in_ranges(spark, points, intervals)
    until = Window.unboundedPreceding
    # one row for each range: how many intervals are open where it begins
    opened = events.where(F.col("step") != 0).groupBy("part").agg(F.sum("step").alias("more"))
    opened = events.select("part").distinct().join(opened, "part", "left")
    before = F.coalesce(F.sum("more").over(Window.orderBy("part").rowsBetween(until, -1)), F.lit(0))
    deep = events.join(opened.select("part", before.alias("before")), "part")
    depth = F.col("before") + F.sum("step").over(Window.partitionBy("part").orderBy("key", "kind").rowsBetween(until, 0))
    deep = deep.withColumn("depth", depth.cast("int")).where((F.col("kind") != ENDS) & (F.col("depth") > 0))

    whole = (F.col("kind") == POINT) & F.lit(not innermost)
    levels = F.explode(F.sequence(F.when(whole, F.lit(1)).otherwise(F.col("depth")), F.col("depth"))).alias("level")
    stack = deep.select("part", levels, "key", "kind", "point", "interval")
    last = F.last("interval", ignorenulls=True).over(Window.partitionBy("part", "level").orderBy("key", "kind").rowsBetween(until, 0))
    found = stack.withColumn("here", last).where(F.col("kind") == POINT)
    # one row for each range and level: the last interval of an earlier range at that level
    begun = stack.groupBy("part", "level").agg(F.max_by("interval", F.when(F.col("kind") == BEGINS, F.col("key"))).alias("begun"))
    carried = F.last("begun", ignorenulls=True).over(Window.partitionBy("level").orderBy("part").rowsBetween(until, -1))
    carried = begun.select("part", "level", carried.alias("carried"))
    return found.join(carried, ["part", "level"], "left").select("point", F.coalesce("here", "carried").alias("interval"))


def judge(urls: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (null if none fits) and verdict; columns of these names are replaced.

    A rule fits its host and all subdomains if the url's path starts with the rule's. The longest text of host and
    path wins; of equally long ones the longer host, then the greater text. A null url, or one without ``://``, has an
    empty host and path and fits no rule. Each different host and path is judged once, so repeated rows are judged
    alike, and all are kept. No other column's name matters, nor are empty tables an error.
    """
    spark = urls.sparkSession
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    row = urls.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{url}`").alias("url"))
    row = computed_once(row, {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).drop("url")
    rules = usable(rules)
    distinct = row.select("host", "path").where("host <> ''").distinct()
    points = distinct.select(host_key(F.col("host")).alias("key"), F.struct("host", "path").alias("point"))
    below = covering(spark, points, rules.select(F.col("of").alias("key"), F.col("of").alias("interval")).distinct(), innermost=False)
    points = below.select(path_key(F.col("interval"), F.col("point.path")).alias("key"), "point")
    fitting = covering(spark, points, rules.select(path_key(F.col("of"), F.col("path")).alias("key"), F.col("r").alias("interval")), innermost=True)
    best = fitting.groupBy("point").agg(F.max("interval").alias("r"))
    best = best.select(F.col("point.host").alias("at_host"), F.col("point.path").alias("at_path"), "r")
    # rows without a host meet nothing; they are spread by their own values instead of being one key
    plain = [F.col(f"row.`{c}`") for c, t in urls.select(*[f"`{c}`" for c in kept]).dtypes if "map<" not in t and "variant" not in t]
    at_host = F.when(F.col("host") == "", F.concat(F.lit("/"), F.xxhash64(*plain).cast("string"))).otherwise(F.col("host"))
    judged = row.withColumn("at_host", at_host).withColumn("at_path", F.col("path")).join(best, ["at_host", "at_path"], "left")
    return judged.select("row.*", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(otherwise)).alias("verdict"))
