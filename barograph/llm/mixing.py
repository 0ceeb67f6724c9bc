"""Mixing sources to target weights along a curriculum.

Each source has a weight that changes over training. Its integral says how much of the mix the source gets, and its
inverse says when the source's next word is due: a document's place in its source's stream of words gives the moment
of training at which it is read. All of it is SQL functions; running sums go over slices of a source, never over a
whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm.textbatch import WORD
from barograph.session import shared_dir

#: Weights over training time 0 to 1, as (time, weight) knots with straight lines between; sources take them in turn.
#: Their integrals are 3, 1 and 2: the first is strong early, the third late.
CURRICULUM = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))

#: Words of the mix for each word there is, and the most passes over a document.
SHARE, MOST_PASSES = 1.5, 2

#: Hex digits of a document's hash that name its slice: 4096 slices of each source.
SLICE_DIGITS = 3


def area(knots) -> float:
    """The integral of a weight schedule."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def moment(share: Column, knots) -> Column:
    """The time by which a schedule has given out this share of its integral: its cumulative demand, inverted."""
    whole, before, out = area(knots), 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        due = share * F.lit(whole) - F.lit(before)
        # w0 dt + (w1 - w0) / (t1 - t0) dt^2 / 2 = due, solved without a division by the slope
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * due))
        at = F.when(root + F.lit(w0) > 0, F.lit(t0) + F.lit(2.0) * due / (F.lit(w0) + root)).otherwise(F.lit(t0))
        out = at if out is None else F.when(share * F.lit(whole) >= F.lit(before), at).otherwise(out)
        before += (t1 - t0) * (w0 + w1) / 2
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def place(docs: DataFrame) -> DataFrame:
    """``docs`` with its order in its source (``__order``, a hash of doc_id) and ``size``, its number of words (long)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.withColumn("__order", key).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(placed: DataFrame, curriculum=CURRICULUM, share: float = SHARE, most_passes: int = MOST_PASSES) -> DataFrame:
    """A row for each source: its size, turn in the curriculum and target.

    The total is shared by weight; a source gets no more than ``most_passes`` times its size, and what it can't take
    goes to the others by weight. Filling sources in the order of limit / weight, the common level is the largest of
    (what is left) / (weights left). Works on one row for each source.
    """
    weights = F.array(*[F.lit(float(area(k))) for k in curriculum])
    per = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("turn", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(curriculum))
    per = per.withColumn("weight", F.get(weights, F.col("turn"))).withColumn("most", F.col("source_size") * F.lit(most_passes))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    left = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    per = per.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - below) / left)
    return per.select("source", "source_size", "turn", F.least(F.col("most").cast("double"), F.max("level").over(everything) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, sized: DataFrame, curriculum=CURRICULUM, share: float = SHARE, most_passes: int = MOST_PASSES) -> DataFrame:
    """How much of each document the mix takes, and when.

    docs: rows of ``place()``, of which all columns are kept. sized: the same rows, of which only source, size and
    __order are read, for the sums. Adds source_size, target (double), taken (long: words the mix takes, repeats
    counted), position (when in training the document is first read, 0 to 1; null if not at all) and position_again
    (when it is read once more).

    Each source is read in the order of the hash of doc_id, as often as its target asks; the last pass stops in the
    middle of a document when the target is reached, so a source's words are its target but for a fraction of one.
    Null texts have size 0 and are never read. A null source is a source of its own, the last one. Repeated rows
    follow each other. An empty table gives no rows.
    """
    named = [F.col("source").isNull().alias("__none"), F.coalesce(F.col("source"), F.lit("")).alias("__source"), F.substring("__order", 1, SLICE_DIGITS).alias("__slice")]
    docs = docs.drop("source_size", "target", "taken", "position", "position_again")
    sums = sized.groupBy("source", F.substring("__order", 1, SLICE_DIGITS).alias("slice")).agg(F.sum("size").alias("in_slice"))
    per_source = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_slice").over(per_source), F.lit(0)))
    targets = source_targets(sized, curriculum, share, most_passes)
    sums = sums.alias("a").join(targets.alias("b"), F.expr("a.source <=> b.source")).select(
        F.col("a.source").isNull().alias("__none"), F.coalesce("a.source", F.lit("")).alias("__source"), F.col("slice").alias("__slice"), "ahead", "source_size", "turn", "target"
    )
    df = docs.select("*", *named).join(sums, ["__none", "__source", "__slice"])
    running = Window.partitionBy("__none", "__source", "__slice").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__ahead", F.col("ahead") + F.sum("size").over(running) - F.col("size"))
    goal = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    df = df.withColumn("__goal", goal).withColumn("__full", full)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__goal") - F.col("__full") * F.col("source_size") - F.col("__ahead")))
    df = df.withColumn("taken", F.col("size") * F.col("__full") + extra)
    when_due = lambda words: F.coalesce(*[F.when(F.col("turn") == k, moment(words / F.col("__goal"), s)) for k, s in enumerate(curriculum)])
    df = df.withColumn("position", F.when(F.col("taken") > 0, when_due(F.col("__ahead"))))
    df = df.withColumn("position_again", F.when(F.col("taken") > F.col("size"), when_due(F.col("source_size") + F.col("__ahead"))))
    return df.drop("__none", "__source", "__slice", "__order", "__ahead", "__goal", "__full", "ahead", "turn")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Sorted by range of first position; documents that the mix leaves out come last, spread over ranges by size and id."""
    return mixed.orderBy(F.coalesce("position", F.lit(2.0)), "size", "doc_id")


def mix_sizes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix without texts: doc_id, size, source_size, target, taken, position, position_again, in training order.

    Sizes are counted once and written to the shared folder: the texts are read a single time.
    """
    at = shared_dir(spark, "mix-sizes")
    place(docs.select("doc_id", "source", "text")).drop("text").write.parquet(at)
    sized = spark.read.parquet(at)
    return in_training_order(mix(sized, sized).drop("source"))


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of the mix, repeated as often as it reads them, in training order; columns as they were.

    A document is in a pass if the mix takes at least half of its words there; one without words is left out. Columns may
    have any names.
    """
    at = shared_dir(spark, "mix-sizes")
    place(docs.select("doc_id", "source", "text")).drop("text").write.parquet(at)
    # the caller's row goes along as one struct, so that none of its names meets one used here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    mixed = mix(place(docs.select("doc_id", "source", "text", row)).drop("text"), spark.read.parquet(at))
    first = F.when((F.col("taken") > 0) & (2 * F.least(F.col("taken"), F.col("size")) >= F.col("size")), F.col("position"))
    again = F.when(2 * F.col("taken") >= 3 * F.col("size"), F.col("position_again"))
    read = mixed.withColumn("__position", F.explode(F.filter(F.array(first, again), lambda p: p.isNotNull())))
    return read.orderBy("__position", "doc_id").select("__row.*")
