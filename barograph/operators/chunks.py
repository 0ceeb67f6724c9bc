"""A device's text stream that was cut into rows anywhere, put together so that each sentence is whole.

A sentence begins at a dollar sign. What a row has before its first one, or all of it if it has none, goes on with the
sentence that an earlier row began. Rows are dealt out by device and bucket of the sequence, as in ``ordered``: within a
bucket a sentence is put together from its rows; of a bucket's last sentence, the rest comes from the beginnings of the
buckets after it, through a table with one row for each bucket. A sentence has a greatest length, so nothing grows
with the noise that may follow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barograph.functions.sentences import LAST_CHECKSUM_CHARACTER
from barograph.operators.ordered import _BUCKET, _GROUP, _dealt

#: Characters after a dollar sign that can still belong to its sentence.
REACH = LAST_CHECKSUM_CHARACTER


def _reach_before(length: Column, window) -> Column:
    """How many characters have come before this row's."""
    return F.coalesce(F.sum(length).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _in_order(place: Column, text: Column) -> Column:
    """An aggregate: texts joined in the order of ``place``; nulls are left out."""
    listed = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(place.alias("place"), text.alias("text")))))
    return F.left(F.array_join(F.transform(listed, lambda x: x["text"]), ""), F.lit(REACH))


def rejoined(lines: DataFrame, bucket: Column) -> DataFrame:
    """``lines`` (device_id, seq, line and others) with a row for each row that a sentence begins in.

    ``line`` goes from its first dollar sign to the end of the last sentence that begins in it, wherever that is; the
    other columns are that row's. Rows without a beginning only go on with others and have no row of their own.
    Characters that no sentence has are taken out.
    """
    extra = [c for c in lines.columns if c not in ("device_id", "seq", "line")]
    text = F.regexp_replace(F.coalesce("line", F.lit("")), r"[^\x0A-\x7E]", "")
    start = F.locate("$", F.col("text"))
    rows = lines.select("device_id", "seq", F.struct(F.lit(0).alias("_"), *extra).alias("row"), text.alias("text"))
    rows = rows.select(
        "device_id",
        "seq",
        "row",
        F.left(F.when(start > 0, F.left("text", start - 1)).otherwise(F.col("text")), F.lit(REACH)).alias("head"),
        F.when(start > 0, F.substring("text", start, F.length("text"))).alias("own"),
    )
    rows = _dealt(rows.where("own is not null or head <> ''"), ["device_id"], bucket)

    before = W.partitionBy(_GROUP).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    opened = rows.withColumn("open", F.last(F.when(F.col("own").isNotNull(), F.col("seq")), ignorenulls=True).over(before))
    reach = _reach_before(F.length("head"), W.partitionBy(_GROUP, "open").orderBy("seq"))
    opened = opened.withColumn("head", F.when((reach < REACH) & (F.col("head") != ""), F.col("head")))
    # each row is the beginning of its own sentence and goes on with an earlier one
    own = F.struct(F.col("seq").alias("open"), F.struct("row", "own").alias("first"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("head"))
    more = F.struct(F.col("open"), F.lit(None).cast(opened.select(F.struct("row", "own")).schema[0].dataType).alias("first"), F.col("seq"), F.col("head"))
    parts = opened.select(_GROUP, F.inline(F.array_compact(F.array(F.when(F.col("own").isNotNull(), own), F.when(F.col("head").isNotNull(), more)))))
    sentences = parts.groupBy(_GROUP, "open").agg(F.max("first").alias("first"), _in_order(F.col("seq"), F.col("head")).alias("rest"))

    # one row for each bucket: its last beginning, and what it has before its first one
    ends = sentences.groupBy(_GROUP).agg(F.max(F.struct("open", "first")).alias("last"), F.max(F.when(F.col("open").isNull(), F.col("rest"))).alias("lead"))
    device, at = F.col(f"{_GROUP}.device_id"), F.col(f"{_GROUP}.{_BUCKET}")
    ends = ends.select(device.alias("device_id"), at.alias("at"), F.col("last.open").alias("open"), "lead")
    earlier = W.partitionBy("device_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("from", F.last(F.when(F.col("open").isNotNull(), F.struct("at", "open")), ignorenulls=True).over(earlier))
    ends = ends.where("from is not null and lead is not null")
    reach = _reach_before(F.length("lead"), W.partitionBy("device_id", "from").orderBy("at"))
    carried = ends.withColumn("reach", reach).where(F.col("reach") < REACH)
    carried = carried.groupBy("device_id", "from").agg(_in_order(F.col("at"), F.col("lead")).alias("carried"))
    carried = carried.select(F.struct("device_id", F.col("from.at").alias(_BUCKET)).alias(_GROUP), F.col("from.open").alias("last"), "carried")

    whole = sentences.where("open is not null").join(carried, _GROUP, "left")
    carried_on = F.when(F.col("open") == F.col("last"), F.col("carried"))
    line = F.concat("first.own", F.left(F.concat("rest", F.coalesce(carried_on, F.lit(""))), F.lit(REACH)))
    return whole.select(device.alias("device_id"), F.col("open").alias("seq"), *[F.col(f"first.row.{c}").alias(c) for c in extra], line.alias("line"))
