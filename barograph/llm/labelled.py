"""Bounded samples of labelled documents, from which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.session import shared_dir


def remainder(by: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod ``by``; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """(text, label) of at most ``per_class`` documents of either label, written to the shared folder.

    The documents with the smallest hashes of doc_id are taken, among those whose id ``learn`` admits. Rows with a null
    id or a label other than 0 and 1 don't count; of several labels of a document the largest holds, and of several
    texts one. The list of ids is broadcast: it has no more than twice ``per_class`` rows, whatever the tables have.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("label = 0").orderBy(*order).limit(per_class).unionByName(known.where("label = 1").orderBy(*order).limit(per_class))
    at = shared_dir(spark, f"sample-{label}")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    found.select(F.coalesce("text", F.lit("")).alias("text"), "label").write.parquet(at)
    return spark.read.parquet(at)
