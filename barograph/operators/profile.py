"""What the filter controls need to know of each column, in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.operators.filters import CATEGORY_LIMIT


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.NumericType, T.BooleanType)):
        return "number"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def _as_text(c: str, t: T.DataType) -> Column:
    return F.col(c).cast("timestamp_ntz").cast("string") if isinstance(t, T.TimestampType) else F.col(c).cast("string")


def column_profile(df: DataFrame, columns: list[str] | None = None, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Per column: kind, distinct values (NULL not counted), NULLs, smallest, largest, slider step, categories.

    Distinct values are found by grouping (column, value) pairs, so no task holds a column's value set; the
    values themselves are listed only for columns with fewer than ``limit`` of them.
    """
    columns = columns or df.columns
    types = {c: df.schema[c].dataType for c in columns}
    texts = df.select(*[_as_text(c, types[c]).alias(c) for c in columns])
    pairs = (
        texts.unpivot([], columns, "column", "text")
        .groupBy("column", "text")
        .agg(F.count("*").alias("rows"))
    )
    counts = pairs.groupBy("column").agg(
        F.count("text").alias("n_distinct"), F.sum(F.when(F.col("text").isNull(), F.col("rows")).otherwise(0)).alias("n_null")
    )
    first = (
        pairs.where("text IS NOT NULL")
        .withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy("text")))
        .where(F.col("rank") < limit)
        .groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list("text")), "|").alias("categories"))
    )
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])

    def row(c: str) -> Column:
        low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
        step = (high.cast("double") - low.cast("double")) / 100 if _kind(types[c]) == "number" else F.lit(None)
        return F.struct(
            F.lit(c).alias("column"),
            F.lit(_kind(types[c])).alias("type_kind"),
            _as_text(f"min_{c}", types[c]).alias("min_value"),
            _as_text(f"max_{c}", types[c]).alias("max_value"),
            step.cast("double").alias("step"),
        )

    ranges = ends.select(F.inline(F.array(*[row(c) for c in columns])))
    few = F.col("n_distinct") < limit
    return (
        ranges.join(counts, "column", "left")
        .join(first, "column", "left")
        .select(
            "column",
            F.when(few, "category").otherwise(F.col("type_kind")).alias("kind"),
            F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
            F.coalesce("n_null", F.lit(0)).alias("n_null"),
            "min_value",
            "max_value",
            "step",
            F.when(few, F.col("categories")).alias("categories"),
        )
    )
