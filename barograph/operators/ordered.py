"""Row order within a key, for keys of any size.

A plain window over one key puts all rows of that key into one task. Here each key is cut into buckets along its
order, the window runs per key and bucket, and what a bucket needs from those before it comes from a small summary
with one row per key and bucket. The result is that of the plain window.

Rows are dealt out by key and bucket once. The summary is taken from the same shuffle, of which it names all columns:
Catalyst would otherwise cut its columns down to a shuffle of its own and compute the input twice. For the same reason
hand in only columns that are used afterwards.

``order`` must tell all rows of a key apart and ``bucket`` must not fall as the order rises.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUCKET, _GROUP, _CARRIED = "_bucket", "_group", "_carried"


def _dealt(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Rows by key and bucket. As a struct the two are never NULL as a whole, so NULL keys join like others."""
    return df.withColumn(_GROUP, F.struct(*keys, bucket.alias(_BUCKET))).repartition(_GROUP)


def _rank_key(order: list[str]) -> Column:
    return F.struct(*order)


def _full_rank_key(df: DataFrame, order: list[str]) -> Column:
    """Ranks as ``order`` does, which tells all rows apart, and names all columns that can be compared."""
    rest = [f.name for f in df.schema if f.name not in order and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.struct(*order, *rest)


def _buckets_before(keys: list[str]):
    return W.partitionBy(*[F.col(f"{_GROUP}.{k}") for k in keys]).orderBy(F.col(f"{_GROUP}.{_BUCKET}"))


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Each row with ``columns`` of the row before it in its key; NULLs on a key's first row."""
    rows = _dealt(df, keys, bucket)
    last = rows.groupBy(_GROUP).agg(F.max_by(F.struct(*columns), _full_rank_key(df, order)).alias(_CARRIED))
    carried = last.select(_GROUP, F.lag(_CARRIED).over(_buckets_before(keys)).alias(_CARRIED))
    within = rows.withColumn("_previous", F.lag(F.struct(*columns)).over(W.partitionBy(_GROUP).orderBy(*order)))
    both = within.join(carried.where(F.col(_CARRIED).isNotNull()), _GROUP, "left")
    both = both.withColumn("_previous", F.coalesce("_previous", _CARRIED))
    return both.select(*df.columns, *[F.col(f"_previous.{c}").alias(prefix + c) for c in columns])


def carry_forward(df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: list[str]) -> DataFrame:
    """Each row with NULLs in ``columns`` replaced by the key's last value before it, if there is one."""
    rows = _dealt(df, keys, bucket)
    ranks = {c: _rank_key(order) if i else _full_rank_key(df, order) for i, c in enumerate(columns)}
    last = rows.groupBy(_GROUP).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), ranks[c])).alias(c) for c in columns])
    before = _buckets_before(keys).rowsBetween(W.unboundedPreceding, -1)
    found = {c: F.last(c, ignorenulls=True).over(before).alias(_CARRIED + c) for c in columns}
    carried = last.select(_GROUP, *found.values())
    carried = carried.where(reduce(or_, [F.col(_CARRIED + c).isNotNull() for c in columns]))
    so_far = W.partitionBy(_GROUP).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    within = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})
    both = within.join(carried, _GROUP, "left")
    return both.select(*[F.coalesce(c, _CARRIED + c).alias(c) if c in columns else F.col(c) for c in df.columns])
