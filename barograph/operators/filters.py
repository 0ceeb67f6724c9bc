"""Filters a viewer puts together column by column.

``apply_filters`` takes predicates whose kind is stated. ``filter_by_choice`` decides the kind from the
data, as the dashboard did: on the rows that the filters before it left, a column with fewer than ten
values is a category, else a number, a date or a text by its type.

All kinds are decided in one pass. Which rows reach a filter depends on the kinds of those before it, so each
task follows both kinds of every filter at once: the ways through them are numbered as nodes of a binary tree
(root 1; below node p, 2p if p's filter is a category, else 2p + 1), and a node holds at most ten values. A node
that has met ten is no category, and nothing below 2p is followed any longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from itertools import islice
from operator import and_
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORY_LIMIT = 10
#: Filters whose kinds are decided in one pass; it follows at most 2 ** BLOCK - 1 nodes. More filters take a pass per block.
BLOCK = 8


@dataclass(frozen=True)
class OneOf:
    """Value in the chosen set; NULL is a value like any other."""

    column: str
    values: list[Any]

    def predicate(self) -> Column:
        c = F.col(self.column)
        some = [v for v in self.values if v is not None]
        hit = F.coalesce(c.isin(some), F.lit(False)) if some else F.lit(False)
        return hit | c.isNull() if None in self.values else hit


@dataclass(frozen=True)
class Between:
    """Both ends included; NULL is outside."""

    column: str
    low: float
    high: float

    def predicate(self) -> Column:
        return F.col(self.column).between(self.low, self.high)


@dataclass(frozen=True)
class DateBetween:
    """From midnight of ``start`` to midnight of ``end``: later rows of the end day are outside.

    ``end_of_day=True`` takes in the whole end day.
    """

    column: str
    start: date | str
    end: date | str
    end_of_day: bool = False

    def predicate(self) -> Column:
        c = F.col(self.column)
        start, end = (F.lit(str(d)).cast("date").cast("timestamp_ntz") for d in (self.start, self.end))
        at = c.cast("timestamp_ntz")
        if self.end_of_day:
            return (at >= start) & (at < end + F.expr("INTERVAL 1 DAY"))
        return at.between(start, end)


@dataclass(frozen=True)
class Matches:
    """A regular expression (Java's) found anywhere in the value's text; a NULL has the text ``null_text``."""

    column: str
    pattern: str
    null_text: str = "None"

    def predicate(self) -> Column:
        if not self.pattern:
            return F.lit(True)
        return F.coalesce(F.col(self.column).cast("string"), F.lit(self.null_text)).rlike(self.pattern)


Filter = OneOf | Between | DateBetween | Matches


def apply_filters(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """All filters at once; without any, the frame as it is."""
    return df.where(reduce(and_, [f.predicate() for f in filters])) if filters else df


@dataclass(frozen=True)
class Choice:
    """What a viewer entered for one column. Parts left out mean the widget's own default."""

    column: str
    values: list[Any] | None = None
    low: float | None = None
    high: float | None = None
    dates: tuple[date | str, ...] | None = None
    pattern: str = ""
    end_of_day: bool = field(default=False)


def _kind_of_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "number"
    return "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def column_kind(df: DataFrame, column: str, limit: int = CATEGORY_LIMIT) -> str:
    """``category``, ``number``, ``date`` or ``text``. Runs a job that returns a single number."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit).count()
    return "category" if values < limit else _kind_of_type(df.schema[column].dataType)


def _as_category(choice: Choice) -> Column:
    return F.lit(True) if choice.values is None else OneOf(choice.column, choice.values).predicate()


def _untouched_dates(df: DataFrame, choice: Choice) -> bool:
    """Whether the filter, if it is one of dates, depends on the first and the last day of the rows that reach it."""
    return choice.dates is None and _kind_of_type(df.schema[choice.column].dataType) == "date"


def _as_typed(df: DataFrame, choice: Choice, ends: tuple[date, date] | None = None) -> Column:
    c, kind = F.col(choice.column), _kind_of_type(df.schema[choice.column].dataType)
    if kind == "number":
        low = c if choice.low is None else F.lit(choice.low)
        high = c if choice.high is None else F.lit(choice.high)
        return c.between(low, high)
    if kind == "date":
        if choice.dates is None:
            # the widget starts at the first and the last day in the data, each taken at midnight
            return DateBetween(choice.column, *ends).predicate() if ends else F.lit(True)
        if len(choice.dates) != 2:
            return F.lit(True)
        return DateBetween(choice.column, *choice.dates, end_of_day=choice.end_of_day).predicate()
    return Matches(choice.column, choice.pattern).predicate()


def _value_text(df: DataFrame, column: str) -> Column:
    """A text that is the same for equal values and differs for others."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    # adding zero makes the two zeros one
    return (c + F.lit(0.0) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else c).cast("string")


def _values_met(n: int, limit: int, days: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each node at most ``limit`` of the values that a task met there, and the first and the last day if they are asked for."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}
        ends: dict[int, tuple[date, date]] = {}
        for batch in batches:
            reached = {1: np.ones(batch.num_rows, bool)}
            for i in range(n):
                category, typed = (batch.column(f"{k}{i}").to_numpy(zero_copy_only=False) for k in ("category", "typed"))
                below: dict[int, np.ndarray] = {}
                for node, rows in reached.items():
                    if not rows.any():
                        continue
                    found = seen.setdefault(node, set())
                    if len(found) < limit:
                        new = pc.unique(batch.column(f"value{i}").filter(pa.array(rows)).drop_null()).to_pylist()
                        found.update(islice((v for v in new if v not in found), limit - len(found)))
                    if days and i == n - 1:
                        both = pc.min_max(batch.column("day").filter(pa.array(rows))).as_py()
                        if both["min"] is not None:
                            old = ends.get(node, (both["min"], both["max"]))
                            ends[node] = min(old[0], both["min"]), max(old[1], both["max"])
                    if len(found) < limit:
                        below[2 * node] = rows & category
                    below[2 * node + 1] = rows & typed
                reached = below
        rows = [(node, v, None, None) for node, found in seen.items() for v in found] + [(node, None, *e) for node, e in ends.items()]
        if rows:
            types = {"node": pa.int32(), "value": pa.string(), "first": pa.date32(), "last": pa.date32()}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))

    return met


def _decided(df: DataFrame, choices: list[Choice], limit: int) -> list[Column]:
    """The predicates of these filters. One pass, from which at most ``limit`` values of a node leave a task and a row
    of each node comes to the driver. Only the last filter may depend on the days of its rows."""
    last, days = choices[-1].column, _untouched_dates(df, choices[-1])
    columns = [F.to_date(F.col(last)).alias("day")] if days else []
    for i, choice in enumerate(choices):
        columns.append(_value_text(df, choice.column).alias(f"value{i}"))
        for name, predicate in (("category", _as_category(choice)), ("typed", _as_typed(df, choice))):
            columns.append(F.coalesce(predicate, F.lit(False)).alias(f"{name}{i}"))
    met = df.select(*columns).mapInArrow(_values_met(len(choices), limit, days), "node int, value string, first date, last date")
    counted = met.groupBy("node").agg(F.count_distinct("value").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    nodes, node, out = {r["node"]: r for r in counted.collect()}, 1, []
    for choice in choices:
        row = nodes.get(node)
        if row is None or row["n"] < limit:
            out.append(_as_category(choice))
            node = 2 * node
        else:
            out.append(_as_typed(df, choice, (row["first"], row["last"])))
            node = 2 * node + 1
    return out


def filter_by_choice(df: DataFrame, choices: list[Choice], limit: int = CATEGORY_LIMIT, block: int = BLOCK) -> DataFrame:
    """The rows that all filters leave, each of the kind that the rows before it make it.

    The kinds take one pass over the chosen columns; one more after every ``block`` filters, and after a filter of
    dates that was left untouched, as what follows depends on the days found. An empty frame makes all filters categories.
    """
    while choices:
        cut = next((i + 1 for i, c in enumerate(choices[:block]) if _untouched_dates(df, c)), block)
        df = reduce(DataFrame.where, _decided(df, choices[:cut], limit), df)
        choices = choices[cut:]
    return df


def coerce_datetimes(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Text columns in which every value reads as a time become times, and times lose their zone.

    Runs one job over the text columns; it returns a single row.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]

    def parsed(name: str) -> Column:
        tries = [F.try_to_timestamp(F.col(name))] + [F.try_to_timestamp(F.col(name), F.lit(f)) for f in formats or []]
        return F.coalesce(*tries)

    adopted: set[str] = set()
    if texts:
        checks = [F.count_if(F.col(n).isNotNull() & parsed(n).isNull()).alias(f"bad_{i}") for i, n in enumerate(texts)]
        seen = [F.count(n).alias(f"seen_{i}") for i, n in enumerate(texts)]
        row = df.agg(*checks, *seen).first()
        adopted = {n for i, n in enumerate(texts) if row[f"bad_{i}"] == 0 and row[f"seen_{i}"] > 0}

    def column(f: T.StructField) -> Column:
        if f.name in adopted:
            return parsed(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.col(f.name).cast("timestamp_ntz").alias(f.name)
        return F.col(f.name)

    return df.select(*[column(f) for f in df.schema])
