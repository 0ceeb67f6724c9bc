"""Keeping costly expressions from being worked out again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns per generator. A generator becomes one Java method, and one that is too long is never compiled
#: to machine code.
AT_A_TIME = 4


def computed_once(df: DataFrame, columns: dict[str, Column], at_a_time: int = AT_A_TIME) -> DataFrame:
    """``df`` with further columns, each worked out once per row.

    Catalyst pushes a filter down to the columns it is computed from, where a costly expression is then
    evaluated a second time, and merges projections above a costly column into it. It moves nothing past a
    generator, and ``inline`` over an array of one struct is a generator that keeps the rows as they are.

    Functions over arrays (``transform``, ``aggregate`` ...) have no generated code and take a whole generator
    out of it: add their columns with ``withColumn`` before, and let a generator follow.
    """
    named = [c.alias(n) for n, c in columns.items()]
    for i in range(0, len(named), at_a_time):
        df = df.select("*", F.inline(F.array(F.struct(*named[i : i + at_a_time]))))
    return df
