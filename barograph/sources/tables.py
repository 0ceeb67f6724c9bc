"""Reading result tables back, from files or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.schema import HOURLY_TABLE, SOURCE_TABLE
from barograph.session import pin_utc


def jdbc_options(url: str, table: str, driver: str, user: str | None = None, password: str | None = None, **more: str) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "driver": driver}
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    return options | {k: str(v) for k, v in more.items()}


def read_jdbc(spark: SparkSession, options: dict[str, str], split_on: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A whole table; with ``split_on`` it is read in parallel by ranges of that column."""
    reader = pin_utc(spark).read.format("jdbc").options(**options)
    if split_on and bounds:
        reader = reader.options(
            partitionColumn=split_on, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)
        )
    return reader.load()


def load_hourly(spark: SparkSession, source: str | dict[str, str]) -> DataFrame:
    """The hourly table, from a folder or from JDBC options."""
    return _load(spark, source, HOURLY_TABLE)


def load_by_source(spark: SparkSession, source: str | dict[str, str]) -> DataFrame:
    return _load(spark, source, SOURCE_TABLE)


def _load(spark: SparkSession, source: str | dict[str, str], table: str) -> DataFrame:
    if isinstance(source, dict):
        return read_jdbc(spark, {**source, "dbtable": source.get("dbtable", table)})
    return pin_utc(spark).read.parquet(f"{source.rstrip('/')}/{table}")


def tables_of_schema(tables: DataFrame, schema: str) -> DataFrame:
    """Names in one schema, from a catalog listing such as ``information_schema.tables``; the filter is pushed to JDBC."""
    return tables.where(F.col("TABLE_SCHEMA") == schema).select("TABLE_NAME")


def table_exists(tables: DataFrame, schema: str, table: str) -> bool:
    """Runs a job that returns at most one row."""
    return not tables_of_schema(tables, schema).where(F.col("TABLE_NAME") == table).limit(1).isEmpty()


def stored_or_fresh(spark: SparkSession, table: str, fresh: DataFrame) -> DataFrame:
    """The stored table if the session's catalog has it, else the fresh frame."""
    return spark.table(table) if spark.catalog.tableExists(table) else fresh
