"""Writing result tables: Parquet, CSV and JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter

JDBC_BATCH = 10_000


def jdbc_writer(df: DataFrame, options: dict[str, str], connections: int = 8, keep_definition: bool = True) -> DataFrameWriter:
    """Overwrite a table over JDBC in batches; at most ``connections`` tasks write at a time.

    ``keep_definition`` empties the table instead of dropping and creating it, so its keys and grants stay.
    """
    return (
        df.write.format("jdbc")
        .mode("overwrite")
        .options(**options)
        .option("batchsize", str(JDBC_BATCH))
        .option("numPartitions", str(connections))
        .option("truncate", str(keep_definition).lower())
    )


def overwrite_jdbc(df: DataFrame, options: dict[str, str], connections: int = 8) -> None:
    jdbc_writer(df, options, connections).save()


def overwrite_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def overwrite_days(df: DataFrame, path: str, day: str = "date") -> None:
    """Replace only the days that ``df`` holds; other days of the table stay."""
    df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header. Meant for the small result tables: a single task writes it."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
