"""A sink for streams in update mode: every micro-batch writes the rows it changed, a reader takes the newest.

A batch that is repeated after a failure overwrites its own folder, so each change is there once. Every so many batches
what is still needed of them is folded into a base, so that a reader has a base and a bounded number of batches to read
however long the stream has run. A base and its batches stay until the next base but one is there, for readers that
began before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

#: Batches between two bases.
EVERY = 100


def _files(spark: SparkSession, path: str):
    """The folder as a Hadoop path and the file system that it is on."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, kind: str, whole: bool) -> list[int]:
    """The numbers of the folders ``kind=number``, in order; only finished ones if ``whole``."""
    root, files = _files(spark, path)
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
    success = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in found if not whole or files.exists(success(p, "_SUCCESS")))


def written_rows(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """Rows of the newest base and of the batches after it, with the ``batch`` that each is from."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    bases = [b for b in _numbers(spark, path, "base", whole=True) if upto is None or b < upto]
    base = bases[-1] if bases else -1
    tail = [b for b in _numbers(spark, path, "batch", whole=False) if b > base and (upto is None or b <= upto)]
    reader = spark.read.schema(full)
    parts = [reader.parquet(f"{path}/base={base}")] if bases else []
    if tail:
        parts.append(reader.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in tail)))
    if not parts:
        return spark.createDataFrame([], full)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def write_batch(rows: DataFrame, batch: int, path: str, needed: Callable[[DataFrame], DataFrame], every: int = EVERY) -> None:
    """Writes a batch and, when it is due, a base with what is ``needed`` of all rows so far."""
    rows.hint("rebalance").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    if (batch + 1) % every:
        return
    spark = rows.sparkSession
    older = [b for b in _numbers(spark, path, "base", whole=True) if b < batch]
    needed(written_rows(spark, path, rows.schema, batch)).write.mode("overwrite").parquet(f"{path}/base={batch}")
    if older:
        root, files = _files(spark, path)
        gone = [f"batch={b}" for b in _numbers(spark, path, "batch", whole=False) if b <= older[-1]]
        for name in gone + [f"base={b}" for b in older[:-1]]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)


def newest_rows(log: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's newest row of ``written_rows``."""
    newest = F.max_by(F.struct(*log.columns), "batch").alias("row")
    return log.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(newest).select("row.*")


def change_writer(df: DataFrame, path: str, checkpoint: str, keys: list[str], every: int = EVERY) -> DataStreamWriter:
    def write(rows: DataFrame, batch: int) -> None:
        write_batch(rows, batch, path, lambda log: newest_rows(log, keys), every)

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def current_rows(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Each key's newest row."""
    return newest_rows(written_rows(spark, path, schema), keys).select(*schema.fieldNames())


def run_available(writer: DataStreamWriter) -> None:
    """Everything that is there now, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
