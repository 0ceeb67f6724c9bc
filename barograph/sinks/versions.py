"""Tables in folders that a manifest names: a run shows all that it wrote at once, or nothing of it.

A run writes folders of its own, ``table/run=.../part=...``, and then one manifest file with a row for every folder that
counts from now on. Readers take the newest manifest. A run that dies before its manifest leaves folders that nobody
reads; a reader that began before the switch goes on with the folders of its version, which stay. The manifest has a row
for each part (a day) and folder of it; the last ``KEPT`` manifests are kept. One run at a time may write.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, table string, part string, folder string"
KEPT = 16


@dataclass(frozen=True)
class Folder:
    table: str
    part: str
    folder: str


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: tuple[Folder, ...] = ()

    def of(self, table: str, parts: Iterable[str] | None = None) -> list[str]:
        wanted = None if parts is None else set(parts)
        return [f.folder for f in self.folders if f.table == table and (wanted is None or f.part in wanted)]

    def parts(self, table: str) -> set[str]:
        return {f.part for f in self.folders if f.table == table}

    def with_folders(self, added: Iterable[Folder], replaced: Iterable[str] = ()) -> Version:
        """The version after this one. Of the tables ``replaced``, the parts that are added lose their old folders."""
        added, replaced = list(added), set(replaced)
        gone = {(f.table, f.part) for f in added if f.table in replaced}
        return Version(self.number + 1, (*(f for f in self.folders if (f.table, f.part) not in gone), *added))


def current(spark: SparkSession, path: str) -> Version:
    """The newest version, or an empty one where nothing has been written yet."""
    try:
        rows = spark.read.schema(MANIFEST).option("ignoreMissingFiles", True).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Version()
    newest = rows.agg(F.max("version")).first()[0]
    if newest is None:
        return Version()
    found = rows.where((F.col("version") == newest) & F.col("table").isNotNull()).collect()
    return Version(newest, tuple(sorted((Folder(r["table"], r["part"], r["folder"]) for r in found), key=lambda f: (f.table, f.folder))))


def stage(df: DataFrame, path: str, table: str, part: str, run: str) -> list[Folder]:
    """Writes ``df`` by its column ``part`` to folders of this run, which count once they are in a manifest."""
    folder = f"{table}/run={run}"
    df.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(f"{path}/{folder}")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{folder}")
    parts = sorted(r[0] for r in written.select(F.col(part).cast("string")).distinct().collect())
    return [Folder(table, p, f"{folder}/{part}={p}") for p in parts]


def switch(spark: SparkSession, path: str, version: Version) -> None:
    """Makes ``version`` the newest one. The manifest is one file, so it is there as a whole or not at all."""
    rows = [(version.number, f.table, f.part, f.folder) for f in version.folders] or [(version.number, None, None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/slot={version.number % KEPT}")


def read(spark: SparkSession, path: str, version: Version, table: str, schema: T.StructType, parts: Iterable[str] | None = None) -> DataFrame:
    """A table (or some parts of it) as it is in a version."""
    folders = version.of(table, parts)
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{path}/{table}")
    return reader.parquet(*(f"{path}/{f}" for f in folders)).select(*schema.fieldNames())
