"""Versioned tables: each write goes to a new folder, a commit log names the current one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableStore:
    """A set of tables that change together; one writer, any number of readers.

    ``write`` puts all tables of a version into new folders and only then appends
    the version to the log, so readers see all of it or nothing, and a repeated
    write of the same version (a restarted batch) replaces itself.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self, version: int, name: str) -> str:
        return f"{self.root}/v={version:012d}/{name}"

    def current(self) -> int | None:
        try:
            log = self.spark.read.schema("version long").json(f"{self.root}/commits")
            return log.agg(F.max("version")).first()[0]
        except AnalysisException as failure:
            if failure.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def read(self, name: str, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            raise LookupError(f"no committed version in {self.root}")
        return self.spark.read.parquet(self._folder(version, name))

    def write(self, tables: dict[str, DataFrame], version: int | None = None,
              sort: dict[str, list[str]] | None = None) -> int:
        if version is None:
            version = (self.current() or 0) + 1
        for name, table in tables.items():
            keys = (sort or {}).get(name)
            if keys:
                table = table.sortWithinPartitions(*keys)
            table.write.mode("overwrite").parquet(self._folder(version, name))
        log = self.spark.range(1).select(F.lit(version).cast("long").alias("version"))
        log.write.mode("append").json(f"{self.root}/commits")
        return version
