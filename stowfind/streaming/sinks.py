"""Streams into versioned tables: each micro-batch becomes one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stowfind.sources.store import TableStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upsert_stream(changes: DataFrame, store: TableStore, checkpoint: str,
                  apply: Callable[[TableStore, int, DataFrame], dict[str, DataFrame]]) -> StreamingQuery:
    """Apply each micro-batch to the store's tables.

    ``apply`` gets the store, the version to start from and the batch. A batch
    that is run again after a failure starts from the same version and replaces
    what it wrote, so its effect is the same.
    """
    base = store.current() or 0

    def write(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1 + origin
        store.write(apply(store, version - 1, batch), version)

    origin = _origin(store, checkpoint, base)
    return (changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _origin(store: TableStore, checkpoint: str, base: int) -> int:
    """Version the stream began at, remembered beside its checkpoint."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    place = f"{checkpoint.rstrip('/')}-origin"
    try:
        return store.spark.read.schema("version long").json(place).agg(F.min("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        store.spark.range(1).select(F.lit(base).cast("long").alias("version")).write.json(place)
        return base


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all available input into a Parquet table and return the table."""
    spark = stream.sparkSession
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
             .option("path", path).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
