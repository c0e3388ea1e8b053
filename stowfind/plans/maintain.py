"""Keeping the index tables current: replace, delete, skip, route, re-encode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowfind.functions.text import embedding_text
from stowfind.operators.dense import BatchEncoder
from stowfind.operators.joins import lookup_join
from stowfind.operators.ordered import latest
from stowfind.operators.quality import provider_rule, require

CELL = ["world_id", "cell_x", "cell_z"]
IDENTITY = ["container_id", "block_type", "fingerprint"]


def load_documents(items: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Items of the wanted containers."""
    return lookup_join(items, keys.select(*on).distinct(), on, "left_semi")


def document_counts(items: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Every wanted container with its number of items, 0 included."""
    wanted = keys.select(*on).distinct()
    counts = load_documents(items, wanted, on).groupBy(*on).agg(F.count(F.lit(1)).alias("n_items"))
    return wanted.join(counts, on, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def find_root(containers: DataFrame, world_id: str, x: int, y: int, z: int) -> DataFrame:
    """The container at a place; the filter reaches the Parquet scan."""
    return containers.filter(
        (F.col("world_id") == world_id) & (F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z))


def without(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Delete rows by key; used for a root and each table that depends on it."""
    return lookup_join(table, keys.select(*on).distinct(), on, "left_anti")


def replace(table: DataFrame, changed: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Drop all rows of the changed keys and add their new rows."""
    return without(table, changed, on).unionByName(rows)


def set_cells(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Last arrival per cell wins, whatever its revision says.

    ``updates`` carries ``seq``, the order of arrival.
    """
    old = cells.select(*CELL, "available", "revision", F.lit(None).cast("long").alias("seq"))
    both = old.unionByName(updates.select(*CELL, "available", "revision", "seq"))
    return latest(both.withColumn("seq", F.coalesce("seq", F.lit(-1))), CELL, ["seq"]).drop("seq")


def reset_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("available", F.lit(False))


def route(snapshots: DataFrame) -> DataFrame:
    """What to do with a snapshot of each status."""
    s = F.col("status")
    return snapshots.withColumn(
        "route", F.when(s == "COMPLETE", "replace").when(s == "UNAVAILABLE", "keep").otherwise("delete"))


def changed_snapshots(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """Snapshots that differ from the indexed container, or are forced.

    snapshots: container_id, block_type, fingerprint, forced
    """
    known = current.select(*IDENTITY).withColumn("_known", F.lit(True))
    both = snapshots.join(known, IDENTITY, "left")
    return both.filter(F.col("forced") | F.col("_known").isNull()).drop("_known")


def migrate(work: DataFrame) -> DataFrame:
    """Change rows of finished work: the canonical key is written, a different work key deleted.

    work: work_key, canonical_key
    """
    moved = F.array(
        F.struct(F.col("canonical_key").alias("key"), F.lit("replace").alias("action")),
        F.struct(F.col("work_key").alias("key"), F.lit("delete").alias("action")))
    same = F.col("work_key") == F.col("canonical_key")
    return work.select(F.inline(F.when(same, F.slice(moved, 1, 1)).otherwise(moved)))


def current_work(work: DataFrame) -> DataFrame:
    """Drop work whose revision is not the newest of its key."""
    newest = work.groupBy("key").agg(F.max("revision").alias("revision"))
    return work.join(newest, ["key", "revision"], "left_semi")


def superseded_actions(work: DataFrame) -> DataFrame:
    """Action that counts per key: that of the highest revision."""
    return work.groupBy("key").agg(F.max("revision").alias("revision"),
                                   F.max_by("action", "revision").alias("action"))


def vanished(known: DataFrame, discovered: DataFrame, on: list[str]) -> DataFrame:
    """Known keys that discovery no longer reports."""
    return known.select(*on).distinct().join(discovered.select(*on), on, "left_anti")


def reconcile(current: DataFrame, source: DataFrame) -> DataFrame:
    """Difference of the index and a full rescan: added, changed, removed or same."""
    c = current.select("container_id", F.struct("block_type", "fingerprint").alias("_c"))
    s = source.select("container_id", F.struct("block_type", "fingerprint").alias("_s"))
    return c.join(s, "container_id", "full_outer").select(
        "container_id",
        F.when(F.col("_c").isNull(), "added").when(F.col("_s").isNull(), "removed")
        .when(F.col("_c") == F.col("_s"), "same").otherwise("changed").alias("change"))


def cell_readiness(cells: DataFrame, pending: DataFrame) -> DataFrame:
    """A cell is ready when discovered, written, and none of its roots is pending.

    cells: world_id, cell_x, cell_z, discovered, written;  pending: one row per root
    """
    waiting = pending.groupBy(*CELL).agg(F.count(F.lit(1)).alias("pending"))
    both = cells.join(waiting, CELL, "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
    return both.withColumn("ready", F.col("discovered") & F.col("written") & (F.col("pending") == 0))


def cache_misses(hashes: DataFrame, cache: DataFrame, encoder: BatchEncoder) -> DataFrame:
    """Distinct descriptor hashes the encoder has not seen."""
    mine = cache.filter((F.col("provider_id") == encoder.provider_id)
                        & (F.col("provider_version") == encoder.version))
    return hashes.select("desc_id").distinct().join(mine, "desc_id", "left_anti")


def encode_missing(descriptors: DataFrame, cache: DataFrame, encoder: BatchEncoder) -> DataFrame:
    """Cache rows to add: each unseen descriptor is encoded once."""
    missing = cache_misses(descriptors, cache, encoder)
    texts = descriptors.join(missing, "desc_id", "left_semi").select(
        "desc_id", embedding_text(F.col("descriptor")).alias("text"))
    return encoder.run(texts, "desc_id").select(
        F.lit(encoder.provider_id).alias("provider_id"), F.lit(encoder.version).alias("provider_version"),
        "desc_id", "vector", "norm")


def resolve_vectors(items: DataFrame, descriptors: DataFrame, cache: DataFrame,
                    encoder: BatchEncoder) -> DataFrame:
    """Items with the vector of their descriptor, from the cache or newly encoded."""
    table = cache.unionByName(encode_missing(descriptors, cache, encoder))
    mine = require(
        table.filter(F.col("provider_id") == encoder.provider_id),
        provider_rule(encoder.provider_id, encoder.version))
    return items.join(mine, "desc_id")


def re_encode(descriptors: DataFrame, cache: DataFrame, encoder: BatchEncoder) -> DataFrame:
    """New cache for a changed encoder; rows of other encoders are dropped."""
    mine = cache.filter((F.col("provider_id") == encoder.provider_id)
                        & (F.col("provider_version") == encoder.version))
    return mine.unionByName(encode_missing(descriptors, mine, encoder))
