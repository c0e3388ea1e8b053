"""Ordered per-key columns that do not need a whole key in one task.

A plain window puts all rows of a key into one task. Here each key is cut into
chunks of its order (for instance days); a window runs inside a chunk, and a
summary with one row per key and chunk carries the result from chunk to chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordering(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def running_total(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                  value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per key; ``order`` must be a total order."""
    rows = df.withColumn("_chunk", chunk).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    )
    local = rows.withColumn("_local", F.sum("_value").over(inside))
    return (
        local.join(carry, [*keys, "_chunk"])
        .withColumn(out, F.col("_local") + F.col("_carry"))
        .drop("_chunk", "_value", "_local", "_carry")
    )


def running_count(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str) -> DataFrame:
    """1-based position of each row within its key."""
    return running_total(df, keys, order, chunk, F.lit(1).cast("long"), out)


def neighbour(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, out: str,
              ahead: bool) -> DataFrame:
    """Value of the next (``ahead``) or previous row of the key, NULL at the end."""
    rows = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    edges = (
        rows.groupBy(*keys, "_chunk").agg(edge(F.col(value), _ordering(order)).alias("_edge"))
        .select(*keys, "_chunk", step("_edge").over(chunks).alias("_edge"))
    )
    local = rows.withColumn("_near", step(F.struct(F.col(value).alias("v"))).over(inside))
    return (
        local.join(edges, [*keys, "_chunk"])
        .withColumn(out, F.when(F.col("_near").isNotNull(), F.col("_near.v")).otherwise(F.col("_edge")))
        .drop("_chunk", "_near", "_edge")
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``; partial maxima combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), _ordering(order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their rank; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def page(df: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """Keyset page: up to ``size`` rows past the cursor, plus one that tells of more.

    ``order`` must be a total order, as rows that tie with the cursor are not shown again.
    """
    if after is not None:
        cursor = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)])
        df = df.filter(_ordering(order) > cursor)
    return df.orderBy(*order).limit(size + 1)
