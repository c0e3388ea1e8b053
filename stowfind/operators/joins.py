"""Joins against a side that is usually small, with a way out when it is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 2_000_000
MAX_BYTES = 64 * 1024 * 1024


def _width(field: T.StructField) -> Column:
    """Bytes of a value: its length for text, all of it as JSON for nested types."""
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return F.lit(8)


def fits_broadcast(small: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Measure a side in one job; rows and bytes add up in the tasks that read it."""
    width = sum((_width(f) for f in small.schema.fields), F.lit(0))
    size = small.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return size["n"] <= (MAX_ROWS if max_rows is None else max_rows) and (size["b"] or 0) <= (
        MAX_BYTES if max_bytes is None else max_bytes)


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                fits: bool | None = None) -> DataFrame:
    """Join a big side with a lookup side: broadcast if it is known or measured small, else by shuffle.

    ``how`` must keep or test left rows only (inner, left, left_semi, left_anti); Spark splits the left side's hot
    keys at run time for these. Without ``fits`` the lookup side is measured when this is called. A side that does not
    fit is merged: Spark's own estimate is that of its compressed files, which may be far below its rows in memory.
    """
    if fits is None:
        fits = fits_broadcast(small)
    return big.join(F.broadcast(small) if fits else small.hint("merge"), on, how)
