"""Grid columns: cells, distance and the cells a query window touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_BITS = 4
# Cells of a region's side, as a power of two; saved items are partitioned by region.
REGION_BITS = 2
REGION = ["region_x", "region_z"]
EDGE = 1e-9


def cell(coordinate: Column) -> Column:
    """Cell of a block coordinate (floor division by 16, right for negatives)."""
    return F.shiftright(coordinate, CELL_BITS)


def with_region(places: DataFrame) -> DataFrame:
    """Adds the region of a cell."""
    return places.withColumns({
        "region_x": F.shiftright("cell_x", REGION_BITS), "region_z": F.shiftright("cell_z", REGION_BITS)})


def distance(dx: Column, dy: Column, dz: Column) -> Column:
    return F.hypot(F.hypot(dx.cast("double"), dy.cast("double")), dz.cast("double"))


def within(distance_column: Column, radius: Column) -> Column:
    return distance_column - radius <= EDGE


def query_cells(queries: DataFrame, radius: Column) -> DataFrame:
    """One row per query and cell of its window; at most 17 by 17 for the largest radius."""

    def span(origin: str) -> Column:
        low = F.shiftright(F.col(origin).cast("long") - radius, CELL_BITS)
        high = F.shiftright(F.col(origin).cast("long") + radius, CELL_BITS)
        return F.explode(F.sequence(low, high))

    return (
        queries.select("*", span("ox").alias("wx"))
        .select("*", span("oz").alias("wz"))
        .select(*queries.columns, F.col("wx").cast("int").alias("cell_x"), F.col("wz").cast("int").alias("cell_z"))
    )
