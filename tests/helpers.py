"""Small frames for tests."""

from __future__ import annotations

from stowfind.schema import CONTAINERS, ITEMS


def item(material="minecraft:stone", display=(), lore=(), enchantments=None, attributes=None, traits=(),
         metadata=None, tags=()):
    return (material, list(display), list(lore), enchantments or {}, attributes or {}, list(traits),
            metadata or {}, list(tags))


def descriptors(spark, *rows):
    from stowfind.schema import DESCRIPTOR

    return spark.createDataFrame(list(enumerate(rows)), _with_id(DESCRIPTOR))


def _with_id(kind):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("id", T.LongType()), T.StructField("d", kind)])


def items(spark, rows):
    """rows: (item_id, container_id, label, slot, amount, descriptor)"""
    return spark.createDataFrame([(i, c, [(label, slot)], n, d) for i, c, label, slot, n, d in rows], ITEMS)


def containers(spark, rows):
    """rows: (container_id, world, x, y, z)"""
    return spark.createDataFrame([(*r, "chest", "f", 1) for r in rows], CONTAINERS)
