"""Column layouts and the bounded settings that queries and indexing take."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

PATH = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("slot", T.IntegerType()),
]))

DESCRIPTOR = T.StructType([
    T.StructField("material_key", T.StringType()),
    T.StructField("display_text", T.ArrayType(T.StringType())),
    T.StructField("lore", T.ArrayType(T.StringType())),
    T.StructField("enchantments", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("attributes", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("traits", T.ArrayType(T.StringType())),
    T.StructField("scalar_metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("custom_tags", T.ArrayType(T.StringType())),
])

ITEMS = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("container_id", T.LongType()),
    T.StructField("path", PATH),
    T.StructField("amount", T.IntegerType()),
    T.StructField("descriptor", DESCRIPTOR),
])

CONTAINERS = T.StructType([
    T.StructField("container_id", T.LongType()),
    T.StructField("world_id", T.StringType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("z", T.IntegerType()),
    T.StructField("block_type", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("revision", T.LongType()),
])

CELLS = T.StructType([
    T.StructField("world_id", T.StringType()),
    T.StructField("cell_x", T.IntegerType()),
    T.StructField("cell_z", T.IntegerType()),
    T.StructField("available", T.BooleanType()),
    T.StructField("revision", T.LongType()),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("player_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("world_id", T.StringType()),
    T.StructField("ox", T.IntegerType()),
    T.StructField("oy", T.IntegerType()),
    T.StructField("oz", T.IntegerType()),
])

HISTORY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("player_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("result_count", T.IntegerType()),
])


def _within(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}, got {value}")


@dataclass(frozen=True)
class Policy:
    """Search limits; the defaults are the documented ones."""

    radius: int = 32
    min_score: float = 0.30
    max_results: int = 32
    max_paths_per_root: int = 16
    rrf_k: int = 60
    full_text_limit: int = 64
    semantic_limit: int = 64

    def __post_init__(self) -> None:
        _within("radius", self.radius, 1, 128)
        if not (math.isfinite(self.min_score) and 0.0 <= self.min_score <= 1.0):
            raise ValueError("min_score must lie in 0..1")
        _within("max_results", self.max_results, 1, 256)
        _within("max_paths_per_root", self.max_paths_per_root, 1, 128)
        _within("rrf_k", self.rrf_k, 1, 1000)
        _within("full_text_limit", self.full_text_limit, 1, 256)
        _within("semantic_limit", self.semantic_limit, 1, 256)


@dataclass(frozen=True)
class Settings:
    """Engine-wide settings around a policy."""

    policy: Policy = Policy()
    max_radius: int = 128
    warmup_timeout_seconds: int = 3
    marker_seconds: int = 20
    cells_per_tick: int = 2
    roots_per_tick: int = 8
    reconciliation_period_ticks: int = 200
    max_depth: int = 4
    max_stacks_per_root: int = 4096
    encoder: str = "sparse-tags"

    def __post_init__(self) -> None:
        _within("max_radius", self.max_radius, 1, 128)
        _within("radius", self.policy.radius, 1, self.max_radius)
        _within("warmup_timeout_seconds", self.warmup_timeout_seconds, 1, 30)
        _within("marker_seconds", self.marker_seconds, 1, 300)
        _within("cells_per_tick", self.cells_per_tick, 1, 16)
        _within("roots_per_tick", self.roots_per_tick, 1, 128)
        _within("reconciliation_period_ticks", self.reconciliation_period_ticks, 20, 72_000)
        _within("max_depth", self.max_depth, 1, 8)
        _within("max_stacks_per_root", self.max_stacks_per_root, 1, 16_384)
        if not self.encoder.strip():
            raise ValueError("encoder must name a provider")
