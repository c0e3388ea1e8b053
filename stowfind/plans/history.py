"""Search history, per-player limits and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.operators.ordered import latest, neighbour, top_n

DAY_MS = 86_400_000
MIN_RADIUS, MAX_RADIUS = 1, 128


def append(history: DataFrame, path: str) -> None:
    """Append searches, giving rows without id a random one."""
    ids = F.coalesce("id", F.uuid())
    history.withColumn("id", ids).write.mode("append").parquet(path)


def latest_per_player(history: DataFrame, n: int) -> DataFrame:
    return top_n(history, ["player_id"], [F.desc("ts_ms"), F.asc("id")], n)


def latest_overall(history: DataFrame, n: int) -> DataFrame:
    return history.orderBy(F.desc("ts_ms"), F.asc("id")).limit(n)


def prune(history: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Keep searches that are not older than ``days`` days."""
    if days < 1:
        raise ValueError("days must be positive")
    return history.filter(F.col("ts_ms") >= now_ms - days * DAY_MS)


def clear_player(history: DataFrame, player_id: int) -> DataFrame:
    return history.filter(F.col("player_id") != player_id)


def set_radius(radii: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert (player_id, radius, updated_at); a radius outside 1..128 fails the job."""
    inside = F.col("radius").between(MIN_RADIUS, MAX_RADIUS)
    checked = updates.withColumn("radius", F.when(inside, F.col("radius")).otherwise(
        F.raise_error(F.lit("radius must lie in 1..128")).cast("int")))
    return latest(radii.unionByName(checked.select(*radii.columns)), ["player_id"], ["updated_at"])


def effective_radius(players: DataFrame, radii: DataFrame, default: int) -> DataFrame:
    return players.join(radii.select("player_id", "radius"), "player_id", "left").withColumn(
        "radius", F.coalesce("radius", F.lit(default)))


def sessions(requests: DataFrame, lifetime_ms: int, chunk: Column) -> DataFrame:
    """Each request with the end of its session: the player's next request or expiry.

    requests: player_id, ts_ms, request_id
    """
    following = neighbour(requests, ["player_id"], ["ts_ms", "request_id"], chunk, "ts_ms", "next_ms", ahead=True)
    expiry = F.col("ts_ms") + lifetime_ms
    beaten = F.col("next_ms").isNotNull() & (F.col("next_ms") < expiry)
    return following.select(
        "request_id", "player_id", "ts_ms",
        F.when(beaten, "superseded").otherwise("expired").alias("outcome"),
        F.when(beaten, F.col("next_ms")).otherwise(expiry).alias("end_ms"))
