"""Who may see what, and whether hits still describe the current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOWING = ("ALLOW", "NOT_APPLICABLE")


def denied(decisions: DataFrame) -> DataFrame:
    """(player_id, container_id) pairs that some provider denies; NULL or unknown denies."""
    closed = F.col("decision").isNull() | ~F.col("decision").isin(*ALLOWING)
    return decisions.filter(closed).select("player_id", "container_id")


def allowed(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Drop hits that any provider denies; no decision at all means allowed, an unknown player or place is not."""
    known = hits.filter(F.col("player_id").isNotNull() & F.col("container_id").isNotNull())
    return known.join(denied(decisions), ["player_id", "container_id"], "left_anti")


def fresh(hits: DataFrame, current: DataFrame) -> DataFrame:
    """Keep hits whose container still exists with the same block type."""
    live = current.select("container_id", "block_type")
    return hits.join(live, ["container_id", "block_type"], "left_semi")


def refresh(hits: DataFrame, live_items: DataFrame, live_containers: DataFrame) -> DataFrame:
    """Replace amount and material of hits from current rows, keeping the score.

    A container takes part only if block type and fingerprint are unchanged and
    none of its live paths occurs twice.
    """
    path_counts = live_items.groupBy("container_id", "path").agg(
        F.count(F.lit(1)).alias("n"), F.max("amount").alias("live_amount"),
        F.max("material_key").alias("live_material"))
    twice = path_counts.filter("n > 1").select("container_id").distinct()
    usable = live_containers.select("container_id", "block_type", "fingerprint").join(
        twice, "container_id", "left_anti")
    same = hits.join(usable.withColumn("_same", F.lit(True)),
                     ["container_id", "block_type", "fingerprint"], "left")
    joined = same.join(path_counts.drop("n"), ["container_id", "path"], "left")
    use = F.col("_same").isNotNull() & F.col("live_amount").isNotNull()
    return (
        joined.withColumn("amount", F.when(use, F.col("live_amount")).otherwise(F.col("amount")))
        .withColumn("material_key", F.when(use, F.col("live_material")).otherwise(F.col("material_key")))
        .select(*hits.columns)
    )


def visible_totals(roots: DataFrame) -> DataFrame:
    """Containers and stacks per query that are left after re-validation."""
    return roots.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("visible_roots"), F.sum("total_stacks").alias("visible_stacks"))
