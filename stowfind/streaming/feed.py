"""World events to index changes; works on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Click actions that leave the upper inventory as it is.
IDLE_CLICKS = ("NOTHING", "CLONE_STACK", "DROP_ALL_CURSOR", "DROP_ONE_CURSOR")
# Click actions below that still change the upper inventory.
REACHING_CLICKS = ("MOVE_TO_OTHER_INVENTORY", "COLLECT_TO_CURSOR")
# What an event kind means for the container.
DIRTY_EVENTS = ("place", "smelt", "burn", "cook", "brew", "click", "drag")
TRANSFER_EVENTS = ("move", "pickup")
DELETE_EVENTS = ("break", "explode")


def click_changes_top(raw_slot: Column, top_size: Column, action: Column) -> Column:
    upper = (raw_slot >= 0) & (raw_slot < top_size)
    return F.when(upper, ~action.isin(*IDLE_CLICKS)).otherwise(action.isin(*REACHING_CLICKS))


def drag_changes_top(raw_slots: Column, top_size: Column) -> Column:
    return F.coalesce(F.exists(raw_slots, lambda s: (s >= 0) & (s < top_size)), F.lit(False))


def relevant(events: DataFrame) -> DataFrame:
    """Drop clicks and drags that do not touch the upper inventory."""
    kind = F.col("event")
    keep = (
        F.when(kind == "click", click_changes_top(F.col("raw_slot"), F.col("top_size"), F.col("action")))
        .when(kind == "drag", drag_changes_top(F.col("raw_slots"), F.col("top_size")))
        .otherwise(True))
    return events.filter(keep)


def changes(events: DataFrame) -> DataFrame:
    """(key, kind, seq, tick) rows of relevant events.

    A move touches its source and its target; unknown kinds change nothing.
    """
    kind = F.col("event")
    action = F.when(kind.isin(*DIRTY_EVENTS), "dirty").when(kind.isin(*TRANSFER_EVENTS), "transfer") \
        .when(kind.isin(*DELETE_EVENTS), "delete")
    keys = F.when(kind == "move", F.array("source_id", "target_id")).otherwise(F.array("source_id"))
    return (
        relevant(events).withColumn("kind", action).filter("kind is not null")
        .select(F.explode(keys).alias("key"), "kind", "seq", "tick").filter("key is not null"))
