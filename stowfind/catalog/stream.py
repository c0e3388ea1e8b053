"""Registered queries for change feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stowfind.catalog.base import EPOCH_MS, query, sql
from stowfind.catalog.index import cell_updates
from stowfind.operators.ordered import running_count
from stowfind.plans.maintain import set_cells
from stowfind.session import shared_folder
from stowfind.sources.store import TableStore
from stowfind.sources.tables import Tables, epoch_ms
from stowfind.streaming import feed
from stowfind.streaming.debounce import close_feed, closing, coalesce, coalesce_stream
from stowfind.streaming.sinks import ROCKSDB, run_to_table, upsert_stream

CHUNK = 96

# Work items by stepping through each key's changes one by one.
_BURSTS = {
    "numbered": ("changes", """
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY tick, seq) AS n,
               lead(tick) OVER (PARTITION BY key ORDER BY tick, seq) AS next_tick FROM changes"""),
    "steps": ("numbered", """
        SELECT * FROM (
            WITH RECURSIVE r AS (
                SELECT key, n, tick, next_tick, kind, tick AS start,
                       CASE WHEN kind = 'transfer' THEN tick + 5 ELSE tick + 1 END AS claim, 1 AS events
                FROM numbered WHERE n = 1
                UNION ALL
                SELECT key, n, tick, next_tick, kind, start,
                       greatest(tick, CASE WHEN kind = 'transfer' THEN least(tick + 5, start + 20) ELSE tick + 1 END),
                       events
                FROM (SELECT c.key, c.n, c.tick, c.next_tick, c.kind,
                             CASE WHEN c.tick <= r.claim THEN r.start ELSE c.tick END AS start,
                             CASE WHEN c.tick <= r.claim THEN r.events + 1 ELSE 1 END AS events
                      FROM r JOIN numbered c ON c.key = r.key AND c.n = r.n + 1))
            SELECT * FROM r)"""),
    "bursts": ("steps", """
        SELECT key, start AS start_tick, claim AS claim_tick, n AS revision,
               CASE WHEN kind = 'delete' THEN 'DELETE' ELSE 'SNAPSHOT' END AS action, CAST(events AS BIGINT) AS events
        FROM steps WHERE next_tick IS NULL OR next_tick > claim"""),
}


@query("t02_debounce", sql("bursts", "SELECT * FROM bursts", _BURSTS))
def t02(t):
    return coalesce(t.changes(), CHUNK)


_DIRTY = dict(_BURSTS, changes=("", """
    SELECT user_id AS key, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) // 14400000 AS tick, event_id AS seq,
           CASE WHEN event_type = 'error' THEN 'delete' ELSE 'dirty' END AS kind FROM events"""))


@query("t01_coalesce", sql("bursts", "SELECT * FROM bursts", _DIRTY))
def t01(t):
    plain = t.changes(14_400_000).withColumn("kind", F.when(F.col("kind") == "delete", "delete").otherwise("dirty"))
    return coalesce(plain, CHUNK)


@query("w07_revisions", sql("changes", """
    SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY tick, seq) AS revision FROM changes"""))
def w07(t):
    chunk = F.floor(F.col("tick") / CHUNK)
    return running_count(t.changes(), ["key"], ["tick", "seq"], chunk, "revision").select("seq", "key", "revision")


def world_events(t: Tables):
    kinds = ["place", "break", "explode", "click", "drag", "move", "pickup", "smelt", "burn", "cook", "brew", "look"]
    k = F.col("event_id")
    return t.read("events").select(
        F.element_at(F.array(*[F.lit(v) for v in kinds]), (k % len(kinds) + 1).cast("int")).alias("event"),
        F.col("user_id").alias("source_id"), F.when(k % 4 != 1, F.col("user_id") + 1000).alias("target_id"),
        (F.floor("value") % 40).cast("int").alias("raw_slot"), F.lit(27).alias("top_size"),
        F.when(F.col("event_type") == "view", "NOTHING").otherwise("PICKUP_ALL").alias("action"),
        F.array((k % 30).cast("int")).alias("raw_slots"), k.alias("seq"), k.alias("tick"))


@query("t11_event_mapping", """
    SELECT key, kind, seq FROM (
        SELECT user_id AS key, event_id AS seq, CASE
            WHEN event_id % 12 IN (0, 3, 4, 7, 8, 9, 10) THEN 'dirty' WHEN event_id % 12 IN (5, 6) THEN 'transfer'
            WHEN event_id % 12 IN (1, 2) THEN 'delete' END AS kind
        FROM events WHERE CASE event_id % 12 WHEN 3 THEN CAST(floor(value) AS INT) % 40 < 27 AND event_type <> 'view'
                                            WHEN 4 THEN event_id % 30 < 27 ELSE true END
        UNION ALL SELECT user_id + 1000, event_id, 'transfer' FROM events WHERE event_id % 12 = 5 AND event_id % 4 <> 1)
    WHERE kind IS NOT NULL""")
def t11(t):
    return feed.changes(world_events(t)).select("key", "kind", "seq")


STREAM_TICK, STREAM_LATE = 1_800_000, 3_600_000


def event_stream(t: Tables):
    """The events table as a stream of changes."""
    batch = t.read("events")
    rows = t.spark.readStream.schema(batch.schema).parquet(f"{t.folder}/events*.parquet")
    kind = F.when(F.col("event_type").isin("click", "view"), "transfer") \
        .when(F.col("event_type") == "error", "delete").otherwise("dirty")
    return rows.select(F.col("user_id").alias("key"), F.timestamp_millis(epoch_ms(F.col("ts"))).alias("ts"),
                       F.col("event_id").alias("seq"), kind.alias("kind"))


@query("t02_debounce_stream", sql("bursts", "SELECT * FROM bursts", _BURSTS))
def t02_stream(t):
    """The whole feed, then rows that close it; both runs share one checkpoint, as a restarted stream does."""
    # A session of its own, as the state store is a setting.
    own = t.spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Each task of each micro-batch starts a Python process of its own, so one per core.
    own.conf.set("spark.sql.shuffle.partitions", str(own.sparkContext.defaultParallelism))
    t = Tables(own, t.folder)
    place = f"{shared_folder(t.spark)}/stowfind-stream-{uuid.uuid4().hex}"
    last = t.read("events").agg(F.max(epoch_ms(F.col("ts")))).first()[0] or 0
    # The first row comes with the feed and changes nothing, so that the folder is there.
    close_feed(t.spark, f"{place}/closing", [0])
    feed_end = last + STREAM_LATE + 100 * STREAM_TICK
    for more in ([], [feed_end], [feed_end + STREAM_TICK], [feed_end + 2 * STREAM_TICK]):
        close_feed(t.spark, f"{place}/closing", more)
        whole = event_stream(t).unionByName(closing(t.spark, f"{place}/closing"))
        bursts = coalesce_stream(whole, STREAM_TICK, f"{STREAM_LATE} milliseconds")
        found = run_to_table(bursts, f"{place}/out", f"{place}/checkpoint")
    return found


@query("s06_cell_upsert_stream", sql("cells", """
    SELECT world_id, cell_x, cell_z, max_by(available, seq) AS available, max_by(revision, seq) AS revision FROM (
        SELECT world_id, cell_x, cell_z, available, 0 AS revision, -1 AS seq FROM cells
        UNION ALL SELECT CASE WHEN user_id % 2 = 0 THEN 'O' ELSE 'F' END, user_id % 16 - 8, event_id % 16 - 8,
                         event_type <> 'error', CAST(floor(value) AS BIGINT), event_id FROM events)
    GROUP BY world_id, cell_x, cell_z"""))
def s06_stream(t):
    place = f"{shared_folder(t.spark)}/stowfind-stream-{uuid.uuid4().hex}"
    store = TableStore(t.spark, f"{place}/store")
    store.write({"cells": t.cells().withColumn("revision", F.lit(0).cast("long"))})
    events = t.spark.readStream.schema(t.read("events").schema).parquet(f"{t.folder}/events*.parquet")
    updates = cell_updates(events)

    def apply(tables, version, batch):
        return {"cells": set_cells(tables.read("cells", version), batch)}

    upsert_stream(updates, store, f"{place}/checkpoint", apply).awaitTermination()
    return store.read("cells")
