"""Registered queries for index maintenance and batch encoding."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from stowfind.catalog.base import query, sql
from stowfind.functions.text import embedding_text
from stowfind.operators.dense import BatchEncoder
from stowfind.plans import maintain as M
from stowfind.plans.index import distinct_descriptors
from stowfind.session import shared_folder
from stowfind.sources.store import TableStore
from stowfind.sources.tables import Tables, saved_index

LETTERS = "aeinort"


def letter_counts(texts: list[str]) -> np.ndarray:
    """A small encoder for tests: text length and counts of some letters."""
    return np.array([[len(t), *(t.count(c) for c in LETTERS)] for t in texts], dtype="float64")


ENCODER = BatchEncoder("letters", 1, letter_counts, 1 + len(LETTERS), max_inputs=64)

_TEXT = """'material: ' || material || chr(10) || 'display: ' || p_name || chr(10)
    || CASE WHEN has_lore THEN 'lore: made of ' || p_brand || chr(10) ELSE '' END
    || CASE WHEN has_ench THEN 'enchantment: mending' || chr(10) ELSE '' END
    || 'attribute: weight=' || p_size || '.0' || chr(10) || 'trait: ' || p_type || chr(10)
    || 'metadata: size=' || p_size || chr(10) || 'tag: ' || p_brand || chr(10)"""
_COUNTS = ", ".join(f"CAST(len(text) - len(replace(text, '{c}', '')) AS DOUBLE)" for c in LETTERS)
_VECTORS = {"encoded": ("descs", f"""
    SELECT d, v, round(sqrt(list_sum(list_transform(v, lambda e: e * e))), 6) AS norm, array_to_string(v, ' ') AS shown
    FROM (SELECT d, [CAST(len(text) AS DOUBLE), {_COUNTS}] AS v FROM (SELECT d, {_TEXT} AS text FROM descs))""")}


def shown(vector: str = "vector"):
    return F.array_join(F.transform(vector, lambda v: v.cast("double").cast("string")), " ")


def spare_changes(t: Tables):
    """Every 17th container changes: its first two slots stay, with one more each."""
    changed = t.containers().filter("container_id % 17 = 0").select("container_id")
    rows = saved_index(t).items.select("item_id", "container_id", "amount", F.col("path")[0]["slot"].alias("slot"))
    new = rows.filter("container_id % 17 = 0 and slot <= 2").withColumn("amount", F.col("amount") + 1)
    return rows, changed, new


@query("s04_replace_roots", sql("items", """
    SELECT item_id, container_id, slot, amount + CASE WHEN container_id % 17 = 0 THEN 1 ELSE 0 END AS amount
    FROM items WHERE container_id % 17 <> 0 OR slot <= 2"""))
def s04(t):
    rows, changed, new = spare_changes(t)
    store = TableStore(t.spark, f"{shared_folder(t.spark)}/stowfind-store-{uuid.uuid4().hex}")
    store.write({"items": rows})
    store.write({"items": M.replace(store.read("items"), changed, new, ["container_id"])})
    return store.read("items").select("item_id", "container_id", "slot", "amount")


@query("s05_delete_roots", sql("items containers post descs", """
    SELECT 'containers' AS name, count(*) AS n FROM containers WHERE container_id % 13 <> 0
    UNION ALL SELECT 'items', count(*) FROM items WHERE container_id % 13 <> 0
    UNION ALL SELECT 'postings', count(*) FROM items JOIN post USING (d) WHERE container_id % 13 <> 0"""))
def s05(t):
    index = saved_index(t)
    dead = t.containers().filter("container_id % 13 = 0").select("container_id")
    containers = M.without(t.containers(), dead, ["container_id"])
    items = M.without(index.items, dead, ["container_id"])
    left = items.groupBy("desc_id").agg(F.count(F.lit(1)).alias("left"))
    postings = index.postings.join(left, "desc_id")
    parts = [
        containers.select(F.lit("containers").alias("name"), F.lit(1).cast("long").alias("one")),
        items.select(F.lit("items").alias("name"), F.lit(1).cast("long").alias("one")),
        postings.select(F.lit("postings").alias("name"), F.col("left").alias("one")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").agg(F.sum("one").alias("n"))


def cell_updates(events):
    return events.select(
        F.when(F.col("user_id") % 2 == 0, "O").otherwise("F").alias("world_id"),
        (F.col("user_id") % 16 - 8).cast("int").alias("cell_x"), (F.col("event_id") % 16 - 8).cast("int").alias("cell_z"),
        (F.col("event_type") != "error").alias("available"), F.floor("value").alias("revision"),
        F.col("event_id").alias("seq"))


@query("s06_cell_upsert", sql("cells", """
    SELECT world_id, cell_x, cell_z, max_by(available, seq) AS available, max_by(revision, seq) AS revision FROM (
        SELECT world_id, cell_x, cell_z, available, 0 AS revision, -1 AS seq FROM cells
        UNION ALL SELECT CASE WHEN user_id % 2 = 0 THEN 'O' ELSE 'F' END, user_id % 16 - 8, event_id % 16 - 8,
                         event_type <> 'error', CAST(floor(value) AS BIGINT), event_id FROM events)
    GROUP BY world_id, cell_x, cell_z"""))
def s06(t):
    cells = t.cells().withColumn("revision", F.lit(0).cast("long"))
    return M.set_cells(cells, cell_updates(t.read("events")))


@query("s07_reset_cells", sql("cells", "SELECT world_id, cell_x, cell_z, false AS available FROM cells"))
def s07(t):
    return M.reset_cells(t.cells())


@query("g07_embed_once", sql("items", """
    SELECT min(item_id) AS first_item, count(*) AS copies FROM items GROUP BY d"""))
def g07(t):
    first = saved_index(t).items.groupBy("desc_id").agg(F.min("item_id").alias("first_item"))
    both = first.join(saved_index(t).descriptors.select("desc_id", "copies"), "desc_id")
    return both.select("first_item", "copies")


@query("v09_batch_encode", sql("encoded descs", """
    SELECT material AS material_key, copies, norm, shown AS vector FROM encoded JOIN descs USING (d)""", _VECTORS))
def v09(t):
    descriptors = saved_index(t).descriptors
    texts = descriptors.select("desc_id", embedding_text(F.col("descriptor")).alias("text"))
    vectors = ENCODER.run(texts, "desc_id")
    return vectors.join(descriptors, "desc_id").select(
        F.col("descriptor.material_key").alias("material_key"), "copies", F.round("norm", 6).alias("norm"),
        shown().alias("vector"))


def old_cache(t: Tables):
    """A third of the descriptors already cached, some by another encoder."""
    third = saved_index(t).descriptors.filter(F.col("descriptor.scalar_metadata")["size"].cast("int") % 3 == 0)
    texts = third.select("desc_id", embedding_text(F.col("descriptor")).alias("text"))
    mine = ENCODER.run(texts, "desc_id").select(
        F.lit(ENCODER.provider_id).alias("provider_id"), F.lit(ENCODER.version).alias("provider_version"),
        "desc_id", "vector", "norm")
    return mine.unionByName(mine.withColumn("provider_id", F.lit("retired")))


@query("j05_cache_lookup", sql("encoded items", """
    SELECT item_id, norm, shown AS vector FROM items JOIN encoded USING (d)""", _VECTORS))
def j05(t):
    index = saved_index(t)
    slim = index.items.select("item_id", "desc_id")
    found = M.resolve_vectors(slim, index.descriptors, old_cache(t), ENCODER)
    return found.select("item_id", F.round("norm", 6).alias("norm"), shown().alias("vector"))


@query("j05_cache_misses", sql("descs", """
    SELECT count(*) AS misses FROM descs WHERE p_size % 3 <> 0"""))
def j05_misses(t):
    return M.cache_misses(saved_index(t).descriptors, old_cache(t), ENCODER).agg(F.count(F.lit(1)).alias("misses"))


@query("s11_re_encode", sql("encoded", """
    SELECT norm, shown AS vector, count(*) AS n FROM encoded GROUP BY ALL""", _VECTORS))
def s11(t):
    cache = M.re_encode(saved_index(t).descriptors, old_cache(t), ENCODER)
    return cache.groupBy(F.round("norm", 6).alias("norm"), shown().alias("vector")).agg(F.count(F.lit(1)).alias("n"))


@query("v10_provider_identity", sql("descs", f"""
    SELECT '{ENCODER.provider_id}' AS provider_id, 1 AS provider_version, count(*) AS n FROM descs"""))
def v10(t):
    cache = M.encode_missing(saved_index(t).descriptors, old_cache(t).limit(0), ENCODER)
    return cache.groupBy("provider_id", "provider_version").agg(F.count(F.lit(1)).alias("n"))


# Snapshots and work.

def snapshots(t: Tables):
    k = F.col("container_id")
    return t.containers().select(
        k, F.when(k % 10 == 1, "rebuilt").otherwise(F.col("block_type")).alias("block_type"),
        F.md5(F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("!"))).otherwise(k.cast("string"))).alias("fingerprint"),
        (k % 25 == 2).alias("forced"),
        F.element_at(F.array(*[F.lit(s) for s in ("COMPLETE", "UNAVAILABLE", "MISSING", "UNRESOLVED_LOOT",
                                                  "UNSUPPORTED")]), (k % 5 + 1).cast("int")).alias("status"))


def current(t: Tables):
    k = F.col("container_id")
    return t.containers().filter(k % 6 != 0).select(k, "block_type", F.md5(k.cast("string")).alias("fingerprint"))


@query("t07_no_op_skip", sql("containers", """
    SELECT container_id FROM containers WHERE container_id % 25 = 2 OR container_id % 6 = 0 OR container_id % 10 = 1
        OR container_id % 4 = 0"""))
def t07(t):
    return M.changed_snapshots(snapshots(t), current(t)).select("container_id")


@query("t08_status_routing", sql("containers", """
    SELECT container_id, CASE container_id % 5 WHEN 0 THEN 'replace' WHEN 1 THEN 'keep' ELSE 'delete' END AS route
    FROM containers"""))
def t08(t):
    return M.route(snapshots(t)).select("container_id", "route")


@query("t09_key_migration", sql("containers", """
    SELECT container_id - container_id % 2 AS key, 'replace' AS action FROM containers
    UNION ALL SELECT container_id, 'delete' FROM containers WHERE container_id % 2 = 1"""))
def t09(t):
    k = F.col("container_id")
    work = t.containers().select(k.alias("work_key"), (k - k % 2).alias("canonical_key"))
    return M.migrate(work)


@query("t10_reconcile", sql("containers", """
    SELECT container_id, CASE WHEN container_id % 6 = 0 THEN 'added' WHEN container_id % 15 = 1 THEN 'removed'
        WHEN container_id % 10 = 1 OR container_id % 4 = 0 THEN 'changed' ELSE 'same' END AS change
    FROM containers WHERE NOT (container_id % 6 = 0 AND container_id % 15 = 1)"""))
def t10(t):
    return M.reconcile(current(t), snapshots(t).filter("container_id % 15 <> 1"))


def work(t: Tables):
    """Pending work as queued: a revision per change, the kind of change as action."""
    return t.history().select(
        F.col("player_id").alias("key"), F.col("event_id").alias("revision"),
        F.when(F.col("query") == "error", "DELETE").otherwise("SNAPSHOT").alias("action"))


@query("t04_delete_supersedes", sql("history", """
    SELECT player_id AS key, max(event_id) AS revision,
           CASE WHEN max_by(query, event_id) = 'error' THEN 'DELETE' ELSE 'SNAPSHOT' END AS action
    FROM history GROUP BY player_id"""))
def t04(t):
    return M.superseded_actions(work(t))


@query("t06_stale_drop", sql("history", """
    SELECT player_id AS key, event_id AS revision FROM history
    QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY event_id DESC) = 1"""))
def t06(t):
    return M.current_work(work(t)).select("key", "revision")


@query("t12_cell_readiness", sql("cells placed", """
    SELECT world_id, cell_x, cell_z, count(p.container_id) AS pending,
           cell_x % 7 <> 0 AND available AND count(p.container_id) = 0 AS ready
    FROM cells LEFT JOIN (SELECT * FROM placed WHERE owner_id % 40 = 0) p USING (world_id, cell_x, cell_z)
    GROUP BY world_id, cell_x, cell_z, available"""))
def t12(t):
    from stowfind.plans.index import placed

    cells = t.cells().select("world_id", "cell_x", "cell_z", (F.col("cell_x") % 7 != 0).alias("discovered"),
                             F.col("available").alias("written"))
    pending = placed(t.containers()).filter("owner_id % 40 = 0")
    return M.cell_readiness(cells, pending).select("world_id", "cell_x", "cell_z", "pending", "ready")


@query("g07_distinct_descriptors", sql("items", """
    SELECT CAST(count(*) AS BIGINT) AS descriptors, CAST(sum(copies) AS BIGINT) AS items
    FROM (SELECT d, count(*) AS copies FROM items GROUP BY d)"""))
def g07_distinct(t):
    return distinct_descriptors(t.slim_items(), t.parts()).agg(
        F.count(F.lit(1)).alias("descriptors"), F.sum("copies").alias("items"))
