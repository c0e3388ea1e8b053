"""Registered queries for lookups, checks, pages and the search history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stowfind.catalog.base import EPOCH_MS, query, sql
from stowfind.catalog.retrieval import found
from stowfind.operators import access as A
from stowfind.operators import quality as Q
from stowfind.operators.joins import lookup_join
from stowfind.operators.ordered import page, running_count
from stowfind.plans import history as H
from stowfind.plans import maintain as M
from stowfind.session import shared_folder
from stowfind.sources.tables import Tables, saved_index
from stowfind.streaming import feed

DAY = 48


def day(ts: str = "ts_ms"):
    return F.floor(F.col(ts) / H.DAY_MS)


# Sources and joins.

@query("s01_item_scan", sql("ditems", """
    SELECT item_id, container_id, slot, amount, material_key, world_id, x, y, z FROM ditems"""))
def s01(t):
    return saved_index(t).items.select("item_id", "container_id", F.col("path")[0]["slot"].alias("slot"), "amount",
                                       "material_key", "world_id", "x", "y", "z")


@query("s02_document_load", sql("containers items", """
    SELECT container_id, count(item_id) AS n_items FROM containers LEFT JOIN items USING (container_id)
    WHERE owner_id % 10 = 0 GROUP BY container_id"""))
def s02(t):
    wanted = t.containers().filter("owner_id % 10 = 0")
    return M.document_counts(saved_index(t).items, wanted, ["container_id"])


@query("s03_find_root", sql("containers", """
    SELECT container_id, block_type FROM containers WHERE world_id = 'O' AND x = -128 + 40 AND y = 64 AND z = -128"""))
def s03(t):
    return M.find_root(t.containers(), "O", -88, 64, -128).select("container_id", "block_type")


@query("j02_cell_join", sql("placed cells", """
    SELECT container_id, available FROM placed JOIN cells USING (world_id, cell_x, cell_z)"""))
def j02(t):
    from stowfind.plans.index import placed

    return lookup_join(placed(t.containers()), t.cells(), ["world_id", "cell_x", "cell_z"]).select(
        "container_id", "available")


@query("j03_place_semi_join", sql("ditems containers", """
    SELECT item_id FROM ditems SEMI JOIN (SELECT world_id, x, y, z FROM containers WHERE owner_id % 10 = 3) w
    USING (world_id, x, y, z)"""))
def j03(t):
    wanted = t.containers().filter("owner_id % 10 = 3")
    return M.load_documents(saved_index(t).items, wanted, ["world_id", "x", "y", "z"]).select("item_id")


# Access and freshness.

def indexed_hits(t: Tables):
    """Items as hits, with the identity they were indexed under."""
    return saved_index(t).items.select(
        "item_id", "container_id", "path", "amount", "material_key", "block_type",
        F.md5(F.col("container_id").cast("string")).alias("fingerprint"))


def live_containers(t: Tables):
    k = F.col("container_id")
    now = t.containers().filter(k % 9 != 0)
    return now.select(k, F.when(k % 8 == 0, "rebuilt").otherwise(F.col("block_type")).alias("block_type"),
                      F.md5(F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit("!"))).otherwise(
                          k.cast("string"))).alias("fingerprint"))


@query("p05_freshness", sql("items", """
    SELECT item_id FROM items WHERE container_id % 9 <> 0 AND container_id % 8 <> 0"""))
def p05(t):
    return A.fresh(indexed_hits(t), live_containers(t)).select("item_id")


_LIVE = {"live": ("items", """
    SELECT container_id, slot, count(*) AS n, max(amount) AS amount FROM (
        SELECT container_id, slot, amount + 1 AS amount FROM items WHERE slot % 4 <> 0
        UNION ALL SELECT container_id, slot, 0 FROM items WHERE container_id % 21 = 1 AND slot = 1) GROUP BY ALL"""),
    "twice": ("live", "SELECT DISTINCT container_id FROM live WHERE n > 1")}


@query("j10_refresh", sql("items live twice", """
    SELECT i.item_id, CASE WHEN l.amount IS NOT NULL AND container_id % 9 <> 0 AND container_id % 8 <> 0
                                AND container_id % 7 <> 0 AND t.container_id IS NULL
                           THEN l.amount ELSE i.amount END AS amount
    FROM items i LEFT JOIN live l USING (container_id, slot) LEFT JOIN twice t USING (container_id)""", _LIVE))
def j10(t):
    hits = indexed_hits(t)
    now = hits.filter("path[0].slot % 4 <> 0").withColumn("amount", F.col("amount") + 1)
    double = hits.filter("container_id % 21 = 1 and path[0].slot = 1").withColumn("amount", F.lit(0))
    return A.refresh(hits, now.unionByName(double), live_containers(t)).select("item_id", "amount")


@query("g10_visible_totals", sql("items", """
    SELECT container_id % 50 AS query_id, count(DISTINCT container_id) AS visible_roots, count(*) AS visible_stacks
    FROM items WHERE container_id % 9 <> 0 AND container_id % 8 <> 0 GROUP BY ALL"""))
def g10(t):
    fresh = A.fresh(indexed_hits(t), live_containers(t))
    roots = fresh.groupBy((F.col("container_id") % 50).alias("query_id"), "container_id").agg(
        F.count(F.lit(1)).alias("total_stacks"))
    return A.visible_totals(roots)


# Checks.

@query("p08_provider_identity", """
    SELECT vec_id % 3 = 1 AS bad, count(*) AS n FROM embeddings GROUP BY ALL""")
def p08(t):
    stored = t.read("embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 3 == 1, "other").otherwise("mine").alias("provider_id"),
        F.lit(2).alias("provider_version"))
    checked = Q.validate(stored, Q.provider_rule("mine", 2))
    return checked.groupBy((F.size("reasons") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n"))


@query("p09_score_sanity", """
    SELECT event_id, coalesce(value / 20 > 1.0 OR event_id % 50 = 0, true) AS bad FROM events""")
def p09(t):
    score = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 20)
    checked = Q.validate(t.read("events").select("event_id", score.alias("score")), Q.score_rule("score"))
    return checked.select("event_id", (F.size("reasons") > 0).alias("bad"))


@query("q01_item_quarantine", sql("items", """
    SELECT item_id, CASE WHEN slot = 7 THEN 'slot,' ELSE '' END || CASE WHEN amount <= 3 THEN 'amount,' ELSE '' END
           || CASE WHEN container_id % 100 = 5 THEN 'material,' ELSE '' END AS reasons
    FROM items WHERE slot = 7 OR amount <= 3 OR container_id % 100 = 5"""))
def q01(t):
    d = F.col("descriptor")
    spoiled = t.items().withColumn("amount", F.col("amount") - 3).withColumn(
        "path", F.transform("path", lambda s: s.withField("slot", F.when(s["slot"] == 7, -1).otherwise(s["slot"]))))
    spoiled = spoiled.withColumn("descriptor", d.withField("material_key", F.when(
        F.col("container_id") % 100 == 5, "  ").otherwise(d["material_key"])))
    _, quarantine = Q.split(spoiled, Q.item_rules())
    return quarantine.select("item_id", F.concat_ws("", F.transform(
        "reasons", lambda r: F.concat(r, F.lit(",")))).alias("reasons"))


@query("q01_vector_quarantine", """
    SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 'norm' WHEN vec_id % 10 = 4 THEN 'dimension,norm'
                        WHEN vec_id % 10 = 5 THEN 'finite,norm' ELSE '' END AS reasons FROM embeddings""")
def q01_vectors(t):
    from stowfind.functions.vectors import l2_norm

    v, k = F.col("embedding"), F.col("vec_id") % 10
    rows = t.read("embeddings").withColumn("norm", l2_norm(v) + F.when(k == 3, 1.0).otherwise(0.0))
    rows = rows.withColumn("embedding", F.when(k == 4, F.slice(v, 1, 60)).when(
        k == 5, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(v))
    checked = Q.validate(rows, Q.dense_vector_rules("embedding", "norm", 64))
    return checked.select("vec_id", F.array_join("reasons", ",").alias("reasons"))


@query("g08_count_check", sql("items descs", """
    SELECT (SELECT count(*) FROM items) AS left_rows, (SELECT count(*) FROM items) AS right_rows, true AS equal"""))
def g08(t):
    return Q.same_count(t.read("lineitem"), saved_index(t).items)


@query("p10_click_relevance", """
    SELECT event_id FROM events WHERE CASE event_id % 3
        WHEN 0 THEN CASE WHEN CAST(floor(value) AS INT) % 40 BETWEEN 0 AND 26
                         THEN event_type NOT IN ('view', 'error') ELSE event_type = 'purchase' END
        WHEN 1 THEN CAST(floor(value) AS INT) % 40 < 27 OR event_id % 30 < 27
        ELSE true END""")
def p10(t):
    action = F.create_map(*[F.lit(v) for pair in (
        ("view", "NOTHING"), ("error", "CLONE_STACK"), ("purchase", "MOVE_TO_OTHER_INVENTORY"),
        ("click", "PICKUP_ALL"), ("signup", "PLACE_ALL")) for v in pair])
    k, slot = F.col("event_id"), (F.floor("value") % 40).cast("int")
    events = t.read("events").select(
        "event_id", F.when(k % 3 == 0, "click").when(k % 3 == 1, "drag").otherwise("break").alias("event"),
        slot.alias("raw_slot"), F.lit(27).alias("top_size"), action[F.col("event_type")].alias("action"),
        F.array(slot, (k % 30).cast("int")).alias("raw_slots"))
    return feed.relevant(events).select("event_id")


# Pages and orders.

@query("l03_keyset_page", sql("containers", """
    SELECT container_id FROM containers WHERE (x, y, z, world_id, container_id) > (0, 64, 0, 'F', 0)
    ORDER BY x, y, z, world_id, container_id LIMIT 129"""))
def l03(t):
    order = ["x", "y", "z", "world_id", "container_id"]
    return page(t.containers(), order, 128, (0, 64, 0, "F", 0)).select("container_id")


@query("l04_latest_history", sql("history", """
    SELECT id, player_id, ts_ms FROM history ORDER BY ts_ms DESC, id LIMIT 100"""))
def l04(t):
    return H.latest_overall(t.history(), 100).select("id", "player_id", "ts_ms")


@query("l06_due_order", sql("placed", """
    SELECT container_id, row_number() OVER (PARTITION BY world_id ORDER BY x, y, z) AS position FROM placed"""))
def l06(t):
    from stowfind.plans.index import placed

    rows = placed(t.containers())
    return running_count(rows, ["world_id"], ["x", "y", "z"], F.col("cell_x"), "position").select(
        "container_id", "position")


@query("u02_vanished_roots", sql("containers", """
    SELECT container_id FROM containers WHERE container_id % 9 = 0"""))
def u02(t):
    return M.vanished(t.containers(), live_containers(t), ["container_id"])


# History and limits.

@query("w06_latest_per_player", sql("history", """
    SELECT player_id, id, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts_ms DESC, id) AS rank FROM history)
    WHERE rank <= 5"""))
def w06(t):
    return H.latest_per_player(t.history(), 5).select("player_id", "id", "rank")


@query("s08_history_append", sql("history", """
    SELECT player_id, count(*) AS searches, CAST(sum(result_count) AS BIGINT) AS results, count(*) AS ids
    FROM history GROUP BY player_id"""))
def s08(t):
    path = f"{shared_folder(t.spark)}/stowfind-history-{uuid.uuid4().hex}"
    rows = t.history()
    early = F.col("event_id") % 2 == 0
    H.append(rows.filter(early), path)
    H.append(rows.filter(~early).withColumn("id", F.lit(None).cast("string")), path)
    return t.spark.read.parquet(path).groupBy("player_id").agg(
        F.count(F.lit(1)).alias("searches"), F.sum("result_count").alias("results"), F.count("id").alias("ids"))


@query("t14_history_retention", sql("history", """
    SELECT id, player_id FROM history WHERE ts_ms >= 1706572800000 - 7 * 86400000 AND player_id <> 8"""))
def t14(t):
    kept = H.prune(t.history(), 1_706_572_800_000, 7)
    return H.clear_player(kept, 8).select("id", "player_id")


def radii(t: Tables):
    rows = t.history().select("player_id", (F.col("result_count") % 128 + 1).alias("radius"),
                              F.col("event_id").alias("updated_at"))
    return H.set_radius(rows.filter("updated_at % 2 = 0"), rows.filter("updated_at % 2 = 1"))


_RADII = {"radii": ("history", """
    SELECT player_id, max_by(CAST(result_count % 128 + 1 AS INT), event_id) AS radius, max(event_id) AS updated_at
    FROM history GROUP BY player_id""")}


@query("s09_radius_upsert", sql("radii", "SELECT * FROM radii", _RADII))
def s09(t):
    return radii(t)


@query("j09_default_radius", sql("radii", """
    SELECT c_custkey AS player_id, coalesce(radius, 32) AS radius
    FROM customer LEFT JOIN radii ON player_id = c_custkey""", _RADII))
def j09(t):
    players = t.read("customer").select(F.col("c_custkey").alias("player_id"))
    return H.effective_radius(players, radii(t), 32)


@query("t13_sessions", sql("history", """
    SELECT event_id AS request_id, player_id, ts_ms,
           CASE WHEN next_ms < ts_ms + 20000000 THEN 'superseded' ELSE 'expired' END AS outcome,
           least(coalesce(next_ms, ts_ms + 20000000), ts_ms + 20000000) AS end_ms
    FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY player_id ORDER BY ts_ms, event_id) AS next_ms FROM history)"""))
def t13(t):
    requests = t.history().select("player_id", "ts_ms", F.col("event_id").alias("request_id"))
    return H.sessions(requests, 20_000_000, day())


@query("s10_schema_rebuild", sql("items fields", """
    SELECT (SELECT count(*) FROM items) AS left_rows,
           (SELECT count(*) FROM items SEMI JOIN fields USING (d)) AS right_rows, true AS equal"""))
def s10(t):
    from stowfind.plans.index import distinct_descriptors, search_documents

    items = t.slim_items()
    documents = search_documents(distinct_descriptors(items, t.parts()))
    derived = items.join(documents.withColumnRenamed("desc_id", "desc_hash"), "desc_hash")
    return Q.same_count(items, derived)
