"""Registered queries for nested contents, paired halves and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowfind.catalog.base import query, sql
from stowfind.functions.text import title_name
from stowfind.operators import nested as N
from stowfind.sources.tables import Tables, line_id


def hierarchy(t: Tables):
    """Regions hold nations, nations customers, customers orders, orders lines.

    Some customers repeat the fingerprint of their nation, some orders that of
    their customer, and a few orders have a child that cannot be read.
    """
    region = t.read("region").select(
        F.lit("root").alias("root_id"), F.concat(F.lit("r"), "r_regionkey").alias("node_id"),
        F.lit("region").alias("label"), F.col("r_regionkey").cast("int").alias("slot"))
    roots = region.select(F.col("node_id").alias("root_id"), "node_id", "label", "slot",
                          F.col("node_id").alias("fingerprint"))

    def edge(rows, parent, child, label, slot, fingerprint=None, bad=F.lit(False)):
        return rows.select(
            parent.alias("parent_id"), child.alias("child_id"), F.lit(label).alias("label"),
            slot.cast("int").alias("slot"), (child if fingerprint is None else fingerprint).alias("fingerprint"),
            bad.alias("is_bad"))

    def name(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    nation = edge(t.read("nation"), name("r", "n_regionkey"), name("n", "n_nationkey"), "nation", F.col("n_nationkey"))
    ckey, okey = F.col("c_custkey"), F.col("o_orderkey")
    customer = edge(t.read("customer"), name("n", "c_nationkey"), name("c", "c_custkey"), "customer", ckey,
                    F.when(ckey % 50 == 0, name("n", "c_nationkey")).otherwise(name("c", "c_custkey")))
    order = edge(t.read("orders"), name("c", "o_custkey"), name("o", "o_orderkey"), "order", okey,
                 F.when(okey % 40 == 0, name("c", "o_custkey")).otherwise(name("o", "o_orderkey")))
    lines = t.numbered_lines().withColumn("line_id", line_id(F.col("l_orderkey"), F.col("slot")))
    line = edge(lines, name("o", "l_orderkey"), name("l", "line_id"), "line", F.col("slot"),
                bad=(F.col("l_orderkey") % 97 == 0) & (F.col("slot") == 1))
    return roots, nation.unionByName(customer).unionByName(order).unionByName(line)


_TREE = {
    "edges": ("lines", """
        SELECT 'r' || n_regionkey AS parent_id, 'n' || n_nationkey AS child_id, 'nation' AS label,
               n_nationkey AS slot, 'n' || n_nationkey AS fp, false AS bad FROM nation
        UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'customer', c_custkey,
               CASE WHEN c_custkey % 50 = 0 THEN 'n' || c_nationkey ELSE 'c' || c_custkey END, false FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'order', o_orderkey,
               CASE WHEN o_orderkey % 40 = 0 THEN 'c' || o_custkey ELSE 'o' || o_orderkey END, false FROM orders
        UNION ALL SELECT 'o' || l_orderkey, 'l' || (l_orderkey * 1048576 + slot), 'line', slot,
               'l' || (l_orderkey * 1048576 + slot), l_orderkey % 97 = 0 AND slot = 1 FROM lines"""),
    "families": ("edges", "SELECT parent_id AS id, bool_or(bad) AS bad FROM edges GROUP BY parent_id"),
}


def tree(depth: int) -> dict:
    levels = {"level1": ("families", f"""
        SELECT 'r' || r_regionkey AS root_id, 'r' || r_regionkey AS node_id, 1 AS depth,
               'region:' || r_regionkey AS path, [r_regionkey::BIGINT] AS trail, ['r' || r_regionkey] AS fps,
               CASE WHEN f.id IS NULL THEN 'leaf' WHEN {depth} = 1 THEN 'depth' WHEN f.bad THEN 'bad' ELSE 'open' END
               AS kind
        FROM region LEFT JOIN families f ON f.id = 'r' || r_regionkey""")}
    for n in range(2, depth + 1):
        inner = "'depth'" if n == depth else \
            "CASE WHEN f.id IS NULL THEN 'leaf' WHEN f.bad THEN 'bad' ELSE 'open' END"
        levels[f"level{n}"] = (f"level{n - 1} families edges", f"""
            SELECT root_id, child_id AS node_id, {n} AS depth, path || '/' || label || ':' || slot AS path,
                   list_append(trail, slot::BIGINT) AS trail, list_append(fps, fp) AS fps,
                   CASE WHEN list_contains(fps, fp) THEN 'cycle' ELSE {inner} END AS kind
            FROM level{n - 1} JOIN edges ON parent_id = node_id LEFT JOIN families f ON f.id = child_id
            WHERE kind = 'open'""")
    names = " ".join(f"level{n}" for n in range(1, depth + 1))
    levels["nodes"] = (names, " UNION ALL ".join(f"SELECT * FROM {n}" for n in names.split()))
    return _TREE | levels


def shown(path="path"):
    return F.array_join(F.transform(path, lambda s: F.concat(s["label"], F.lit(":"), s["slot"].cast("string"))), "/")


def nodes(t: Tables, depth: int = 4, extras: tuple[str, ...] = ("path",), first: int | None = None):
    roots, edges = hierarchy(t)
    return N.walk(roots, edges, depth, extras, first)


_LEAVES = """
    SELECT root_id, node_id, depth, path, kind <> 'leaf' AS truncated FROM nodes WHERE kind <> 'open'"""


@query("n01_flatten", sql("nodes", _LEAVES, tree(4)))
def n01(t):
    return N.leaves(nodes(t)).select("root_id", "node_id", "depth", shown().alias("path"), "truncated")


@query("n01_flatten_deep", sql("nodes", _LEAVES, tree(6)))
def n01_deep(t):
    return N.leaves(nodes(t, 6)).select("root_id", "node_id", "depth", shown().alias("path"), "truncated")


@query("n02_cycle_guard", sql("nodes", """
    SELECT root_id, depth, kind, count(*) AS n FROM nodes WHERE kind <> 'bad' GROUP BY ALL""", tree(6)))
def n02(t):
    return nodes(t, 6, ()).filter("kind <> 'bad'").groupBy("root_id", "depth", "kind").agg(F.count(F.lit(1)).alias("n"))


_BUDGET = {
    "visited": ("nodes", """
        SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY trail) AS visit FROM nodes QUALIFY visit <= 2000"""),
    "last": ("visited", "SELECT root_id, max(trail) AS last_trail, count(*) AS visited FROM visited GROUP BY root_id"),
    "cut": ("nodes last", """
        SELECT root_id, min_by(parent, len(parent)) AS top FROM (
            SELECT n.root_id, list_slice(trail, 1, depth - 1) AS parent, last_trail
            FROM nodes n JOIN last USING (root_id) WHERE visited = 2000 AND trail > last_trail)
        WHERE parent <= last_trail GROUP BY root_id"""),
}


@query("n03_visit_budget", sql("visited cut last", """
    SELECT root_id, node_id, depth, path, visited, trail = top IS TRUE OR kind <> 'leaf' AS truncated
    FROM visited LEFT JOIN cut USING (root_id) JOIN last USING (root_id)
    WHERE (trail = top) IS TRUE OR (kind <> 'open' AND (list_slice(trail, 1, len(top)) = top) IS NOT TRUE)""",
    tree(5) | _BUDGET))
def n03(t):
    cut = N.coarsen(nodes(t, 5, N.EXTRAS, first=2000), 2000)
    return cut.select("root_id", "node_id", "depth", shown().alias("path"), "visited", "truncated")


@query("n04_failure_isolation", sql("nodes", """
    SELECT root_id, node_id, path FROM nodes WHERE kind = 'bad'""", tree(6)))
def n04(t):
    return nodes(t, 6).filter("kind = 'bad'").select("root_id", "node_id", shown().alias("path"))


@query("n05_path_order", sql("items", """
    SELECT item_id, CAST(row_number() OVER (PARTITION BY container_id // 64 ORDER BY label, slot, item_id) AS INT)
           AS position FROM items"""))
def n05(t):
    from pyspark.sql import Window

    w = Window.partitionBy(F.floor(F.col("container_id") / 64)).orderBy("path", "item_id")
    return t.items().select("item_id", F.row_number().over(w).alias("position"))


@query("n06_path_rows", sql("items parts", """
    SELECT item_id, 0 AS line, 0 AS indent, 7 AS slot, 'Inner Box' AS name, 1 AS amount FROM items
    UNION ALL SELECT item_id, 1, 1, slot, replace(upper(material_key[6]) || material_key[7:], '_', ' ') AS name, amount
    FROM (SELECT item_id, slot, amount, material_key FROM items)
    UNION ALL SELECT item_id, 2, 2, NULL, 'mending', p_size % 5 + 1 FROM items
    JOIN (SELECT DISTINCT d, p_size, has_ench FROM parts) USING (d) WHERE has_ench"""
    .replace("replace(upper(material_key[6]) || material_key[7:], '_', ' ')",
             "array_to_string(list_transform(string_split(substr(material_key, 6), '_'), "
             "lambda w: upper(w[1]) || w[2:]), ' ')")))
def n06(t):
    hits = t.items().select(
        "item_id", "amount", title_name(F.col("descriptor.material_key")).alias("leaf"),
        F.array(F.struct(F.lit("Outer Box").alias("label"), F.lit(7).alias("slot")),
                F.struct(F.lit("Inner Box").alias("label"), F.col("path")[0]["slot"].alias("slot"))).alias("path"),
        F.col("descriptor.enchantments").alias("enchantments"))
    return N.path_rows(hits, "enchantments")


def probes(t: Tables):
    """Orders as blocks; an order and its neighbour by key form a pair in two of three cases."""
    k, c = F.col("container_id"), F.col("owner_id")
    blocks = t.containers()
    mate = F.when(k % 2 == 0, k + 1).otherwise(k - 1)
    paired = F.floor(k / 2) % 3 != 0
    places = blocks.select(k.alias("mate_id"), F.struct("world_id", "x", "y", "z").alias("mate"))
    rows = blocks.filter(paired).withColumn("mate_id", mate).join(places, "mate_id", "left").drop("mate_id").unionByName(
        blocks.filter(~paired), allowMissingColumns=True)
    return rows.select(
        "world_id", "x", "y", "z", (c % 19 != 0).alias("available"), (c % 23 != 0).alias("present"),
        F.when(c % 29 == 0, "minecraft:ender_chest").when(c % 31 == 0, " ")
        .otherwise(F.when(k % 5 == 0, "chest").otherwise("barrel")).alias("block_type"),
        (c % 17 != 0).alias("persistent"), (c % 13 == 0).alias("unresolved_loot"),
        F.when(k % 41 != 0, F.col("mate")).alias("other"), (c % 11 != 0).alias("other_loaded"),
        (c % 37 != 0).alias("has_inventory"))


_PAIRS = {"probes": ("containers", """
    SELECT container_id AS k, world_id, x, y, z, owner_id % 19 <> 0 AS available, owner_id % 23 <> 0 AS present,
           CASE WHEN owner_id % 29 = 0 THEN 'minecraft:ender_chest' WHEN owner_id % 31 = 0 THEN ' '
                WHEN container_id % 5 = 0 THEN 'chest' ELSE 'barrel' END AS block_type,
           owner_id % 17 <> 0 AS persistent, owner_id % 13 = 0 AS loot,
           CASE WHEN container_id % 41 <> 0 AND (container_id // 2) % 3 <> 0
                THEN CASE WHEN container_id % 2 = 0 THEN container_id + 1 ELSE container_id - 1 END END AS mate_id,
           owner_id % 11 <> 0 AS loaded, owner_id % 37 <> 0 AS inv FROM containers"""),
    "resolved": ("probes", """
    SELECT p.*, m.world_id AS mw, m.x AS mx, m.y AS my, m.z AS mz,
           m.k IS NOT NULL AND (p.world_id, p.x, p.y, p.z) > (m.world_id, m.x, m.y, m.z) AS other_first,
           CASE WHEN NOT p.available THEN 'UNAVAILABLE' WHEN NOT p.present THEN 'MISSING'
                WHEN NOT p.persistent OR trim(p.block_type) = '' OR p.block_type = 'minecraft:ender_chest'
                THEN 'UNSUPPORTED' WHEN p.loot THEN 'UNRESOLVED_LOOT'
                WHEN m.k IS NULL THEN CASE WHEN p.inv THEN 'RESOLVED' ELSE 'UNAVAILABLE' END
                WHEN p.world_id <> m.world_id OR NOT p.loaded OR NOT m.present OR NOT m.persistent
                  OR p.block_type <> m.block_type OR NOT m.loaded THEN 'UNAVAILABLE'
                WHEN m.loot THEN 'UNRESOLVED_LOOT'
                WHEN m.mate_id IS DISTINCT FROM p.k THEN 'UNAVAILABLE'
                WHEN NOT (CASE WHEN other_first THEN m.inv ELSE p.inv END) THEN 'UNAVAILABLE'
                ELSE 'RESOLVED' END AS status
    FROM probes p LEFT JOIN probes m ON m.k = p.mate_id""")}


@query("n07_pair_canonical", sql("resolved", """
    SELECT world_id, x, y, z, status,
           CASE WHEN status = 'RESOLVED' THEN CASE WHEN other_first THEN mw ELSE world_id END END AS canonical_world_id,
           CASE WHEN status = 'RESOLVED' THEN CASE WHEN other_first THEN mx ELSE x END END AS canonical_x,
           CASE WHEN status = 'RESOLVED' THEN CASE WHEN other_first THEN my ELSE y END END AS canonical_y,
           CASE WHEN status = 'RESOLVED' THEN CASE WHEN other_first THEN mz ELSE z END END AS canonical_z
    FROM resolved""", _PAIRS))
def n07(t):
    return N.resolve_pairs(probes(t))


@query("n08_neighbours", sql("containers", """
    SELECT world_id, x + dx AS x, y, z + dz AS z, count(*) AS changed
    FROM containers, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dz) GROUP BY ALL"""))
def n08(t):
    changed = t.containers().select("world_id", "x", "y", "z")
    return N.neighbours(changed).groupBy("world_id", "x", "y", "z").agg(F.count(F.lit(1)).alias("changed"))
