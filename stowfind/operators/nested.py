"""Containers inside containers: flatten to leaves, pair halves, fan out to neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowfind.operators.ordered import top_n
from stowfind.session import scratch

INT_MIN, INT_MAX = -(2 ** 31), 2 ** 31 - 1


EXTRAS = ("path", "trail", "siblings")


def walk(roots: DataFrame, edges: DataFrame, max_depth: int = 4, extras: tuple[str, ...] = EXTRAS,
         first: int | None = None) -> DataFrame:
    """All nodes a depth-bounded walk visits, one row per node and branch.

    roots  root_id, node_id, label, slot, fingerprint
    edges  parent_id, child_id, label, slot, fingerprint, is_bad

    ``kind`` tells what the walk does with a node: ``open`` (replaced by its
    children), ``leaf``, or one of the truncating leaves ``depth``, ``cycle`` and
    ``bad``. ``trail`` orders nodes the way the walk meets them; ``siblings`` is
    the number of children of the node's parent. Only the ``extras`` that are named are carried.

    Each level is written to the shared folder before the next one starts from it, so a level costs one join; where no
    node is open there is no next one. With ``first`` only so many nodes of each root stay, in the order of the trail. A
    node comes after its ancestors, and nodes of deeper levels only add to those before it, so all others can go as
    soon as their own level is known.
    """
    if first is not None:
        extras = (*extras, *({"trail"} - set(extras)))
    if not 1 <= max_depth <= 8:
        raise ValueError("max_depth must lie in 1..8")
    families = edges.groupBy(F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("children"), F.max(F.coalesce("is_bad", F.lit(True))).alias("bad"))
    # Each edge learns about its child's own children once, so a level costs one join.
    kids = edges.select("parent_id", F.col("child_id").alias("node_id"), "label", "slot", "fingerprint").join(
        families, "node_id", "left").withColumnRenamed("node_id", "child_id")
    kids = scratch(kids, "nested-edges")

    def step(label: str, slot: str) -> Column:
        return F.struct(F.col(label).alias("label"), F.col(slot).alias("slot"))

    def kind(depth: int) -> Column:
        """What happens to a node at this depth; only the first level can end as a plain leaf at the limit."""
        inner = F.when(F.col("children").isNull(), "leaf").when(
            F.lit(depth == max_depth), "depth").when(F.col("bad"), "bad").otherwise("open")
        if depth == 1:
            return inner
        return F.when(F.col("again"), "cycle").otherwise(F.lit("depth") if depth == max_depth else inner)

    def carried(level: DataFrame) -> DataFrame:
        """Only open nodes need what their children are told."""
        known = F.when(F.col("kind") == "open", F.col("ancestors"))
        children = F.when(F.col("kind") == "open", F.col("children"))
        return level.select("root_id", "node_id", "depth", *extras, "kind", known.alias("ancestors"),
                            children.alias("children"))

    def pruned(nodes: DataFrame) -> DataFrame:
        return scratch(top_n(nodes, ["root_id"], [F.asc("trail")], first, "visit").drop("visit"), "nested-first")

    level = roots.join(families, "node_id", "left").select(
        "root_id", "node_id", F.lit(1).alias("depth"), F.array(step("label", "slot")).alias("path"),
        F.array(F.struct("slot", F.col("node_id").alias("id"))).alias("trail"),
        F.array("fingerprint").alias("ancestors"), kind(1).alias("kind"),
        F.lit(1).cast("long").alias("siblings"), "children")
    nodes = level = scratch(carried(level), "nested-level")
    for depth in range(2, max_depth + 1):
        rest = [c for c in extras if c != "siblings"]
        opened = level.filter("kind = 'open'").select(
            "root_id", F.col("node_id").alias("parent_id"), *rest, "ancestors", F.col("children").alias("siblings"))
        if opened.isEmpty():
            break
        longer = {"path": F.array(step("label", "slot")),
                  "trail": F.array(F.struct("slot", F.col("child_id").alias("id")))}
        level = opened.join(kids, "parent_id").withColumn(
            "again", F.array_contains("ancestors", F.col("fingerprint"))).select(
            "root_id", F.col("child_id").alias("node_id"), F.lit(depth).alias("depth"),
            *[F.concat(c, longer[c]).alias(c) for c in rest],
            F.concat("ancestors", F.array("fingerprint")).alias("ancestors"), kind(depth).alias("kind"),
            "siblings", "children")
        if first is None:
            level = scratch(carried(level), "nested-level")
            nodes = nodes.unionByName(level)
        else:
            nodes = pruned(nodes.unionByName(carried(level)))
            level = nodes.filter(F.col("depth") == depth)
    return nodes.drop("children", "ancestors")


def leaves(nodes: DataFrame) -> DataFrame:
    """Leaf rows of a walk."""
    return nodes.filter("kind <> 'open'").select(
        "root_id", "node_id", "depth", "path", (F.col("kind") != "leaf").alias("truncated"))


def coarsen(nodes: DataFrame, max_stacks: int = 4096) -> DataFrame:
    """Leaves after the visit budget of each root.

    The walk stops at the ``max_stacks``-th node. Every node on its way that
    still had children to visit is replaced by itself as a leaf, so the topmost
    of them decides: its whole subtree becomes that one leaf. Only the first
    ``max_stacks`` nodes per root can matter, so no task ever holds more of a root.
    """
    if not 1 <= max_stacks <= 16_384:
        raise ValueError("max_stacks must lie in 1..16384")
    visited = top_n(nodes, ["root_id"], [F.asc("trail")], max_stacks, "visit")
    root = Window.partitionBy("root_id")
    # The root's parent trail is empty and counts one sibling, itself.
    visited = visited.withColumns({
        "parent": F.slice("trail", 1, F.col("depth") - 1),
        "visited": F.count(F.lit(1)).over(root),
    })
    seen = F.count(F.lit(1)).over(Window.partitionBy("root_id", "parent"))
    last_open = (F.col("visit") == F.col("visited")) & (F.col("kind") == "open")
    unfinished = F.when(seen < F.col("siblings"), F.col("parent")).when(last_open, F.col("trail"))
    marked = visited.withColumn("unfinished", unfinished)
    marked = marked.withColumn("top", F.min_by("unfinished", F.when(
        F.col("unfinished").isNotNull(), F.size("unfinished"))).over(root))
    under = F.col("top").isNotNull() & (F.slice("trail", 1, F.size("top")) == F.col("top"))
    is_top = F.coalesce(F.col("trail") == F.col("top"), F.lit(False))
    rows = marked.filter(is_top | ((F.col("kind") != "open") & ~F.coalesce(under, F.lit(False))))
    return rows.select(
        "root_id", "node_id", "depth", "path", "visited",
        (is_top | (F.col("kind") != "leaf")).alias("truncated"))


def path_rows(hits: DataFrame, enchantments: str | None = None) -> DataFrame:
    """Report lines of a hit: one row per path step, then one per enchantment."""
    keys = [c for c in hits.columns if c not in ("path", "amount", "leaf", enchantments)]
    steps = hits.select(*keys, "path", "amount", "leaf", F.posexplode("path").alias("line", "step"))
    last = F.col("line") == F.size("path") - 1
    following = F.try_element_at("path", F.col("line") + 2)["label"]
    rows = steps.select(
        *keys, F.col("line"), F.col("line").alias("indent"), F.col("step.slot").alias("slot"),
        F.when(last, F.col("leaf")).otherwise(following).alias("name"),
        F.when(last, F.col("amount")).otherwise(1).alias("amount"))
    if enchantments is None:
        return rows
    extra = hits.select(*keys, F.size("path").alias("depth"), F.posexplode(
        F.array_sort(F.map_entries(enchantments))).alias("n", "e"))
    return rows.unionByName(extra.select(
        *keys, (F.col("depth") + F.col("n")).alias("line"), F.col("depth").alias("indent"),
        F.lit(None).cast("int").alias("slot"), F.col("e.key").alias("name"), F.col("e.value").alias("amount")))


def resolve_pairs(probes: DataFrame) -> DataFrame:
    """Status and canonical place of each probed block.

    probes: world_id, x, y, z, available, present, block_type, persistent,
    unresolved_loot, other (struct world_id, x, y, z or NULL), other_loaded, has_inventory
    """
    place = ["world_id", "x", "y", "z"]
    ender = "minecraft:ender_chest"
    me = probes.withColumn("here", F.struct(*place))
    mate = me.select(
        F.col("here").alias("other"), F.col("present").alias("m_found"), F.col("block_type").alias("m_type"),
        F.col("persistent").alias("m_persistent"), F.col("unresolved_loot").alias("m_loot"),
        F.col("other").alias("m_other"), F.col("other_loaded").alias("m_loaded"),
        F.col("has_inventory").alias("m_inventory"))
    # Blocks without a mate skip the join, or their NULL keys would meet in one task.
    both = me.filter("other is not null").join(mate, "other", "left").unionByName(
        me.filter("other is null"), allowMissingColumns=True)
    here, other = F.col("here"), F.col("other")
    canonical = F.when(other.isNull(), here).otherwise(F.least(here, other))
    mine = F.col("has_inventory")
    inventory = F.when(canonical == here, mine).otherwise(F.col("m_inventory"))
    blank_type = F.col("block_type").isNull() | F.trim("block_type").eqNullSafe("")
    bad_mate = (
        (F.col("here.world_id") != F.col("other.world_id")) | ~F.col("other_loaded")
        | ~F.coalesce("m_found", F.lit(False)) | ~F.col("m_persistent")
        | ~F.col("block_type").eqNullSafe(F.col("m_type")) | ~F.coalesce("m_loaded", F.lit(False)))
    status = (
        F.when(~F.col("available"), "UNAVAILABLE")
        .when(~F.col("present"), "MISSING")
        .when(~F.col("persistent") | blank_type | (F.col("block_type") == ender), "UNSUPPORTED")
        .when(F.col("unresolved_loot"), "UNRESOLVED_LOOT")
        .when(other.isNull(), F.when(mine, "RESOLVED").otherwise("UNAVAILABLE"))
        .when(bad_mate, "UNAVAILABLE")
        .when(F.col("m_loot"), "UNRESOLVED_LOOT")
        .when(~F.col("m_other").eqNullSafe(here), "UNAVAILABLE")
        .when(~inventory, "UNAVAILABLE")
        .otherwise("RESOLVED"))
    resolved = F.col("status") == "RESOLVED"
    return both.withColumn("status", status).select(
        *place, "status",
        *[F.when(resolved, canonical[c]).alias(f"canonical_{c}") for c in place])


def neighbours(blocks: DataFrame) -> DataFrame:
    """Each changed block and its four horizontal neighbours inside the INT range."""
    moves = F.array(*[
        F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dz).cast("long").alias("dz"))
        for dx, dz in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    rest = [c for c in blocks.columns if c not in ("x", "z")]
    spread = blocks.select(*rest, "x", "z", F.inline(moves))
    near = spread.select(*rest, (F.col("x") + F.col("dx")).alias("x"), (F.col("z") + F.col("dz")).alias("z"))
    inside = F.col("x").between(INT_MIN, INT_MAX) & F.col("z").between(INT_MIN, INT_MAX)
    return near.filter(inside).select(*rest, F.col("x").cast("int"), F.col("z").cast("int"))
