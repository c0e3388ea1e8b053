import random

import pytest
from pyspark.sql import functions as F

from stowfind.operators import nested as N

EDGE = "parent_id string, child_id string, label string, slot int, fingerprint string, is_bad boolean"
ROOT = "root_id string, node_id string, label string, slot int, fingerprint string"


def frames(spark, edges, root=("a", "a", "Chest", 4, "fa")):
    return spark.createDataFrame([root], ROOT), spark.createDataFrame(
        [(p, c, label, s, f"f{c}" if f is None else f, bad) for p, c, label, s, f, bad in edges], EDGE)


def chain(n):
    return [(chr(97 + i), chr(98 + i), "box", i, None, False) for i in range(n)]


def rows(frame):
    return sorted((r["node_id"], len(r["path"]), r["truncated"]) for r in frame.collect())


def test_path_and_depth(spark):
    roots, edges = frames(spark, [("a", "b", "shulker", 12, None, False)])
    leaf = N.leaves(N.walk(roots, edges)).first()
    assert [tuple(s) for s in leaf["path"]] == [("Chest", 4), ("shulker", 12)] and not leaf["truncated"]
    roots, edges = frames(spark, chain(6))
    assert rows(N.leaves(N.walk(roots, edges, 4))) == [("d", 4, True)]
    roots, edges = frames(spark, chain(3))
    assert rows(N.leaves(N.walk(roots, edges, 4))) == [("d", 4, True)]
    assert rows(N.leaves(N.walk(roots, edges, 1))) == [("a", 1, True)]
    with pytest.raises(ValueError):
        N.walk(roots, edges, 9)


def test_cycles_and_equal_siblings(spark):
    roots, edges = frames(spark, [("a", "b", "x", 1, None, False), ("b", "c", "x", 1, "fa", False), ("c", "d", "x", 1, None, False)])
    assert rows(N.leaves(N.walk(roots, edges, 8))) == [("c", 3, True)]
    roots, edges = frames(spark, [("a", "b", "x", 1, "s", False), ("a", "c", "x", 2, "s", False),
                                  ("b", "d", "x", 1, None, False), ("c", "e", "x", 1, None, False)])
    assert rows(N.leaves(N.walk(roots, edges, 8))) == [("d", 3, False), ("e", 3, False)]


def test_unreadable_child_makes_a_leaf(spark):
    roots, edges = frames(spark, [("a", "b", "x", 1, None, False), ("b", "c", "x", 1, None, True), ("b", "d", "x", 2, None, False)])
    assert rows(N.leaves(N.walk(roots, edges, 8))) == [("b", 2, True)]


def walk_by_hand(children, prints, root, max_depth, budget):
    """Depth-first reference for the visit budget."""
    out, visited = [], [1]

    def descend(node, depth, branch):
        start = len(out)
        kids = children.get(node, [])
        if not kids or depth >= max_depth:
            out.append((node, depth, bool(kids)))
            return
        for kid in kids:
            if visited[0] >= budget:
                del out[start:]
                out.append((node, depth, True))
                return
            visited[0] += 1
            if prints[kid] in branch or depth + 1 >= max_depth:
                out.append((kid, depth + 1, True))
            else:
                descend(kid, depth + 1, branch | {prints[kid]})

    descend(root, 1, {prints[root]})
    return sorted(out), visited[0]


@pytest.mark.parametrize("seed", range(6))
def test_budget_against_recursion(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(60)]
    children, prints, edges = {}, {n: f"f{n}" for n in names}, []
    for i, n in enumerate(names[1:], 1):
        parent = names[rng.randrange(max(0, i - 12), i)]
        children.setdefault(parent, []).append(n)
        if rng.random() < 0.1:
            prints[n] = prints[parent]
        edges.append((parent, n, "box", len(children[parent]), prints[n], False))
    roots, table = frames(spark, edges, ("n000", "n000", "Chest", 0, prints["n000"]))
    nodes = N.walk(roots, table, 5)
    for budget in (1, 2, 7, 19, 30, 500):
        got = N.coarsen(nodes, budget).collect()
        want, visited = walk_by_hand(children, prints, "n000", 5, budget)
        assert sorted((r["node_id"], r["depth"], r["truncated"]) for r in got) == want
        assert {r["visited"] for r in got} == {visited}


def test_container_beyond_budget(spark):
    edges = spark.range(5000).select(
        F.lit("a").alias("parent_id"), F.concat(F.lit("c"), "id").alias("child_id"), F.lit("x").alias("label"),
        F.col("id").cast("int").alias("slot"), F.concat(F.lit("c"), "id").alias("fingerprint"), F.lit(False).alias("is_bad"))
    roots, _ = frames(spark, chain(1))
    row, = N.coarsen(N.walk(roots, edges)).collect()
    assert (row["node_id"], row["visited"], row["truncated"]) == ("a", 4096, True)


def test_neighbours_and_pairs(spark):
    big, low = 2**31 - 1, -2**31
    blocks = spark.createDataFrame([("w", 4, 64, -2), ("v", big, 64, low)], "world_id string, x int, y int, z int")
    near = N.neighbours(blocks).collect()
    assert len([r for r in near if r["world_id"] == "w"]) == 5
    assert {(r["x"], r["z"]) for r in near if r["world_id"] == "v"} == {(big, low), (big - 1, low), (big, low + 1)}

    kind = ("world_id string, x int, y int, z int, available boolean, present boolean, block_type string, persistent boolean, "
            "unresolved_loot boolean, other struct<world_id string, x int, y int, z int>, other_loaded boolean, has_inventory boolean")
    here, there = ("w", 1, 64, 0), ("w", 0, 64, 0)
    rows = [(*here, True, True, "chest", True, False, there, True, True), (*there, True, True, "chest", True, False, here, True, True),
            ("w", 9, 64, 0, True, True, "chest", True, False, ("v", 9, 64, 0), True, True),
            ("w", 7, 64, 0, True, False, "chest", True, False, None, True, True)]
    got = {(r["x"]): (r["status"], r["canonical_x"]) for r in N.resolve_pairs(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("RESOLVED", 0), 0: ("RESOLVED", 0), 9: ("UNAVAILABLE", None), 7: ("MISSING", None)}


def test_a_walk_for_a_budget_keeps_no_more_nodes_than_it(spark):
    edges = [("a", f"b{i:02}", "x", i, None, False) for i in range(30)]
    edges += [(f"b{i:02}", f"c{i:02}{j}", "x", j, None, False) for i in range(30) for j in range(9)]
    roots, edges = frames(spark, edges)
    whole, few = N.walk(roots, edges, 5), N.walk(roots, edges, 5, first=25)
    assert whole.count() == 301 and few.count() == 25
    for budget in (1, 7, 25):
        assert rows(N.coarsen(few, budget)) == rows(N.coarsen(whole, budget))


def test_a_walk_ends_where_no_node_is_open_and_carries_what_is_asked(spark, monkeypatch):
    written, scratch = [], N.scratch
    monkeypatch.setattr(N, "scratch", lambda frame, name: written.append(name) or scratch(frame, name))
    nodes = N.walk(*frames(spark, chain(2)), 8, extras=())
    assert nodes.columns == ["root_id", "node_id", "depth", "kind"] and nodes.count() == 3
    assert written.count("nested-level") == 3
