import random
import sqlite3

import re

import pytest
from helpers import containers, item, items
from pyspark.sql import functions as F

from stowfind.operators import access as A
from stowfind.operators.bm25 import Terms, bm25, corpus_stats, document_length, postings
from stowfind.plans.index import FIELDS, SearchIndex
from stowfind.plans.search import ask_once, full_text_scores, hybrid_search, sparse_scores
from stowfind.schema import Policy, Settings
from stowfind.sources.tables import Tables, saved_index


def fts_index():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(material, display, tags, enchantments, lore)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    return con


def test_bm25_equals_a_full_text_engine(spark):
    rng = random.Random(7)
    words = ["oak", "log", "logs", "stone", "plank", "planks", "gem", "diamond", "diadem", "iron"]
    fields = ["material", "display", "tags", "enchantments", "lore"]
    rows = [[" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in fields] for _ in range(200)]
    con = fts_index()
    con.executemany("insert into t(rowid, material, display, tags, enchantments, lore) values (?, ?, ?, ?, ?, ?)",
                    [(i, *r) for i, r in enumerate(rows)])
    asked = {1: ("oak log", '("oak") AND ("log"* OR "logs")'), 2: ("dia", '("dia"*)'),
             3: ("diamond oak oak", '("diamond" OR "gem" OR "gemstone" OR "precious") AND ("oak") AND ("oak"*)')}
    want = {}
    for query_id, (_, match) in asked.items():
        for rowid, score in con.execute("select rowid, bm25(t, 10, 8, 6, 5, 2) from t where t match ?", (match,)):
            want[query_id, rowid] = score

    docs = spark.createDataFrame([(i, *[f.split() for f in r]) for i, r in enumerate(rows)],
                                 "id long, " + ", ".join(f"{f} array<string>" for f in fields))
    terms = Terms.of(spark.createDataFrame([(k, v[0]) for k, v in asked.items()], "query_id long, query string"))
    stats = corpus_stats(docs, document_length(FIELDS), F.lit(1))
    post = postings(docs, ["id"], FIELDS)
    for small in (True, False):
        terms.small = small
        found = {(r["query_id"], r["id"]): r["score"] for r in bm25(
            post, stats, terms, ["id"]).collect()}
        assert found.keys() == want.keys() and len(want) > 20
        assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def world(spark, rows, places=None):
    """rows: (item_id, container_id, slot, amount, descriptor); containers sit at x = their id by default"""
    places = places or sorted({(r[1], "w", r[1], 64, 0) for r in rows})
    cells = spark.createDataFrame([("w", x, z, True) for x in range(-20, 40) for z in (-2, -1, 0, 1, 2)],
                                  "world_id string, cell_x int, cell_z int, available boolean")
    stock = items(spark, [(i, c, "chest", s, n, d) for i, c, s, n, d in rows])
    return SearchIndex.build(stock, containers(spark, places), cells)


def ask(spark, *texts):
    return spark.createDataFrame(
        [(i, 1, t, "w", 0, 64, 0) for i, t in enumerate(texts, 1)],
        "query_id long, player_id long, query string, world_id string, ox int, oy int, oz int")


GEM, ROCK = item("minecraft:diamond"), item("minecraft:granite")


def test_order_totals_and_access(spark):
    rows = [(i, x, 0, 1, GEM) for i, x in enumerate((-3, 1, 2, 5), 1)]
    decisions = spark.createDataFrame([(1, 2, "a", "ALLOW"), (1, 2, "b", "DENY"), (1, 1, "a", "NOT_APPLICABLE"), (1, 5, "a", None)],
                                      "player_id long, container_id long, provider string, decision string")
    found = hybrid_search(world(spark, rows), ask(spark, "diamond", "!!!", "quartz"), Policy(max_results=1), decisions)
    shown = found.roots.collect()
    assert [(r["container_id"], r["root_rank"], r["best_score"]) for r in shown] == [(-3, 1, 1.0)]
    status = {r["query_id"]: r for r in found.summary.collect()}
    assert (status[1]["status"], status[1]["total_roots"], status[1]["shown_roots"]) == ("SUCCESS", 2, 1)
    assert status[2]["status"] == "UNSUPPORTED_QUERY" and status[3]["status"] == "NO_MATCHES"


def test_caps_and_path_limit(spark):
    rows = [(i, 1, i, 1, GEM) for i in range(1, 6)] + [(9, 2, 0, 1, ROCK)]
    found = hybrid_search(world(spark, rows), ask(spark, "diamond"), Policy(max_paths_per_root=2, semantic_limit=1))
    assert sorted((r["item_id"], r["path_rank"]) for r in found.items.collect()) == [(1, 1), (2, 2)]
    top = found.roots.first()
    assert (top["total_stacks"], top["best_score"]) == (5, 1.0)


def test_window_keeps_world_radius_and_availability(spark):
    rows = [(i, i, 0, 1, GEM) for i in range(1, 6)]
    places = [(1, "w", 0, 64, 0), (2, "w", 256, 64, 0), (3, "v", 0, 64, 0), (4, "w", 30, 64, 30), (5, "w", -32, 64, 0)]
    index = world(spark, rows, places)
    found = hybrid_search(index, ask(spark, "diam"), Policy())
    assert {r["container_id"] for r in found.roots.collect()} == {1, 5}
    index.cells = index.cells.filter("cell_x <> 0").unionByName(index.cells.filter("cell_x = 0").withColumn("available", F.lit(False)))
    assert {r["container_id"] for r in hybrid_search(index, ask(spark, "diam"), Policy()).roots.collect()} == {5}


def test_zero_minimum_counts_items_without_shared_terms(spark):
    rows = [(1, 1, 0, 1, GEM), (2, 2, 0, 1, ROCK)]
    found = hybrid_search(world(spark, rows), ask(spark, "diamond"), Policy(min_score=0.0))
    assert {r["container_id"] for r in found.roots.collect()} == {1, 2}


def test_shuffled_lookup_gives_the_same(spark, monkeypatch):
    rows = [(i, i % 7, i, 1, (GEM, ROCK)[i % 2]) for i in range(1, 40)]
    index, questions = world(spark, rows), ask(spark, "diamond", "granite gra")
    want = sorted(map(tuple, hybrid_search(index, questions).items.select("query_id", "item_id", "score").collect()))
    build = Terms.of
    monkeypatch.setattr("stowfind.operators.joins.MAX_BYTES", 0)
    monkeypatch.setattr("stowfind.operators.joins.MAX_ROWS", 0)

    def never_small(*args):
        measured = build(*args)
        measured.small = False
        return measured

    monkeypatch.setattr(Terms, "of", never_small)
    assert sorted(map(tuple, hybrid_search(index, questions).items.select("query_id", "item_id", "score").collect())) == want


def test_dense_side(spark):
    index = world(spark, [(1, 1, 0, 1, GEM), (2, 2, 0, 1, ROCK)])
    hashes = {r["material_key"]: r["desc_id"] for r in index.items.select("material_key", "desc_id").collect()}
    vectors = spark.createDataFrame([(hashes["minecraft:diamond"], [1.0, 0.0]), (hashes["minecraft:granite"], [0.6, 0.8])],
                                    "desc_id string, vector array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, vector array<float>")
    found = hybrid_search(index, ask(spark, "zzz"), Policy(min_score=0.5), item_vectors=vectors, dense_queries=asked)
    assert [(r["container_id"], r["best_score"]) for r in found.roots.collect()] == [(2, 0.5)]


def test_saved_index_equals_lazy_index(spark, small):
    tables = Tables(spark, small)
    lazy = SearchIndex.build(tables.items(), tables.containers(), tables.cells())
    for index in (lazy, saved_index(tables)):
        found = hybrid_search(index, tables.queries(), Policy(), tables.decisions())
        rows = sorted(map(tuple, found.items.select("query_id", "item_id", "score", "root_rank", "path_rank").collect()))
        if index is lazy:
            want = rows
    assert rows == want and rows


def plan(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans(spark, small):
    from stowfind.plans.maintain import find_root

    tables = Tables(spark, small)
    found = hybrid_search(saved_index(tables), tables.supplier_queries(), Policy(), tables.decisions())
    text = plan(found.items)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "WindowGroupLimit" in text
    _, texts, terms = ask_once(tables.queries())
    assert terms.leads == ["b", "d", "g", "m", "p", "r", "s", "u", "w"] and terms.small and terms.shortest == 3
    index = saved_index(tables)
    for scores in (full_text_scores(index, terms), sparse_scores(terms.prune(index.vectors), texts)):
        text = plan(scores)
        assert "PartitionFilters: [lead" in text and "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text
    saved = index.items
    assert "PushedFilters: [IsNotNull(world_id)" in plan(find_root(saved, "O", 1, 64, 1))
    few = hybrid_search(index, tables.queries(), Policy(radius=16), tables.decisions())
    assert re.search(r"PartitionFilters: \[[^\n]*region_x[^\n]* IN ", plan(few.items))


def test_dense_scores_are_never_invented(spark):
    rows = [(1, 1, 0, 1, GEM), (2, 2, 0, 1, ROCK)]
    index = world(spark, rows)
    hashes = {r["material_key"]: r["desc_id"] for r in index.items.select("material_key", "desc_id").collect()}

    def found(vectors, asked):
        known = spark.createDataFrame([(hashes[k], v) for k, v in vectors], "desc_id string, vector array<double>")
        result = hybrid_search(index, ask(spark, "zzz"), Policy(min_score=0.0), item_vectors=known,
                               dense_queries=spark.createDataFrame([(1, asked)], "query_id long, vector array<double>"))
        return [r["container_id"] for r in result.roots.collect()], result.summary.first()["status"]

    gem, rock = "minecraft:diamond", "minecraft:granite"
    assert found([(gem, [1.0, 0.0]), (rock, [-1.0, 0.0])], [1.0, 0.0]) == ([1], "SUCCESS")
    assert found([(gem, [1.0, 0.0])], [1.0, 0.0]) == ([1], "SUCCESS")
    assert found([(gem, [1.0, 0.0])], [0.0, 0.0]) == ([], "UNSUPPORTED_QUERY")
    with pytest.raises(Exception, match="not finite"):
        found([(gem, [float("nan"), 0.0])], [1.0, 0.0])


def test_lookup_of_any_size_with_nested_columns(spark, monkeypatch):
    from stowfind.operators.joins import lookup_join
    from stowfind.plans.maintain import without

    big = spark.createDataFrame([(i % 3, {"a": i}, [i]) for i in range(9)], "k long, m map<string,int>, v array<int>")
    keys = spark.createDataFrame([(1, {"x": 1})], "k long, m2 map<string,int>")
    for limit in (1 << 20, 0):
        monkeypatch.setattr("stowfind.operators.joins.MAX_BYTES", limit)
        assert without(big, keys, ["k"]).count() == 6 and lookup_join(big, keys, ["k"]).count() == 3


def test_terms_are_measured_over_all_queries(spark, monkeypatch):
    queries = spark.createDataFrame([(i, f"word{i} x") for i in range(30)], "query_id long, query string")
    monkeypatch.setattr("stowfind.operators.bm25.MAX_ROWS", 5)
    terms = Terms.of(queries)
    assert not terms.small and terms.queries == 30 and terms.leads == ["w", "x"] and terms.shortest == 1


def test_pages_lose_no_tied_rows(spark):
    from stowfind.operators.ordered import page

    rows = spark.createDataFrame([(1, 1, w, i) for i, w in enumerate("abc")], "x int, z int, world_id string, id long")
    order, seen, after = ["x", "z", "world_id", "id"], [], None
    while got := page(rows, order, 1, after).collect()[:1]:
        seen += [r["id"] for r in got]
        after = tuple(got[0][c] for c in order)
    assert seen == [0, 1, 2]


def test_access_fails_closed_and_refresh(spark):
    hits = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13), (None, 13)], "player_id long, container_id long")
    decisions = spark.createDataFrame([(1, 10, "ALLOW"), (1, 10, "NOT_APPLICABLE"), (1, 11, "DENY"), (1, 12, None)],
                                      "player_id long, container_id long, decision string")
    assert {r["container_id"] for r in A.allowed(hits, decisions).collect()} == {10, 13}


@pytest.mark.parametrize("bad", [dict(radius=0), dict(radius=129), dict(min_score=1.1), dict(min_score=float("nan")),
                                 dict(max_results=257), dict(rrf_k=0), dict(full_text_limit=0), dict(semantic_limit=257),
                                 dict(max_paths_per_root=129)])
def test_policy_bounds(bad):
    with pytest.raises(ValueError):
        Policy(**bad)


@pytest.mark.parametrize("bad", [dict(max_depth=9), dict(max_stacks_per_root=16_385), dict(encoder=" "), dict(max_radius=16),
                                 dict(reconciliation_period_ticks=19), dict(roots_per_tick=129)])
def test_settings_bounds(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
