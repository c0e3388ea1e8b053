"""Plans and counts that keep large tables within their limits."""

import random

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from stowfind.plans import search as S
from stowfind.schema import Policy


def tree(frame) -> list[str]:
    return frame._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["v03_sparse_cosine", "p06_minimum_score", "g02_bm25_score"])
def test_copies_of_scores_for_questions_are_not_shuffled(spark, small, no_auto_broadcast, name):
    lines = tree(entry.queries()[name](spark, small))
    handed = next(i for i, line in enumerate(lines) if "Join [text_id" in line)
    assert not any("Exchange hashpartitioning" in line for line in lines[:handed]), "\n".join(lines[:handed])


def test_dots_are_summed_once_for_each_text(spark, small, no_auto_broadcast):
    lines = tree(entry.queries()["j08_sparse_dot"](spark, small))
    handed = next(i for i, line in enumerate(lines) if "Join [text_id" in line)
    summed = [i for i, line in enumerate(lines) if "Aggregate(keys=[text_id" in line]
    assert summed and min(summed) > handed and not any("Aggregate" in line for line in lines[:handed])


def crowd(spark):
    """Items of few descriptors in a small place, so that scores tie, and questions that share texts and windows."""
    rng = random.Random(5)
    spots = [(rng.randrange(-40, 60), rng.randrange(40, 120), rng.randrange(-40, 60)) for _ in range(500)]
    stock = spark.createDataFrame(
        [(i, i // 2, [("chest", rng.randrange(3))], rng.randrange(4), "m", rng.randrange(6), "w", *spots[i // 2])
         for i in range(1000)],
        "item_id long, container_id long, path array<struct<label string, slot int>>, amount int, material_key string, "
        "desc_id long, world_id string, x int, y int, z int")
    stock = stock.withColumns({"cell_x": F.expr("x >> 4"), "cell_z": F.expr("z >> 4")})
    cells = stock.select(*S.PLACES, (F.pmod(F.col("cell_x") + F.col("cell_z"), F.lit(5)) != 0).alias("available")).distinct()
    asked = spark.createDataFrame(
        [(q, q % 3, q % 4, "w", rng.randrange(-40, 60), rng.randrange(40, 120), rng.randrange(-40, 60)) for q in range(40)],
        "query_id long, player_id long, text_id long, world_id string, ox int, oy int, oz int")
    return stock, cells, asked


def test_full_text_cut_of_cells_is_that_of_all_pairs(spark):
    stock, cells, asked = crowd(spark)
    scores = spark.createDataFrame([(t, d, -float((t + d) % 3)) for t in range(4) for d in range(5)],
                                   "text_id long, desc_id long, score double")
    windows = S.open_windows(cells, asked, Policy())
    pairs = S.window_candidates(stock, cells, asked, Policy(), 40).join(scores, ["text_id", "desc_id"])
    columns = ["query_id", "item_id", "_cut", "score", "distance"]
    for limit in (1, 7, 200):
        got = S.full_text_window_cut(stock, windows, scores, limit).select(*columns).collect()
        want = S.full_text_cut(pairs, limit).select(*columns).collect()
        assert sorted(got) == sorted(want) and len(got) > 20


def test_semantic_hits_of_tiles_are_those_of_all_pairs(spark, monkeypatch):
    from stowfind.operators import near

    stock, cells, asked = crowd(spark)
    cosines = spark.createDataFrame([(t, d, ((t + d) % 3 + 1) / 4) for t in range(4) for d in range(5)],
                                    "text_id long, desc_id long, cosine double")
    decisions = spark.createDataFrame([(p, c, "DENY" if (p + c) % 4 == 0 else None if (p + c) % 9 == 0 else "ALLOW")
                                       for p in range(3) for c in range(500)], "player_id long, container_id long, decision string")
    pairs = S.window_candidates(stock, cells, asked, Policy(), 40).join(cosines, ["text_id", "desc_id"])
    columns = ["query_id", "item_id", "sem_rank", "cosine", "distance"]
    for limit, size in ((1, 1_000_000), (7, 50), (200, 1_000_000)):
        monkeypatch.setattr(near, "SLICE", size)
        policy = Policy(semantic_limit=limit)
        got = S.semantic_window_hits(stock, cells, asked, cosines, policy, decisions).select(*columns).collect()
        want = S.semantic_hits(pairs, policy, decisions).select(*columns).collect()
        assert sorted(got) == sorted(want) and len(got) > 20


@pytest.mark.parametrize("name", ["p02_exact_radius", "j04_grid_join"])
def test_places_far_above_a_question_are_not_paired(spark, small, name):
    assert any("Join" in line and "cell_y" in line for line in tree(entry.queries()[name](spark, small)))


def test_candidates_by_height_are_those_in_the_radius(spark):
    stock, cells, asked = crowd(spark)
    columns = ["query_id", "item_id", "distance"]
    got = S.radius_candidates(stock, cells, asked, Policy(), 40).select(*columns).collect()
    want = S.window_candidates(stock, cells, asked, Policy(), 40).filter("distance <= 32").select(*columns).collect()
    assert sorted(got) == sorted(want) and len(got) > 100


def test_parts_and_sides_that_do_not_fit_are_not_broadcast(spark, small):
    from stowfind.operators.joins import lookup_join
    from stowfind.sources.tables import Tables

    t = Tables(spark, small)
    for frame in (t.slim_items(), t.items()):
        joins = [line for line in tree(frame) if "Join" in line and "l_partkey" in line]
        assert joins and not any("Broadcast" in line for line in joins), joins
    few = spark.range(3)
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert not any("BroadcastHashJoin" in line for line in tree(lookup_join(spark.range(9), few, ["id"], how, fits=False)))


def test_items_of_the_index_are_not_joined_by_container_nor_in_a_fixed_number_of_tasks(spark, small):
    from stowfind.plans.index import SearchIndex
    from stowfind.sources.tables import Tables

    t = Tables(spark, small)
    lines = tree(t.index().items)
    assert not any("Join" in line and "container_id" in line for line in lines), "\n".join(lines)
    fixed = [line for line in tree(t.slim_items()) if "REPARTITION_BY_NUM" in line]
    assert not any("hashpartitioning" in line for line in fixed), fixed
    got = t.index().items
    want = SearchIndex.build(t.slim_items(), t.containers(), t.cells(), t.parts()).items
    assert got.columns == want.columns and got.count() == want.count() > 1000
    assert got.exceptAll(want).isEmpty()


def test_new_words_are_counted_once_for_each_text(spark, small, no_auto_broadcast, monkeypatch):
    from stowfind.catalog import upkeep
    from stowfind.sources.tables import saved_index

    monkeypatch.setattr(upkeep, "changed_index", saved_index)
    lines = tree(entry.queries()["s04_find_new_words"](spark, small))
    handed = next(i for i, line in enumerate(lines) if "Join [text_id" in line)
    assert not any("Aggregate" in line or "Join [desc_id" in line for line in lines[:handed]), "\n".join(lines[:handed])


def test_texts_asked_twice_are_scored_once(spark, monkeypatch):
    from stowfind.operators import bm25

    texts = spark.createDataFrame([(d, "the red fox" if d % 2 else "a theatre and the dog") for d in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, t) for q, t in enumerate(["the", "The!", "red fox", "", "the", "cat"])], "query_id long, query string")
    scored, plain = [], bm25.bm25

    def counted(*args, **kwargs):
        scored.append(plain(*args, **kwargs))
        return scored[-1]

    monkeypatch.setattr(bm25, "bm25", counted)
    got = bm25.rank_texts(texts, "doc_id", "text", asked, 3)
    rows = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got.collect()}
    assert sorted(rows) == [(q, r) for q in (0, 1, 2, 4) for r in (1, 2, 3)]
    assert all(rows[q, r] == rows[0, r] for q in (1, 4) for r in (1, 2, 3)) and [rows[2, r][0] for r in (1, 2, 3)] == [1, 3, 5]
    assert scored[0].select("query_id").distinct().count() == 2 and scored[0].count() == 40 + 20


def test_copies_are_counted_over_the_written_items(spark, small, tmp_path):
    from stowfind.plans.index import SearchIndex
    from stowfind.sources.tables import Tables

    t = Tables(spark, small)
    want = {r["desc_hash"]: r["copies"] for r in t.slim_items().groupBy("desc_hash").agg(F.count("*").alias("copies")).collect()}
    unread = t.slim_items().filter(F.raise_error(F.lit("items are made twice")).cast("boolean"))
    unused = t.parts().limit(1).select(F.lit("no item").alias("p_partkey"), "descriptor", F.lit("no item").alias("desc_hash"))
    parts = t.parts().withColumn("p_partkey", F.col("p_partkey").cast("string")).unionByName(unused)
    index = SearchIndex.build(unread, t.containers(), t.cells(), parts, placed_items=t.placed_items()).save(str(tmp_path / "index"))
    rows = spark.read.parquet(str(tmp_path / "index" / "descriptors")).select("desc_hash", "desc_id", "copies").collect()
    assert {r["desc_hash"]: r["copies"] for r in rows} == want and len(rows) == len({r["desc_id"] for r in rows}) == len(want)
    got = {r["desc_id"]: r["count"] for r in index.items.groupBy("desc_id").count().collect()}
    assert got == {r["desc_id"]: r["copies"] for r in rows}


def test_tie_keys_never_run_against_the_order_of_paths(spark):
    rng = random.Random(4)
    labels = [None, "", "a", "a\0", "a\0\0", "b", "abcdefgh", "abcdefgh\0", "abcdefghi", "abcdefgg", "é", "zz", "\U0001f600"]
    paths = [None, [], *[[(rng.choice(labels), rng.choice([None, -3, 0, 7, 40])) for _ in range(rng.randrange(1, 3))] for _ in range(300)]]
    frame = spark.createDataFrame([(p,) for p in paths], "path array<struct<label string, slot int>>")
    keys = [tuple(r) for r in frame.orderBy("path").select(*S.tie_keys(F.col("path"))).collect()]
    assert keys == sorted(keys) and len(set(keys)) > 40


def test_near_items_that_tie_are_cut_by_their_paths(spark, monkeypatch):
    stock = spark.createDataFrame(
        [(i, i, [("chest", i)], 1, "m", 0, "w", i % 20, 64, i // 20, (i % 20) >> 4, (i // 20) >> 4) for i in range(300)],
        "item_id long, container_id long, path array<struct<label string, slot int>>, amount int, material_key string, "
        "desc_id long, world_id string, x int, y int, z int, cell_x int, cell_z int")
    cells = stock.select(*S.PLACES, F.lit(True).alias("available")).distinct()
    asked = spark.createDataFrame([(1, 1, 1, "w", 5, 64, 5), (2, 1, 1, "w", 5, 200, 5)],
                                  "query_id long, player_id long, text_id long, world_id string, ox int, oy int, oz int")
    cosines = spark.createDataFrame([(1, 0, 0.5)], "text_id long, desc_id long, cosine double")
    written, plain = {}, S.scratch
    monkeypatch.setattr(S, "scratch", lambda df, name: written.setdefault(name, plain(df, name)))
    hits = S.semantic_window_hits(stock, cells, asked, cosines, Policy(semantic_limit=5), None)
    assert sorted((r["query_id"], r["item_id"], r["sem_rank"]) for r in hits.collect()) == [(1, i, i + 1) for i in range(5)]
    assert written["near-items"].count() == 5


def test_questions_of_a_search_are_written_once(spark, small):
    from stowfind.sources.tables import Tables

    usable, texts, _ = S.ask_once(Tables(spark, small).supplier_queries())
    assert all("stowfind-questions" in f for frame in (usable, texts) for f in frame.inputFiles())


def test_rows_that_stay_are_not_shuffled_by_a_change(spark, small, tmp_path, monkeypatch):
    from stowfind.catalog.upkeep import changes
    from stowfind.plans import upkeep
    from stowfind.sources.tables import Tables

    t = Tables(spark, small)
    index = t.index().save(str(tmp_path / "index"))
    replaced, items, deleted = changes(t)
    plans, plain = [], type(items).sortWithinPartitions
    monkeypatch.setattr(type(items), "sortWithinPartitions", lambda df, *by: plans.append(tree(df)) or plain(df, *by))
    for most in (256, 0):
        monkeypatch.setattr(upkeep, "FILES", most)
        plans.clear()
        upkeep.stage(index, str(tmp_path / "index"), str(tmp_path / f"staged-{most}"), replaced, items, deleted)
        assert len(plans) == 5
        for lines in plans:
            union = next(i for i, line in enumerate(lines) if "Union" in line)
            gathered = [i for i, line in enumerate(lines) if "REBALANCE" in line]
            assert gathered and (min(gathered) > union) == (most > 0), "\n".join(lines)
    staged = [spark.read.parquet(str(tmp_path / f"staged-{most}" / "items")) for most in (256, 0)]
    assert staged[0].count() == staged[1].count() > 1000
    same = [c for c in staged[0].columns if c != "desc_id"]
    assert staged[0].select(*same).exceptAll(staged[1].select(*same)).isEmpty()
