import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowfind.operators.dense import BatchEncoder, TransientError, dense_top_k
from stowfind.operators.ordered import neighbour, page, running_total
from stowfind.plans import history as H
from stowfind.plans import maintain as M
from stowfind.session import shared_folder
from stowfind.sources.store import TableStore
from stowfind.streaming import debounce as B
from stowfind.streaming import feed

CHANGES = "key long, tick long, seq long, kind string"


def bursts_by_hand(events):
    """Step through the changes of one key: claim at the end of the due tick."""
    done, work = [], None
    for n, (tick, kind) in enumerate(events, 1):
        if work is not None and tick > work[1]:
            done.append(work)
            work = None
        start, count = (tick, 0) if work is None else (work[0], work[4])
        due = min(tick + 5, start + 20) if kind == "transfer" else tick + 1
        work = (start, max(due, tick), n, "DELETE" if kind == "delete" else "SNAPSHOT", count + 1)
    return done + ([work] if work else [])


def run(spark, events, chunk=50):
    frame = spark.createDataFrame([(1, t, i, k) for i, (t, k) in enumerate(events)], CHANGES)
    rows = B.coalesce(frame, chunk).select("start_tick", "claim_tick", "revision", "action", "events").collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("events, want", [
    ([(100, "dirty")] * 10, [(100, 101, 10, "SNAPSHOT", 10)]),
    ([(1, "dirty"), (3, "delete"), (5, "dirty")], [(1, 2, 1, "SNAPSHOT", 1), (3, 4, 2, "DELETE", 1), (5, 6, 3, "SNAPSHOT", 1)]),
    ([(100, "transfer"), (101, "transfer")], [(100, 106, 2, "SNAPSHOT", 2)]),
    ([(100 + 4 * i, "transfer") for i in range(7)], [(100, 120, 6, "SNAPSHOT", 6), (124, 129, 7, "SNAPSHOT", 1)]),
])
def test_bursts(spark, events, want):
    assert run(spark, events) == want == bursts_by_hand(events)


def test_bursts_against_stepping(spark):
    rng = random.Random(3)
    keys = {}
    for key in range(12):
        tick, events = rng.randrange(30), []
        for _ in range(150):
            tick += rng.choice([0, 0, 1, 1, 2, 3, 4, 5, 6, 9] if key % 2 else [0, 1, 1, 1, 2])
            events.append((tick, rng.choice(["transfer"] * (4 + key) + ["dirty", "dirty", "delete"])))
        keys[key] = events
    seq = iter(range(10**6))
    frame = spark.createDataFrame([(k, t, next(seq), kind) for k, ev in keys.items() for t, kind in ev], CHANGES)
    got = {}
    for r in B.coalesce(frame.repartition(5), 17).collect():
        got.setdefault(r["key"], []).append((r["start_tick"], r["claim_tick"], r["revision"], r["action"], r["events"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: bursts_by_hand(v) for k, v in keys.items()}


def test_chunked_columns(spark):
    rng = random.Random(1)
    data = [(rng.randrange(3), rng.randrange(40), i) for i in range(200)]
    frame = spark.createDataFrame(data, "k long, t long, i long")
    chunk = F.floor(F.col("t") / 7)
    total = running_total(frame, ["k"], ["t", "i"], chunk, F.col("i"), "total")
    both = neighbour(total, ["k"], ["t", "i"], chunk, "i", "after", ahead=True)
    both = neighbour(both, ["k"], ["t", "i"], chunk, "i", "before", ahead=False).collect()
    for k in range(3):
        rows = sorted((t, i) for key, t, i in data if key == k)
        mine = sorted((r["t"], r["i"], r["total"], r["before"], r["after"]) for r in both if r["k"] == k)
        ids = [i for _, i in rows]
        assert mine == [(t, i, sum(ids[:n + 1]), ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None)
                        for n, (t, i) in enumerate(rows)]


def test_keyset_pages(spark):
    places = spark.createDataFrame([(0, 64, 0), (0, 65, 0), (1, 64, 0)], "x int, y int, z int")
    first = page(places, ["x", "y", "z"], 2).collect()
    assert [tuple(r) for r in first] == [(0, 64, 0), (0, 65, 0), (1, 64, 0)]
    assert [tuple(r) for r in page(places, ["x", "y", "z"], 2, (0, 65, 0)).collect()] == [(1, 64, 0)]


def test_store_versions(spark):
    store = TableStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    assert store.current() is None
    with pytest.raises(LookupError):
        store.read("t")
    assert store.write({"t": spark.range(3)}) == 1
    assert store.write({"t": store.read("t").filter("id > 0")}) == 2
    assert store.write({"t": spark.range(1)}, version=2) == 2
    assert store.read("t").count() == 1 and store.read("t", 1).count() == 3


def test_history(spark):
    rows = [("a", 1, "diamond", 1_704_067_200_000, 3), ("b", 2, "emerald", 1_717_200_000_000, 5)]
    table = spark.createDataFrame(rows, "id string, player_id long, query string, ts_ms long, result_count int")
    assert [r["query"] for r in H.latest_overall(table, 2).collect()] == ["emerald", "diamond"]
    now = 1_717_200_000_000 + 30 * H.DAY_MS
    assert [r["id"] for r in H.prune(table, now, 30).collect()] == ["b"]
    assert [r["id"] for r in H.clear_player(table, 1).collect()] == ["b"]
    radii = spark.createDataFrame([(1, 16, 1)], "player_id long, radius int, updated_at long")
    newer = spark.createDataFrame([(1, 40, 2)], "player_id long, radius int, updated_at long")
    merged = H.set_radius(radii, newer)
    players = spark.createDataFrame([(1,), (2,)], "player_id long")
    assert {tuple(r) for r in H.effective_radius(players, merged, 32).collect()} == {(1, 40), (2, 32)}
    with pytest.raises(Exception, match="1..128"):
        H.set_radius(radii, newer.withColumn("radius", F.lit(129))).collect()


def test_cells_take_the_last_arrival(spark):
    kind = "world_id string, cell_x int, cell_z int, available boolean, revision long"
    old = spark.createDataFrame([("w", 0, 0, True, 9), ("w", 1, 0, True, 9)], kind)
    new = spark.createDataFrame([("w", 0, 0, True, 8, 1), ("w", 0, 0, False, 2, 2)], kind + ", seq long")
    assert {tuple(r) for r in M.set_cells(old, new).collect()} == {("w", 0, 0, False, 2), ("w", 1, 0, True, 9)}


def encoder(calls, **options):
    def encode(texts):
        calls.append(len(texts))
        return np.ones((len(texts), 2))

    return BatchEncoder("test", 1, encode, 2, **options)


def test_encoder_batches_retries_and_checks():
    calls = []
    sizes = [len(g) for g in encoder(calls, max_inputs=3, max_bytes=10)._groups(["a"] * 7 + ["b" * 9, "c" * 20])]
    assert sizes == [3, 3, 2, 1]
    attempts = []

    def flaky(texts):
        attempts.append(1)
        if len(attempts) < 3:
            raise TransientError
        return np.ones((len(texts), 2))

    assert BatchEncoder("test", 1, flaky, 2)._call(["x"]).shape == (1, 2) and len(attempts) == 3
    for bad in (np.zeros((1, 2)), np.ones((1, 3)), np.array([[np.nan, 1.0]])):
        with pytest.raises(ValueError):
            BatchEncoder("test", 1, lambda texts, m=bad: m, 2)._call(["x"])
    assert BatchEncoder("t", 1, None, 2, settings="a").provider_id != BatchEncoder("t", 1, None, 2, settings="b").provider_id
    with pytest.raises(ValueError):
        BatchEncoder(" ", 1, None, 2)


def test_dense_blocks_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    asked = table.filter("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, dense_top_k(table, asked, 3).collect()))
    monkeypatch.setattr("stowfind.operators.dense.QUERY_BLOCK", 2)
    assert sorted(map(tuple, dense_top_k(table, asked, 3).collect())) == want and len(want) == 27


def test_clicks_and_drags(spark):
    kind = "event string, source_id long, target_id long, raw_slot int, top_size int, action string, raw_slots array<int>, seq long, tick long"
    rows = [("click", 1, None, 3, 27, "PICKUP_ALL", None), ("click", 2, None, 3, 27, "NOTHING", None),
            ("click", 3, None, 30, 27, "MOVE_TO_OTHER_INVENTORY", None), ("click", 4, None, 30, 27, "PICKUP_ALL", None),
            ("drag", 5, None, None, 27, None, [30, 26]), ("drag", 6, None, None, 27, None, [27]), ("drag", 7, None, None, 27, None, []),
            ("move", 8, 9, None, None, None, None), ("explode", 10, None, None, None, None, None), ("look", 11, None, None, None, None, None)]
    events = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], kind)
    got = {(r["key"], r["kind"]) for r in feed.changes(events).collect()}
    assert got == {(1, "dirty"), (3, "dirty"), (5, "dirty"), (8, "transfer"), (9, "transfer"), (10, "delete")}


def test_dense_top_k_over_blocks_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)] + [(200, [0.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))

    def cosine(a, b):
        norm = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
        return round(float(np.clip(np.dot(a, b) / norm, -1, 1)), 12) if norm else 0.0

    want = []
    for q, a in rows:
        if q % 10 == 0:
            best = sorted((-cosine(a, b), i) for i, b in rows)[:7]
            want += [(q, i, s) for s, i in best if -s >= 0.5]
    monkeypatch.setattr("stowfind.operators.dense.QUERY_BLOCK", 5)
    monkeypatch.setattr("stowfind.operators.dense.VECTOR_SLICE", 40)
    monkeypatch.setattr("stowfind.operators.dense.QUERIES_AT_ONCE", 2)
    got = dense_top_k(table, asked, 7, min_score=0.5)
    assert sorted((r["query_id"], r["vec_id"]) for r in got.collect()) == sorted((q, i) for q, i, _ in want)
    assert dense_top_k(table.limit(0), asked, 7).count() == dense_top_k(table, asked.limit(0), 7).count() == 0
    with pytest.raises(Exception, match="dimension"):
        dense_top_k(table.unionByName(spark.createDataFrame([(999, [1.0])], table.schema)), asked, 2).collect()


def test_a_dense_block_holds_few_scores_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from stowfind.operators.dense import best_of

    def table(n, key, vector):
        values = np.random.default_rng(n).standard_normal(n * 8)
        return pa.table({key: np.arange(n), vector: pa.FixedSizeListArray.from_arrays(pa.array(values), 8).cast(pa.list_(pa.float64()))})

    found, asked = table(8_192, "id", "v"), table(512, "query_id", "q")
    tracemalloc.start()
    ids, near, _ = best_of(found, asked, 3, -1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == len(near) == 3 * 512 and peak < 16e6, peak
