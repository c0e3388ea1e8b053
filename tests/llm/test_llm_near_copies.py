"""The pipeline's near-duplicate stage against all pairs."""

import functools
import pickle
import pickletools
import random

import numpy as np
import pytest

from stowfind.llm.decontamination import Lot
from stowfind.llm.near_copies import near_duplicates_dropped
from test_llm_operators import awkward


@functools.cache
def shingles(text):
    words = (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def varied(n_groups, seed):
    """Texts, each with copies in which a few words are replaced, of similarities around 0.8 and above."""
    draw = random.Random(seed)
    out = []
    for g in range(n_groups):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(120, 400))]
        out.append(" ".join(base))
        for _ in range(2):
            other = list(base)
            for at in draw.sample(range(len(other)), max(1, len(other) * draw.randrange(2, 22) // 1000)):
                other[at] = f"x{draw.randrange(10 ** 6)}"
            out.append(" ".join(other))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [16_384, 3])
def test_recall_and_precision_against_all_pairs(spark, hot):
    table = list(enumerate(varied(100, 3)))
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in near_duplicates_dropped(frame, hot=hot).collect()}
    near = [(i, j) for i, a in table for j, b in table[:i] if similarity(a, b) >= 0.8]
    close = [p for p in near if similarity(table[p[0]][1], table[p[1]][1]) < 0.9]
    assert len(close) > 60
    for pairs in (near, close):
        assert sum(i not in kept or j not in kept for i, j in pairs) / len(pairs) >= 0.9
    linked = {x for p in near for x in p}
    assert all(i in kept for i, _ in table if i not in linked)
    # Whatever went has a smaller id among the texts that links lead to.
    least = list(range(len(table)))
    for _ in table:
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    assert all(least[i] < i for i, _ in table if i not in kept)


def test_repeated_ids_keep_every_text(spark):
    a, b, c = varied(3, 5)[0], " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, b), (None, None), (4, None), (5, ""), (6, " \t\n"), (7, "a b"),
            (8, "a b"), (9, "a c")]
    for order in (rows, rows[::-1]):
        # Columns of the input bear names that are used inside.
        frame = spark.createDataFrame([(*r, 1, 2, "x") for r in order],
                                      "doc_id long, text string, th long, rank long, place string")
        got = near_duplicates_dropped(frame)
        assert got.columns == frame.columns
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(
            [(1, a), (2, b), (3, c), (None, b), (None, None), (4, None), (7, "a b"), (9, "a c")], key=repr)


def test_rows_that_repeat_an_id_and_a_text_leave_the_first_as_json(spark):
    frame = spark.createDataFrame([(1, "a b c", "y"), (1, "a b c", "x"), (1, "A b c", "w")],
                                  "doc_id long, text string, note string")
    got = near_duplicates_dropped(frame).collect()
    assert len(got) == 1 and got[0]["note"] in ("x", "w")
    assert {r["note"] for r in near_duplicates_dropped(frame.where("note <> 'w'")).collect()} == {"x"}


def test_nothing_and_a_very_long_text(spark):
    assert near_duplicates_dropped(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(str(i) for i in range(700_000))
    frame = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"] for r in near_duplicates_dropped(frame).collect()} == {1, 3}


def test_a_lot_travels_without_the_package():
    one = np.arange(3)
    lot = Lot([1], [one], [one], one, one, one, one, [(8, one)])
    names = [v for o, v, _ in pickletools.genops(pickle.dumps(lot.parts())) if isinstance(v, str)]
    assert not any("stowfind" in n for n in names)
    assert Lot(*lot.parts()).item_ids == [1]


def test_many_batches_without_a_pair(spark):
    draw = random.Random(9)
    table = [(i, " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(30))) for i in range(500)] + [(500, None)]
    frame = spark.createDataFrame([*table, (501, table[0][1] + " end")], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert {r["doc_id"] for r in near_duplicates_dropped(frame).collect()} == set(range(501))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_document_of_each_group_stays(spark):
    frame = spark.createDataFrame(awkward(), "doc_id long, text string")
    ids = [r["doc_id"] for r in near_duplicates_dropped(frame).collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and ids.count(None) == 2
    assert {1, 10, 11} <= set(named) and not {2, 7, 4} & set(named)


@pytest.mark.parametrize("hot", [16_384, 7])
def test_partners_that_are_not_the_nearest_are_linked(spark, monkeypatch, hot):
    from pyspark.sql import functions as F
    from stowfind.llm import near_copies

    plain = near_copies.fingerprints
    # All fingerprints are equal, so the nearest of a node tells nothing.
    monkeypatch.setattr(near_copies, "fingerprints", lambda *a: plain(*a).withColumns(
        {"hi": F.lit(0).cast("long"), "lo": F.lit(0).cast("long")}))
    table = list(enumerate(varied(12, 8)))
    kept = {r["doc_id"] for r in near_duplicates_dropped(
        spark.createDataFrame(table, "doc_id long, text string"), hot=hot).collect()}
    least = [i for i, _ in table]
    for _ in table:
        for i, a in table:
            for j, b in table[:i]:
                if similarity(a, b) >= 0.8:
                    least[i] = least[j] = min(least[i], least[j])
    assert len(kept) < 30 and kept == {i for i, _ in table if least[i] == i}


@pytest.mark.parametrize("hot, held", [(16_384, 1 << 22), (50, 1 << 22), (16_384, 4_000)])
def test_a_group_of_unlike_texts_in_one_block_makes_no_pairs(spark, monkeypatch, hot, held):
    from pyspark.sql import functions as F
    from stowfind.llm import near_copies

    plain, links, marks = near_copies.fingerprints, [], []
    monkeypatch.setattr(near_copies, "fingerprints", lambda *a: plain(*a).withColumns(
        {"hi": F.lit(0).cast("long"), "lo": F.lit(0).cast("long")}))
    near, join = near_copies.near_pairs, near_copies.joined

    def near_pairs(nodes, *rest):
        out = near(nodes, *rest)
        marks.extend([out.count()] if "root" in nodes.columns else [])
        return out

    def joined(*a):
        out = join(*a)
        links.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "near_pairs", near_pairs)
    monkeypatch.setattr(near_copies, "joined", joined)
    draw = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    # 200 texts of which each is too far from all others, and two that are near the first and the last.
    table = [(i, " ".join(base + [f"{i}-{draw.random()}" for _ in range(20)])) for i in range(200)]
    table += [(i + 200, f"{table[i][1]} end") for i in (0, 199)]
    got = near_copies.near_duplicates_dropped(spark.createDataFrame(table, "doc_id long, text string"), hot=hot, held=held)
    assert {r["doc_id"] for r in got.collect()} == set(range(200))
    # Their pairs are about 20,000.
    assert marks[0] <= len(table) and links[0] <= len(table)
