"""Near-duplicate vectors by a pivot-permutation index.

Reference points are drawn from a bounded sample and thinned so that no two are close. A vector is described by its
``top`` nearest reference points in order. The inverted list of a pair of reference points holds the vectors that have
both among theirs, so two vectors meet in a list exactly if they share at least two; lists of single points would be
longer without more links. Inside a list, cosines are computed in blocks, in double precision. A pair that meets in
several lists counts in the one of its two smallest shared points, so no pair is counted twice and none needs to be
shuffled: a list sends on each vector's number of links and a spanning star of each linked set.

Equal vectors are one class and are expanded at the end. A list of more than ``block`` vectors is dealt to blocks whose
pairs are separate groups, so no task holds more than two blocks. The index holds every vector; links between vectors
that share fewer than two of their nearest points are not found (recall is measured in the tests).

Cases: null, empty or zero vectors, and those with null or non-finite components, link with nothing, nor do vectors of
different lengths; a null id keeps its row; repeated rows are vectors of their own that link with each other; an empty
table gives no rows; other columns are ignored. Equal distances to reference points go by the points' order.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowfind.llm.common import components
from stowfind.session import scratch

# Hot lists whose numbers may be broadcast; a row is four numbers.
SMALL_ROWS = 200_000


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of vectors that all have ``dim`` components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def reference_points(classes: DataFrame, sample: int, points: int, apart: float) -> dict[int, np.ndarray]:
    """For each vector length, unit vectors of a sample, none within cosine ``apart`` of an earlier one."""
    # At most ``sample`` vectors come to the driver.
    drawn = (classes.orderBy(F.xxhash64("embedding"), "cid").limit(sample).select("dim", "embedding").toArrow())
    out = {}
    for dim in sorted(set(drawn["dim"].to_pylist())):
        rows = drawn.filter(pa.compute.equal(drawn["dim"], dim))["embedding"].combine_chunks()
        unit = matrix(rows, dim)
        free, kept = np.ones(len(unit), dtype=bool), []
        for i in range(len(unit)):
            if free[i] and len(kept) < points:
                kept.append(i)
                free &= unit @ unit[i] < apart
        out[dim] = unit[kept]
    return out


def describe(classes: DataFrame, points: dict[int, np.ndarray], top: int) -> DataFrame:
    """Adds ``nearest``: the numbers of the nearest reference points of each class, nearest first."""
    columns = ["cid", "copies", "dim", "embedding"]
    kind = classes.schema["embedding"].dataType.simpleString()
    shared = classes.sparkSession.sparkContext.broadcast(points)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                refs = shared.value.get(int(dim))
                if refs is None:  # no vector of this length is in the sample: one list for all
                    near = np.zeros((part.num_rows, 1), dtype=np.int32)
                else:
                    near = np.argsort(-(matrix(part["embedding"], int(dim)) @ refs.T), axis=1, kind="stable")
                    near = near[:, :top].astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(near.ravel(), near.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.record_batch([*(part[c] for c in columns), lists], [*columns, "nearest"])

    return classes.select(*columns).mapInArrow(
        run, f"cid long, copies long, dim int, embedding {kind}, nearest array<int>")


def links_of(unit: np.ndarray, near: np.ndarray, copies: np.ndarray, side: np.ndarray, key: tuple[int, int],
             cosine: float, step: int = 512):
    """Links found first in this list: each row's number of linked vectors, and each row's root within the list."""
    n = len(unit)
    counts, parent = np.zeros(n, dtype=np.int64), np.arange(n)
    for a in range(0, n, step):
        i, j = np.nonzero(unit[a:a + step] @ unit[a:].T >= cosine)
        i, j = i + a, j + a
        # Between blocks only pairs across; within one block all.
        use = (i < j) & ((side[i] != side[j]) | (side[i] == 2))
        i, j = i[use], j[use]
        if near.shape[1] > 1 and len(i):
            first = np.ones(len(i), dtype=bool)
            for b in range(0, len(i), 100_000):
                x, y = near[i[b:b + 100_000]], near[j[b:b + 100_000]]
                common = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int32).max)
                two = np.sort(common, axis=1)[:, :2]
                first[b:b + 100_000] = (two[:, 0] == key[0]) & (two[:, 1] == key[1])
            i, j = i[first], j[first]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        while len(i):
            p, q = parent[i], parent[j]
            apart = p != q
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
    return counts, parent


def list_links(index: DataFrame, cosine: float, block: int) -> DataFrame:
    """(a, b, n): a's number n of linked vectors where a = b, else an edge."""
    nearest = F.array_sort("nearest")
    one = F.array(F.struct(F.col("nearest")[0].alias("p"), F.col("nearest")[0].alias("q")))
    pairs = F.flatten(F.transform(nearest, lambda p: F.transform(
        F.filter(nearest, lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    keys = index.select("cid", "copies", "dim", "embedding", "nearest",
                        F.explode(F.when(F.size("nearest") > 1, pairs).otherwise(one)).alias("k"))
    keys = keys.select("*", "k.p", "k.q").drop("k")
    hot = (keys.groupBy("dim", "p", "q").count().where(F.col("count") > block)
           .select(F.col("dim").alias("d_"), F.col("p").alias("p_"), F.col("q").alias("q_"),
                   F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    hot = scratch(hot, "hot-lists")
    small = hot.count() <= SMALL_ROWS
    hot = F.broadcast(hot) if small else hot
    keys = keys.join(hot, (F.col("dim") == F.col("d_")) & (F.col("p") == F.col("p_")) & (F.col("q") == F.col("q_")),
                     "left")
    own = F.coalesce(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"), F.lit(0))
    keys = keys.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    keys = keys.select("dim", "p", "q", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                       "own", "cid", "copies", "embedding", "nearest")
    group = ["dim", "p", "q", "low", "high"]
    sorted_keys = keys.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else pa.Table.from_batches([batch])
            if batch is not None and held is not None:
                rows = pa.concat_tables([held, rows])
            if rows is None or not rows.num_rows:
                continue
            rows = rows.combine_chunks()
            marks = np.stack([rows[c].to_numpy() for c in group])
            starts = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)))
            ends = np.append(starts[1:], rows.num_rows)
            held = None
            if batch is not None:
                held = rows.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            cid, copies, own = (rows[c].to_numpy() for c in ("cid", "copies", "own"))
            out = []
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                dim, p, q, low, high = (int(x) for x in marks[:, s])
                part = rows.slice(s, e - s)
                unit = matrix(part["embedding"].combine_chunks(), dim)
                near = np.array(part["nearest"].to_pylist(), dtype=np.int32)
                side = np.full(e - s, 2) if low == high else (own[s:e] == high).astype(int)
                counts, root = links_of(unit, near, copies[s:e], side, (p, q), cosine)
                ids, linked = cid[s:e], np.flatnonzero(counts)
                moved = np.flatnonzero(root != np.arange(e - s))
                out += [np.stack([ids[linked], ids[linked], counts[linked]]),
                        np.stack([ids[root[moved]], ids[moved], np.zeros(len(moved), dtype=np.int64)])]
            if out:
                a, b, n = np.concatenate(out, axis=1)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    return sorted_keys.mapInArrow(run, "a long, b long, n long")


def vector_links(vectors: DataFrame, cosine: float = 0.95, sample: int = 2048, points: int = 1024, top: int = 8,
                 apart: float = 0.7, block: int = 2048, id_column: str = "vec_id",
                 vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    v = F.col("embedding")
    usable = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    rows = rows.withColumn("embedding", F.when(usable, v))
    classes = scratch(
        rows.where("embedding is not null").groupBy("embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("cid"), "least", "copies",
                F.size("embedding").alias("dim"), "embedding"), "vector-classes")
    index = scratch(describe(classes, reference_points(classes, sample, points, apart), top), "described-vectors")
    found = scratch(list_links(index, cosine, block), "vector-links")
    roots = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    placed = classes.select("cid", "least", "copies", "embedding").join(
        roots.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    placed = scratch(placed.withColumn("root", F.coalesce("root", "cid")), "placed-vectors")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root").select(
        F.col("embedding").alias("__v"), "component_id",
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.join(scratch(placed, "linked-vectors"), rows["embedding"] == F.col("__v"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("__v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
                      .alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
