"""Near copies of documents: wide SimHash fingerprints, permuted pigeonhole blocks, and a check of the shingles.

Texts are taken as sets of five-word shingles; texts of equal sets are one node. A node's fingerprint has 128 bits. Two
sets of Jaccard similarity s differ in a bit with the probability arccos(2s / (1 + s)) / pi, 0.15 at 0.8, so near copies
lie within ``reach`` bits. Fingerprints are split into blocks of bits, anew for each of some permutations, and those
that share a block meet in the task that holds it, where each names the nearest of those before it. A block is as wide
as leaves few chance meetings among the nodes there are; with its width the number of blocks follows from the share of
pairs at the least similarity that may be missed (``missed``). It grows as the number of nodes to the power 0.24.

The named pairs are verified by the Jaccard similarity of their whole shingle sets. Connected nodes are a group, of
which one row stays: the one of the smallest id, then of the smallest text hash.

A node's nearest may fail the check where another would pass. So nodes that meet one of another group in reach come
together once more, with their shingle sets, and all such pairs are verified where they meet. Only the links that join
groups leave the task, fewer than it has nodes, however many pairs there are.

A block that more than ``hot`` nodes share, or whose sets hold more than ``held`` shingles when they meet, is dealt to
chunks, and each two chunks meet in a group of their own, so no task holds more than two chunks. Nothing is left out.

Cases: a null or empty text, or one of white space only, has no shingles; all such rows are copies of each other and of
nothing else. A text of fewer words than a shingle is one shingle. Rows with a null id are all kept, as no id can stand
for them. Rows that repeat an id with different texts are different documents; of rows that repeat id and text one
stays, the one whose columns come first as JSON. An empty table gives no rows; other columns, whatever their names, are
passed through.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowfind.llm.common import components
from stowfind.session import scratch

UPPER = bytes(range(65, 91))
FOLD = bytes.maketrans(UPPER, UPPER.lower())
BITS = 128
AT_ONCE = 65_536
# Nodes that meet in a block by chance.
MEETING = 32
# Words of 64 bits of a set's bitmap.
WORDS = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles_of(text: str, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text."""
    import xxhash

    words = text.encode().translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    spoken = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    hashed = np.zeros(n, np.uint64)
    for i in range(width):
        hashed = mixed(hashed ^ spoken[i:i + n])
    return np.unique(hashed)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits as two signed numbers: those that are set in over half the hashes."""
    both = np.stack([shingles, mixed(shingles ^ np.uint64(0xA0761D6478BD642F))], axis=1)
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(both), AT_ONCE):
        # Eight bits' counts are added in one 64-bit number, which has room for 255 rows.
        lanes = np.unpackbits(both[low:low + AT_ONCE].view(np.uint8).reshape(-1, BITS // 8), axis=1).view(np.uint64)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    high, low = np.packbits(2 * ones > len(shingles)).view(np.int64).tolist()
    return high, low


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, shingle: int, id_column: str, text: str) -> DataFrame:
    """(doc_id, th, node, hi, lo, n) for each row with an id: text hash, hash of the shingle set, fingerprint, shingles."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch["text"]:
                found = shingles_of(x.as_py(), shingle)
                node = xxhash.xxh64_intdigest(found.tobytes())
                rows.append((node - (1 << 64) if node >> 63 else node, *fingerprint(found), len(found)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
            yield pa.record_batch([batch["doc_id"], batch["th"], *columns], ["doc_id", "th", "node", "hi", "lo", "n"])

    rows = docs.where(docs[id_column].isNotNull()).select(
        docs[id_column].cast("long").alias("doc_id"), text_hash(docs[text]).alias("th"),
        F.coalesce(docs[text], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, node long, hi long, lo long, n long")


def block_masks(nodes: int, similarity: float, missed: float) -> list[tuple[int, int]]:
    """Bits of the blocks, as masks of both numbers."""
    width = max(12, math.ceil(math.log2(max(1, nodes / MEETING))))
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    needed = math.ceil(math.log(missed) / math.log1p(-same ** width))
    draw, masks = np.random.default_rng(7), []
    while len(masks) < needed:
        order = draw.permutation(BITS)
        for low in range(0, BITS - width + 1, width):
            chosen = np.zeros(BITS, np.uint8)
            chosen[order[low:low + width]] = 1
            masks.append(tuple(np.packbits(chosen).view(np.int64).tolist()))
    return masks


def meetings(key, hi, lo) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a key, earlier and later, with the bits between them; rows are sorted by key."""
    n = len(key)
    active, lag = np.arange(n), 1
    while True:
        active = active[active + lag < n]
        active = active[key[active] == key[active + lag]]
        if not len(active):
            return
        later = active + lag
        yield active, later, (np.bitwise_count((hi[active] ^ hi[later]).view(np.uint64)).astype(np.int64)
                              + np.bitwise_count((lo[active] ^ lo[later]).view(np.uint64)))
        lag += 1


def nearest(key, node, hi, lo, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest earlier one of its key, if within ``reach`` bits; rows are sorted by key."""
    best, partner = np.full(len(key), reach + 1), np.zeros(len(key), dtype=np.int64)
    for active, later, apart in meetings(key, hi, lo):
        closer = apart < best[later]
        best[later[closer]], partner[later[closer]] = apart[closer], active[closer]
    found = np.flatnonzero(best <= reach)
    return node[partner[found]], node[found]


def strangers(key, node, hi, lo, root, n, at, masks: list[tuple[int, int]], reach: int,
              similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of all pairs of a key within ``reach`` bits that no links join yet and that their sizes let be similar.

    A pair of nodes counts only in the first block (``at``) that both share, so it is looked at once.
    """
    for active, later, apart in meetings(key, hi, lo):
        few, many = np.minimum(n[active], n[later]), np.maximum(n[active], n[later])
        open_ = (apart <= reach) & (root[active] != root[later]) & (few >= similarity * many)
        a, b = active[open_], later[open_]
        for i, (high, low) in enumerate(masks):
            if not len(a) or i >= at[a].max():
                break
            before = (at[a] > i) & (((hi[a] ^ hi[b]) & high) == 0) & (((lo[a] ^ lo[b]) & low) == 0)
            a, b = a[~before], b[~before]
        if len(a):
            yield a, b


def met(keyed: DataFrame, masks: list[tuple[int, int]], reach: int, hot: int, similarity: float) -> DataFrame:
    """(a, b, at, hot): pairs of near nodes of a key; or a key and a number of its rows, if it has more than ``hot``.

    Each node names the nearest before it. Where nodes have a ``root``, a and b are instead a block, whose number is
    ``at``, and a node of it that meets one of another root there.
    """
    named = ["key", "node", "hi", "lo"] + (["root", "n", "at", "block"] if "root" in keyed.columns else [])
    keyed = keyed.select(*named).repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, burning, at=None):
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                    pa.array(np.zeros(len(a)) if at is None else at, pa.int64()),
                                    pa.array([burning] * len(a), pa.bool_())], ["a", "b", "at", "hot"])

        held, over = [np.empty(0, np.int64)] * len(named), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                fresh = [batch[c].to_numpy(zero_copy_only=False) for c in named]
                held = [np.concatenate(x) for x in zip(held, fresh)]
            key = held[0]
            if not len(key):
                continue
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            large = sizes > hot
            large[0] |= over is not None and key[0] == over
            closed = len(key) if batch is None or large[-1] else starts[-1]
            over = key[-1] if large[-1] else None
            if large.any():
                yield out(key[starts[large]], sizes[large], True)
            take = np.repeat(~large & (sizes > 1), sizes)
            take[closed:] = False
            if take.any():
                taken = [x[take] for x in held]
                if "root" in named:
                    *plain, at, block = taken
                    marked = np.zeros(len(block), bool)
                    for pair in strangers(*plain, at, masks, reach, similarity):
                        marked[np.concatenate(pair)] = True
                    yield out(block[marked], plain[1][marked], False, at[marked])
                else:
                    yield out(*nearest(*taken, reach), False)
            held = [x[closed:] for x in held]

    return keyed.mapInArrow(run, "a long, b long, at long, hot boolean")


def dealt(rows: DataFrame, key: str, chunks: Column) -> DataFrame:
    """Rows of a key dealt to ``chunks`` chunks (``own``), each in one group (``key``) with each ``other`` chunk."""
    return (rows.withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)))
            .withColumn("key", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))))


def near_pairs(nodes: DataFrame, masks: list[tuple[int, int]], reach: int, hot: int, similarity: float) -> DataFrame:
    """(a, b, at): for each node the nearest before it in each of its blocks; of nodes with a root as ``met`` says."""
    rest = [c for c in ("root", "n") if "root" in nodes.columns]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("hi").bitwiseAND(F.lit(h)), F.col("lo").bitwiseAND(F.lit(m)))
                     for i, (h, m) in enumerate(masks)))
    keyed = nodes.select("node", "hi", "lo", *rest, F.posexplode(keys).alias("at", "key"))
    keyed = keyed.withColumns({"at": F.col("at").cast("long"), "block": F.col("key")})
    found = scratch(met(keyed, masks, reach, hot, similarity), "met-nodes")
    pairs = found.where("not hot").select("a", "b", "at")
    large = scratch(found.where("hot").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("size")), "hot-blocks")
    if not large.isEmpty():
        again = dealt(keyed.join(large, "key"), "block", F.ceil(F.col("size") / hot))
        # Two chunks have about twice ``hot`` rows; the bound only tells a chunk from a block.
        pairs = pairs.unionByName(met(again, masks, reach, 1 << 62, similarity).select("a", "b", "at"))
    return scratch(pairs.distinct(), "near-pairs")


def shingle_sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, id_column: str, text: str) -> DataFrame:
    """(node, shingles) of the nodes asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = shingles_of(batch["text"][i].as_py(), shingle)
                yield pa.record_batch([batch["node"].slice(i, 1), pa.array([found.view(np.int64)], pa.list_(pa.int64()))],
                                      ["node", "shingles"])

    chosen = nodes.join(asked, "node").select("node", "place.doc_id", "place.th")
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), text_hash(docs[text]).alias("th"),
                       F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.join(chosen.hint("merge"), ["doc_id", "th"]).select("node", "text")
    return scratch(rows.groupBy("node").agg(F.first("text").alias("text"))
                   .mapInArrow(run, "node long, shingles array<long>"), "shingle-sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int, id_column: str,
             text: str) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    sizes = nodes.select("node", "n")
    pairs = (pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
             .where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")))
    pairs = scratch(pairs, "sized-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = shingle_sets(asked, nodes, docs, shingle, id_column, text)
    both = (pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
            .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("shared")))
    return both.where(F.col("shared") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the bits that its shingles fall on."""
    out = np.zeros((len(sets), WORDS), np.uint64)
    for row, held in zip(out, sets):
        at = held.view(np.uint64) % np.uint64(WORDS * 64)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def joining(node, root, n, sets: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]],
            similarity: float) -> Iterator[tuple[int, int]]:
    """Those of the pairs that are similar enough and join groups that none before has joined.

    A bit of one set that is not among the other's stands for a shingle at least that they do not share, so most pairs
    that are not similar are told by their bitmaps; all others are by their whole sets.
    """
    group, bits = np.unique(root, return_inverse=True)[1], bitmaps(sets)
    for a, b in pairs:
        alone = [np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64) for x, y in ((a, b), (b, a))]
        most = np.minimum(n[a] - alone[0], n[b] - alone[1])
        able = most >= similarity * (n[a] + n[b] - most)
        for i, j in zip(a[able].tolist(), b[able].tolist()):
            if group[i] != group[j]:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= similarity * (n[i] + n[j] - shared):
                    group[group == group[j]] = group[i]
                    yield int(node[i]), int(node[j])


def joined(marked: DataFrame, nodes: DataFrame, sets: DataFrame, masks: list[tuple[int, int]], reach: int,
           similarity: float, held: int) -> DataFrame:
    """(a, b): verified pairs of the marked nodes (a block, b node, at) of each block, so many as join their groups."""

    def run(table: pa.Table) -> pa.Table:
        node, hi, lo, root, n, at, own, other = (
            table[c].to_numpy() for c in ("node", "hi", "lo", "root", "n", "at", "own", "other"))
        shingles = table["shingles"].combine_chunks()
        whole = [shingles[i].values.to_numpy() for i in range(len(shingles))]
        pairs = strangers(np.zeros(len(node), np.int64), node, hi, lo, root, n, at, masks, reach, similarity)
        if own[0] != other[0]:
            # The pairs of one chunk meet in the chunk's own group.
            pairs = ((a[own[a] != own[b]], b[own[a] != own[b]]) for a, b in pairs)
        links = list(joining(node, root, n, whole, pairs, similarity))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    rows = marked.select(F.col("a").alias("block"), F.col("b").alias("node"), "at").join(
        nodes.select("node", "hi", "lo", "root", "n"), "node")
    sizes = rows.groupBy("block").agg(F.ceil(F.sum("n") / held).alias("chunks"))
    rows = dealt(rows.join(sizes, "block"), "block", F.greatest("chunks", F.lit(1)))
    return rows.join(sets, "node").groupBy("key").applyInArrow(run, "a long, b long")


def near_duplicates_dropped(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, reach: int = 30,
                            missed: float = 0.05, hot: int = 16_384, id_column: str = "doc_id",
                            text: str = "text", held: int = 1 << 22) -> DataFrame:
    """The rows of ``docs``, one of each group of texts that are linked by a similarity of ``similarity`` or more."""
    rows = scratch(fingerprints(docs, shingle, id_column, text), "fingerprints")
    nodes = scratch(rows.groupBy("node").agg(
        F.min(F.struct("doc_id", "th")).alias("place"), F.min("hi").alias("hi"), F.min("lo").alias("lo"),
        F.min("n").alias("n")), "nodes")
    masks = block_masks(nodes.count(), similarity, missed)
    pairs = near_pairs(nodes, masks, reach, hot, similarity).select("a", "b").distinct()
    links = scratch(verified(pairs, nodes, docs, similarity, shingle, id_column, text), "links")
    roots = components(links)
    # A node's nearest may fail the check where another would pass; all that are not linked by now are verified.
    grouped = scratch(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "grouped")
    marked = near_pairs(grouped, masks, reach, hot, similarity)
    if not marked.isEmpty():
        sets = shingle_sets(marked.select(F.col("b").alias("node")).distinct(), nodes, docs, shingle, id_column, text)
        more = scratch(joined(marked, grouped, sets, masks, reach, similarity, held), "more-links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    kept = (nodes.select("node", "place").join(roots, "node", "left")
            .groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("place").alias("place"))
            .select("place.doc_id", "place.th"))
    often = rows.groupBy("doc_id", "th").agg((F.count("*") > 1).alias("often"))
    # Kept ids grow with the documents, so both sides are dealt out at every size.
    kept = scratch(kept.join(often, ["doc_id", "th"]), "kept")

    def held(of: DataFrame) -> DataFrame:
        of = of.hint("merge")
        return docs.join(of, (docs[id_column].cast("long") == of["doc_id"]) & (text_hash(docs[text]) == of["th"]),
                         "left_semi")

    out = held(kept.where("not often")).unionByName(docs.where(docs[id_column].isNull()))
    again = kept.where("often")
    if again.isEmpty():
        return out
    rank = "rank"
    while rank in docs.columns:
        rank += "_"
    rows = held(again)
    order = Window.partitionBy(rows[id_column], text_hash(rows[text])).orderBy(F.to_json(F.struct("*")))
    return out.unionByName(rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank))
