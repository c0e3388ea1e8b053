"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint has a bit for each bit that is set in over half the hashes of a text's word shingles. Equal fingerprints
become one node. The 64 bits are dealt to ``blocks`` blocks; two fingerprints that differ in at most ``distance`` bits
agree in at least ``blocks - distance`` of them, so each choice of that many blocks is a join key. Fingerprints that
share a key are compared in the task that holds the key, which sends on a spanning star of each linked set and never
its pairs.

A key with more than ``hot`` fingerprints is not compared pair by pair. Its fingerprints go on to hubs: each offers the
numbers within one bit and within ``distance - 1`` bits of itself. Two within ``distance`` bits share such a number, and
all that offer a number which one of them reaches by one bit are linked through that one, so the edges stay linear.

Cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other; a null id keeps
its row and never becomes a component's id unless all its ids are null, when it is null; repeated rows give a row each;
an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowfind.llm.common import components, texts
from stowfind.session import scratch

UPPER = bytes(range(65, 91))
FOLD = bytes.maketrans(UPPER, UPPER.lower())
SEED = 42
# Shingles whose bits are counted at once.
AT_ONCE = 65_536


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint as a signed number."""
    import xxhash

    words = text.encode().translate(FOLD).split()
    if not words:
        return 0
    rows = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    hashed = map(lambda x: xxhash.xxh64_intdigest(x, SEED), rows)
    n, ones = 0, np.zeros(64, dtype=np.int64)
    while len(part := np.fromiter(itertools.islice(hashed, AT_ONCE), dtype=np.uint64)):
        n += len(part)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), shingle) for x in batch["text"]], pa.int64())
            yield pa.record_batch([batch["doc_id"], fps], ["doc_id", "fp"])

    return texts(docs, id_column, text).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of the blocks that close fingerprints share, one for each choice of them."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(bounds)]
    return [sum(chosen) for chosen in itertools.combinations(single, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the sets that are linked within equal, sorted keys."""
    n = len(fp)
    parent, active, lag = np.arange(n), np.arange(n), 1
    while True:
        active = active[active + lag < n]
        active = active[key[active] == key[active + lag]]
        if not len(active):
            break
        differ = (fp[active] ^ fp[active + lag]).view(np.uint64)  # signed numbers would be counted by their size
        i = active[np.bitwise_count(differ) <= distance]
        j = i + lag
        while len(i):
            a, b = parent[i], parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
        lag += 1
    moved = np.flatnonzero(parent != np.arange(n))
    return fp[moved], fp[parent[moved]]


def block_edges(nodes: DataFrame, blocks: int, distance: int, hot: int) -> DataFrame:
    """Edges (a, b) between fingerprints of equal block keys; a = b marks a member of a hot key."""
    masks = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits"))
             for i, m in enumerate(block_masks(blocks, distance))]
    keyed = (nodes.select("fp", F.explode(F.array(*masks)).alias("k")).select("k.part", "k.bits", "fp")
             .repartition("part", "bits").sortWithinPartitions("part", "bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b):
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held = [np.empty(0, np.int64)] * 3
        burning = None  # the hot key whose rows are coming

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                fresh = [batch[c].to_numpy(zero_copy_only=False) for c in ("part", "bits", "fp")]
                part, bits, fp = (np.concatenate(x) for x in zip(held, fresh))
            else:
                part, bits, fp = held
            if not len(fp):
                continue
            new = np.append(True, (part[1:] != part[:-1]) | (bits[1:] != bits[:-1]))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(fp))
            sizes = ends - starts
            keys = np.cumsum(new)
            large = sizes > hot
            if burning is not None and (part[0], bits[0]) == burning:
                large[0] = True
            open_end = starts[-1] if batch is not None else len(fp)
            if large[-1] and batch is not None:
                burning, open_end = (part[-1], bits[-1]), len(fp)
            elif batch is not None:
                burning = None
            row_large = np.repeat(large, sizes)
            if row_large.any():
                yield out(fp[row_large], fp[row_large])
            take = ~row_large & np.repeat(sizes > 1, sizes)
            take[open_end:] = False
            if take.any():
                yield out(*linked(keys[take], fp[take], distance))
            held = [x[open_end:] for x in (part, bits, fp)]

    return keyed.mapInArrow(run, "a long, b long")


def hub_edges(nodes: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``distance`` bits, by shared numbers near them."""
    single = [1 << i for i in range(64)]
    near = [0, *single]
    far = near + [sum(c) for k in range(2, distance) for c in itertools.combinations(single, k)]

    def offers(masks):
        flips = F.array(*(F.lit(signed(m)) for m in masks))
        return nodes.select("fp", F.explode(flips).alias("flip")).select("fp", F.expr("fp ^ flip").alias("z"))

    through = offers(near).groupBy("z").agg(F.min("fp").alias("a"))
    return offers(far).join(through, "z").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def simhash_components(docs: DataFrame, distance: int = 3, shingle: int = 3, blocks: int = 6, hot: int = 2048,
                       id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest id reachable by fingerprints within ``distance`` bits."""
    rows = scratch(fingerprints(docs, shingle, id_column, text), "fingerprints")
    nodes = scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = scratch(block_edges(nodes.select("fp"), blocks, distance, hot), "block-edges")
    hot_nodes = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    edges = found.where("a <> b")
    if not hot_nodes.isEmpty():
        edges = edges.unionByName(hub_edges(scratch(hot_nodes, "hot-fingerprints"), distance))
    roots = components(edges).withColumnRenamed("node", "fp")
    least = nodes.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    place = (nodes.join(roots.join(least, "root"), "fp", "left")
             .select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return rows.join(scratch(place, "placed-fingerprints"), "fp").select("doc_id", "fp", "component_id")
