"""Packing of documents into sequences: shortest pack first over the length histogram.

1. Each document becomes ids and an end id, cut into full sequences and a remainder. A task numbers its pieces of each
   length as it goes, so the pieces are written once, with (shard, number).
2. The histogram of lengths, at most ``size`` numbers, goes to the driver. Lengths are placed longest first, each on the
   patterns that hold the fewest ids so far and can take it; a pattern's count is split where fewer pieces remain.
3. A piece's rank among its length is its shard's offset plus its number; ranges of ranks belong to slots of patterns,
   which gives sequence and offset by a join on (shard, length).

Cases: a null or empty text is the end id alone; a null id stays null; repeated rows are packed each; an empty table
gives no rows; columns other than the id and the text are ignored. Ties between equal lengths go by shard and number.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowfind.llm.bpe import load
from stowfind.llm.common import texts
from stowfind.session import scratch

PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long, shard int, nth long"
SEGMENTS = "shard int, length int, first long, last long, at long, sequence long, sequence_offset int"


def fill_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count) of patterns that hold every length as often as the histogram says."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    heap: list[int] = []

    def put(total: int, lengths: tuple[int, ...], count: int) -> None:
        if total not in open_packs or not open_packs[total]:
            heapq.heappush(heap, total)
        open_packs[total][lengths] += count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not open_packs[heap[0]]:
                heapq.heappop(heap)
            if not heap or heap[0] + length > size:
                # A new pattern is the shortest there is, so pieces of this length go on it until it is full.
                most = size // length
                for copies, count in ((most, left // most), (left % most, 1)):
                    if copies and count:
                        put(copies * length, (length,) * copies, count)
                break
            total = heap[0]
            lengths, count = next(iter(open_packs[total].items()))
            used = min(count, left)
            if used == count:
                del open_packs[total][lengths]
            else:
                open_packs[total][lengths] -= used
            put(total + length, (*lengths, length), used)
            left -= used
    return sorted((lengths, n) for packs in open_packs.values() for lengths, n in packs.items() if n)


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Rank ranges: pieces of ``length`` with ranks from ``rank`` on, ``count`` of them, fill sequences from
    ``sequence`` on at ``sequence_offset``."""
    rows, used, sequence = [], defaultdict(int), 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "rank", "count", "sequence", "sequence_offset"])


def cut(docs: DataFrame, vocabulary_name: str, end_id: int, size: int) -> DataFrame:
    """Pieces of all documents with their ids as little-endian unsigned 32-bit numbers."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard = load(vocabulary_name), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.append(bpe.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    part = ids[start:start + size]
                    rows.append((doc_id, start, len(part), part.tobytes(), len(ids), shard, seen[len(part)]))
                    seen[len(part)] += 1
            if rows:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()))]
                yield pa.record_batch(columns, PIECES.replace(",", "").split()[::2])

    return docs.mapInArrow(pieces, PIECES)


def segments(counts: DataFrame, slots: DataFrame) -> DataFrame:
    """Join rank ranges of shards to rank ranges of slots, length by length; a group has a row per shard."""

    def meet(shards: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        shards, places = shards.sort_values("shard"), places.sort_values("rank")
        ends = shards["count"].to_numpy().cumsum()
        begins = ends - shards["count"].to_numpy()
        edges = np.unique(np.concatenate([begins, places["rank"].to_numpy()]))
        edges = edges[edges < ends[-1]]
        stops = np.append(edges[1:], ends[-1])
        i = np.searchsorted(begins, edges, side="right") - 1
        j = np.searchsorted(places["rank"].to_numpy(), edges, side="right") - 1
        into = edges - places["rank"].to_numpy()[j]
        return pd.DataFrame({
            "shard": shards["shard"].to_numpy()[i], "length": shards["length"].to_numpy()[i],
            "first": edges - begins[i], "last": stops - begins[i] - 1, "at": edges - begins[i],
            "sequence": places["sequence"].to_numpy()[j] + into,
            "sequence_offset": places["sequence_offset"].to_numpy()[j]})

    return counts.groupBy("length").cogroup(slots.groupBy("length")).applyInPandas(meet, SEGMENTS)


def pack_documents(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json", end_id: int = 0, size: int = 1024,
                   id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) for each piece of each document."""
    spark = docs.sparkSession
    parts = scratch(cut(texts(docs, id_column, text), vocabulary_name, end_id, size), "pieces")
    counts = scratch(parts.groupBy("shard", "length").count(), "lengths")
    # At most ``size`` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = slots_of(fill_patterns(histogram, size))
    columns = "length int, rank long, count long, sequence long, sequence_offset int"
    # There are places for each shard, and shards grow with the input: both sides are dealt out at every size.
    places = scratch(segments(counts, spark.createDataFrame(slots, columns)), "segments").hint("merge")
    held = (parts["shard"] == places["shard"]) & (parts["length"] == places["length"]) & parts["nth"].between(
        places["first"], places["last"])
    return parts.join(places, held).select(
        "doc_id", "start", parts["length"].cast("long").alias("length"), "ids", "doc_tokens",
        (F.col("sequence") + F.col("nth") - F.col("at")).alias("sequence_id"),
        F.col("sequence_offset").cast("long").alias("offset"))
