"""Removal of repeated substrings by suffix arrays.

A string of ``width`` bytes is removed wherever it also starts in a document with a smaller id. Its strings of ``GRAM``
bytes include one of least hash, its anchor; equal strings have equal anchors, so strings meet by their anchors.

1. Documents are packed into shards of some megabytes, with the places of their anchors, in a table.
2. Each shard deals the hashes of its anchors to buckets; a bucket tells which hashes other shards have too.
3. For each anchor that repeats, a shard sends its context, the bytes of all strings that belong to the anchor, once for
   each different context, with the smallest id that has it. So a hot passage is sent once by a shard, not by a document.
4. In a bucket, contexts that differ but have the same anchor may share some strings. They are dealt to lots; each lot
   has a suffix array, refined by doubling in numpy after Larsson and Sadakane, and common prefixes after Kasai.
   Neighbours with ``width`` bytes in common are one string. The sorted strings of all lots are merged by binary search
   to find the smallest id that has each.
5. The answers go back to the shards, where the strings are marked and the bytes that they cover are removed.

Cases: a null or empty text has 0 bytes and no spans, and the digest of nothing; a null id is not compared and is in no
one's way; documents that repeat an id are compared with smaller ids only; an empty table gives no rows; columns other
than the id and the text are ignored. A document of any length is in one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowfind.llm.common import texts
from stowfind.session import scratch

GRAM = 16
# Bytes of text of a shard, of text for each bucket, and of contexts that a suffix array is built over.
SHARD_BYTES, BUCKET_BYTES, LOT_BYTES = 4 << 20, 4 << 20, 1 << 20
MOST_BUCKETS = 20_000
# Bytes of bits about anchors that may be broadcast.
SMALL_BYTES = 32 << 20
NEVER = np.iinfo(np.int64).max

SHARDS = "shard long, docs binary, sizes binary, starts binary, anchors binary, reach binary, text binary, n_text long"


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[:len(x) - (width - step)], x[width - step:]) if step < width else x


def words_at(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each place on as one number; places past the end read zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
    return np.ascontiguousarray(view).view(kind).ravel()


def gram_hashes(words: np.ndarray, places: np.ndarray | slice, later: np.ndarray | slice) -> np.ndarray:
    """Hashes of the GRAM bytes at places, from the eight-byte words there and eight bytes later."""
    h = np.zeros(1, np.uint64)
    for at in (places, later):
        h = (h ^ words[at]) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h


def anchors_of(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: their places, and how far before them their first and last strings start."""
    span = width - GRAM + 1
    if len(data) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    n = len(data) - GRAM + 1
    words = words_at(data, "<u8")
    h = gram_hashes(words, slice(0, n), slice(8, n + 8) if n + 8 <= len(words) else slice(8, None))
    least = sliding(h, span, np.minimum)  # for each string, the hash of its anchor
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), span, np.maximum) == h)
    own = h[at]
    first, last = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    for back in range(span):
        start = at - back
        mine = (start >= 0) & (start < len(least))
        mine[mine] = least[start[mine]] == own[mine]
        first[mine] = back
        last[mine & (last < 0)] = back
    return at, first, last


def pack(data: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def shards_of(docs: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """A row for each shard: ids, byte lengths, null flags, anchors and compressed text of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close():
            nonlocal held, size, number
            found = [anchors_of(np.frombuffer(t, np.uint8), width) if d is not None else anchors_of(
                np.zeros(0, np.uint8), width) for d, t in held]
            ids = np.array([NEVER if d is None else d for d, _ in held], np.int64)
            known = np.array([d is not None for d, _ in held], np.int64)
            row = (number, pack(np.stack([ids, known])), pack(np.array([len(t) for _, t in held], np.int64)),
                   pack(np.array([len(a) for a, _, _ in found], np.int64)),
                   pack(np.concatenate([np.diff(a, prepend=0) for a, _, _ in found]).astype("<u4")),
                   pack(np.concatenate([np.stack([f, b]) for _, f, b in found], axis=1).astype(np.uint8)),
                   pack(np.frombuffer(b"".join(t for _, t in held), np.uint8)), size)
            held, size, number = [], 0, number + 1
            return batch_of(SHARDS, [row])

        for batch in batches:
            for d, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                data = t.as_py().encode("utf-8", "surrogatepass")
                if held and size + len(data) > shard_bytes:
                    yield close()
                held.append((d, data))
                size += len(data)
        if held:
            yield close()

    return docs.mapInArrow(run, SHARDS)


class Shard:
    """A shard in a task: its text, and its anchors in the order of their buckets and hashes."""

    def __init__(self, row: dict, buckets: int):
        self.docs, known = unpack(row["docs"], "<i8").reshape(2, -1)
        self.known = known.astype(bool)
        self.sizes, counts = unpack(row["sizes"], "<i8"), unpack(row["starts"], "<i8")
        self.text = unpack(row["text"], np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes
        steps = unpack(row["anchors"], "<u4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        total = np.append(0, np.cumsum(steps))
        before = total[np.cumsum(counts) - counts]
        self.at = total[1:] - np.repeat(before, counts) + self.begins[self.doc]
        self.first, self.last = unpack(row["reach"], np.uint8).reshape(2, -1).astype(np.int64)
        padded = np.concatenate([self.text, np.zeros(16, np.uint8)])
        grams = np.lib.stride_tricks.as_strided(padded, (len(self.text), 16), (1, 1))
        near = grams[self.at].view("<u8") if len(self.at) else np.zeros((0, 2), "<u8")
        self.hash = gram_hashes(near.T, 0, 1)
        self.bucket = (self.hash >> np.uint64(20)) % np.uint64(buckets)
        self.order = np.lexsort((self.hash, self.bucket))
        h = self.hash[self.order]
        new = np.append(True, h[1:] != h[:-1])[:len(h)]
        self.unique = np.flatnonzero(new)  # the first of each hash, in order
        self.group = np.cumsum(new) - 1
        self.unique_hash = h[self.unique]
        self.unique_bucket = self.bucket[self.order][self.unique].astype(np.int64)
        self.cuts = np.searchsorted(self.unique_bucket, np.arange(buckets + 1))

    def repeated(self, answers: list[dict]) -> np.ndarray:
        """Anchors, in order, whose hash another shard has or two ids of this one."""
        there = np.zeros(len(self.unique), dtype=bool)
        for a in answers:
            low, high = self.cuts[a["bucket"]], self.cuts[a["bucket"] + 1]
            there[low:high] = np.unpackbits(np.frombuffer(a["seen"], np.uint8), count=high - low).astype(bool)
        if len(self.order):
            ids = self.docs[self.doc[self.order]]
            there |= np.maximum.reduceat(ids, self.unique) != np.minimum.reduceat(ids, self.unique)
        return self.order[there[self.group]] if len(self.order) else self.order

    def contexts(self, answers: list[dict], width: int):
        """Different contexts of repeated anchors, with bucket, smallest id and place of the anchor, and for each
        occurrence its context, start, strings and document."""
        use = self.repeated(answers)
        starts, n = self.at[use] - self.first[use], self.first[use] - self.last[use] + 1
        text, known = self.text.tobytes(), {}
        which = np.fromiter((known.setdefault(text[s:e], len(known)) for s, e in zip(
            starts.tolist(), (starts + n - 1 + width).tolist())), np.int64, len(use))
        bucket = np.zeros(len(known), np.int64)
        bucket[which] = self.bucket[use]
        offset = np.zeros(len(known), np.uint8)
        offset[which] = self.first[use]
        least = np.full(len(known), NEVER)
        np.minimum.at(least, which, self.docs[self.doc[use]])
        return list(known), bucket, least, offset, which, starts, n, self.doc[use]


def seen_elsewhere(shards: DataFrame, buckets: int) -> DataFrame:
    """(shard, bucket, seen): a bit for each hash of the shard in the bucket, set if another shard has the hash."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row, buckets)
                yield batch_of("bucket int, shard long, hashes binary", [
                    (b, row["shard"], s.unique_hash[s.cuts[b]:s.cuts[b + 1]].tobytes())
                    for b in np.unique(s.unique_bucket).tolist()])

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in group["hashes"].to_pylist()]
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        twice = values[n > 1]
        rows = []
        for shard, part in zip(group["shard"].to_pylist(), parts):
            at = np.searchsorted(twice, part)
            seen = (at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == part) if len(twice) else part != part
            rows.append((shard, key[0].as_py(), np.packbits(seen).tobytes()))
        return pa.Table.from_batches([batch_of("shard long, bucket int, seen binary", rows)])

    columns = ["shard", "docs", "sizes", "starts", "anchors", "reach", "text"]
    dealt = shards.select(*columns).mapInArrow(deal, "bucket int, shard long, hashes binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "shard long, bucket int, seen binary")


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and the rank of each place.

    Suffixes are sorted by eight bytes, then groups that are still equal by the rank of what follows, over twice the
    length each round; a group of one is done and is not looked at again.
    """
    n = len(data)
    words = words_at(data, ">u8").astype(np.uint64)
    # Places near the end read zeros, so the shorter of equal numbers comes first.
    order = n - 1 - np.argsort(words[::-1], kind="stable").astype(np.int64)
    left = np.minimum(n - order, 8)
    new = np.append(True, (words[order[1:]] != words[order[:-1]]) | (left[1:] != left[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    depth = 8
    size = np.diff(np.append(heads, n))
    open_at = np.flatnonzero(np.repeat(size > 1, size))  # places in the order that are not settled
    while len(open_at):
        at = order[open_at]
        follow = rank[np.minimum(at + depth, n)]
        group = rank[at]
        by = np.argsort((group << np.int64(32)) | (follow + 1), kind="stable")
        at, group, follow = at[by], group[by], follow[by]
        order[open_at] = at
        new = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(at)))
        fresh = open_at[heads]
        rank[at] = np.repeat(fresh, size)
        open_at = open_at[np.repeat(size > 1, size)]
        depth *= 2
        if depth > 2 * n:
            break  # only suffixes that end together are left
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order.

    After Kasai: a suffix shares at least one byte less than the suffix one place before it does with its own
    predecessor, and exactly that unless the bytes before the two differ. So only such places are compared.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prior = np.append(-1, before[:-1])
    fresh = (before < 0) | (prior < 0) | (before == 0)
    inner = ~fresh
    inner[0] = False
    places = np.flatnonzero(inner)
    fresh[places] |= data[places - 1] != data[before[places] - 1]
    fresh[0] = True
    shared = np.zeros(n, np.int64)
    words = np.append(words_at(data, "<u8"), np.zeros(1, np.uint64))
    a = np.flatnonzero(fresh & (before >= 0))
    left, right = a.copy(), before[a]
    while len(a):
        differ = words[np.minimum(left, n)] ^ words[np.minimum(right, n)]
        low = differ & (~differ + np.uint64(1))
        step = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        room = n - np.maximum(left, right)
        step = np.minimum(step, room)
        shared[a] += step
        go = (step == 8) & (room > 8)
        a, left, right = a[go], left[go] + 8, right[go] + 8
    lead = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    shared = np.maximum(shared[lead] - (np.arange(n) - lead), 0)
    return shared[order]


def lot_strings(text: np.ndarray, valid: np.ndarray, owner: np.ndarray, width: int):
    """Different strings of a lot in sorted order with the smallest id of each, and each valid place's string."""
    order, _ = suffix_array(text)
    same = common_prefixes(text, order) >= width
    same[0] = False
    group = np.cumsum(~same) - 1
    keep = valid[order]
    places, group = order[keep], group[keep]
    new = np.append(True, group[1:] != group[:-1])
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[places], heads)
    strings = text[places[heads][:, None] + np.arange(width)].view(f"S{width}").ravel()
    which = np.empty(len(text), np.int64)
    which[places] = np.cumsum(new) - 1
    return strings, least, which


def known_contexts(row: dict) -> tuple[list[bytes], list[int]]:
    """The contexts that a shard sent, and where in each the anchor is."""
    ends = np.cumsum(np.frombuffer(row["sizes"], "<i4"), dtype=np.int64).tolist()
    text = row["text"]
    return [text[a:b] for a, b in zip([0, *ends], ends)], np.frombuffer(row["anchors"], np.uint8).tolist()


def shared_strings(contexts: list[bytes], chosen: np.ndarray, least: np.ndarray, width: int, lot_bytes: int) -> list:
    """(contexts, first, last, smallest ids) of runs of strings of the chosen contexts, by lots."""
    sizes = np.array([len(contexts[i]) for i in chosen.tolist()], np.int64)
    lot_of = np.cumsum(sizes) // lot_bytes
    lots = [chosen[lot_of == k] for k in np.unique(lot_of)]
    found = []
    for lot in lots:
        own = [contexts[i] for i in lot.tolist()]
        size = np.array([len(c) for c in own], np.int64)
        text = np.frombuffer(b"".join(own), np.uint8)
        ends = np.cumsum(size)
        valid = np.arange(len(text)) + width <= np.repeat(ends, size)
        strings, smallest, which = lot_strings(text, valid, np.repeat(least[lot], size), width)
        places = np.flatnonzero(valid)
        found.append((strings, smallest, which[places], np.repeat(np.arange(len(lot)), size)[places],
                      places - np.repeat(ends - size, size)[places]))
    if not found:
        return []
    # Merge the sorted lists: the place of each lot's strings among all of them, by binary search.
    every = found[0][0] if len(found) == 1 else np.unique(np.concatenate([f[0] for f in found]))
    best = np.full(len(every), NEVER)
    where = []
    for strings, smallest, *_ in found:
        where.append(np.searchsorted(every, strings))
        np.minimum.at(best, where[-1], smallest)
    out = []
    for lot, (_, _, which, context, place), at in zip(lots, found, where):
        value = best[at[which]]
        heads = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (value[1:] != value[:-1])))
        tails = np.append(heads[1:], len(value)) - 1
        out.append((lot[context[heads]], place[heads], place[tails], value[heads]))
    return out


CONTEXTS = "bucket int, shard long, text binary, sizes binary, anchors binary, least binary"
ANSWERS = "shard long, bucket int, context binary, first binary, last binary, least binary"


def smallest_ids(shards: DataFrame, buckets: int, width: int, lot_bytes: int) -> DataFrame:
    """Answers to shards: runs of strings of a context that have a smaller id than the context has in the shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row, buckets)
                known, bucket, least, offset, *_ = s.contexts(row["answers"] or [], width)
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1]))[:len(by)]
                rows = []
                for low, high in zip(cuts, np.append(cuts[1:], len(by))):
                    mine = by[low:high]
                    own = [known[i] for i in mine.tolist()]
                    rows.append((int(bucket[mine[0]]), row["shard"], b"".join(own),
                                 np.array([len(x) for x in own], "<i4").tobytes(), offset[mine].tobytes(),
                                 least[mine].tobytes()))
                yield batch_of(CONTEXTS, rows)

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = [(r["shard"], np.frombuffer(r["least"], "<i8"), *known_contexts(r)) for r in group.to_pylist()]
        # Equal contexts of all shards are one, with the smallest id that has it.
        known: dict[bytes, int] = {}
        ids = [np.array([known.setdefault(c, len(known)) for c in own], np.int64) for _, _, own, _ in rows]
        least = np.full(len(known), NEVER)
        grams: dict[bytes, int] = {}
        anchor = np.zeros(len(known), np.int64)
        for (_, own_least, own, at), which in zip(rows, ids):
            np.minimum.at(least, which, own_least)
            anchor[which] = [grams.setdefault(c[i:i + GRAM], len(grams)) for c, i in zip(own, at)]
        # Only contexts of one anchor can share strings, so one that is its anchor's only context is done.
        shared = np.bincount(anchor)[anchor] > 1 if len(anchor) else anchor > 0
        contexts = list(known)
        alone = np.flatnonzero(~shared)
        runs = [(alone, np.zeros(len(alone), np.int64),
                 np.array([len(contexts[i]) - width for i in alone.tolist()], np.int64), least[alone]),
                *shared_strings(contexts, np.flatnonzero(shared), least, width, lot_bytes)]
        context, first, last, value = (np.concatenate(x) for x in zip(*runs))
        by = np.argsort(context, kind="stable")
        context, first, last, value = context[by], first[by], last[by], value[by]
        begins = np.searchsorted(context, np.arange(len(known) + 1))
        out = []
        for (shard, own_least, _, _), which in zip(rows, ids):
            n = begins[which + 1] - begins[which]
            place = np.repeat(np.arange(len(which)), n)
            at = np.repeat(begins[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
            less = value[at] < own_least[place]
            place, at = place[less], at[less]
            if len(at):
                out.append((shard, key[0].as_py(), place.astype("<i4").tobytes(), first[at].astype(np.uint8).tobytes(),
                            last[at].astype(np.uint8).tobytes(), value[at].tobytes()))
        return pa.Table.from_batches([batch_of(ANSWERS, out)])

    sent = shards.mapInArrow(send, CONTEXTS)
    return sent.groupBy("bucket").applyInArrow(merge, ANSWERS)


def spans_of(s: Shard, seen: list[dict], answers: list[dict], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each document of a shard, the starts and ends of the byte runs to remove."""
    known, bucket, least, _, which, starts, n, doc = s.contexts(seen, width)
    mine = s.docs[doc]
    marks = np.zeros(len(s.text) + 1, np.int64)

    def cover(start, end):
        np.add.at(marks, start, 1)
        np.add.at(marks, end, -1)

    whole = least[which] < mine
    cover(starts[whole], starts[whole] + n[whole] - 1 + width)
    # Answers name contexts by their place in the bucket.
    by = np.argsort(bucket, kind="stable")
    base = np.searchsorted(bucket[by], np.arange(bucket.max(initial=0) + 2))
    if answers and len(which):
        parts = [(by[base[a["bucket"]] + np.frombuffer(a["context"], "<i4")], np.frombuffer(a["first"], np.uint8),
                  np.frombuffer(a["last"], np.uint8), np.frombuffer(a["least"], "<i8")) for a in answers]
        context, first, last, value = (np.concatenate(x) for x in zip(*parts))
        o = np.argsort(which, kind="stable")
        run = np.argsort(context, kind="stable")
        low = np.searchsorted(context[run], which[o])
        count = np.searchsorted(context[run], which[o], side="right") - low
        occurrence = np.repeat(o, count)
        at = run[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        smaller = value[at] < mine[occurrence]
        occurrence, at = occurrence[smaller], at[smaller]
        cover(starts[occurrence] + first[at], starts[occurrence] + last[at] + width)
    covered = np.cumsum(marks[:-1]) > 0
    for begin, size in zip(s.begins.tolist(), s.sizes.tolist()):
        edge = np.diff(covered[begin:begin + size].astype(np.int8), prepend=0, append=0)
        yield begin, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def repeats_removed(docs: DataFrame, width: int = 50, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES,
                    lot_bytes: int = LOT_BYTES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row; ``kept`` is the bytes that remain."""
    shards = scratch(shards_of(texts(docs, id_column, text), width, shard_bytes), "shards")
    total = shards.agg(F.sum("n_text")).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // bucket_bytes))))

    def listed(answers: DataFrame, name: str) -> DataFrame:
        columns = [c for c in answers.columns if c != "shard"]
        return scratch(answers.groupBy("shard").agg(F.collect_list(F.struct(*columns)).alias(name)), name)

    # Bits are few, a sixty-fourth of the hashes; answers grow with what repeats and are dealt out at every size.
    seen = listed(seen_elsewhere(shards, buckets), "answers")
    size = seen.agg(F.sum(F.aggregate("answers", F.lit(0), lambda n, a: n + F.octet_length(a["seen"])))).first()[0] or 0
    shards = shards.join(F.broadcast(seen) if size <= SMALL_BYTES else seen, "shard", "left")
    shards = shards.join(listed(smallest_ids(shards, buckets, width, lot_bytes), "smaller").hint("merge"), "shard", "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row, buckets)
                data = s.text.tobytes()
                rows = []
                for k, (begin, starts, ends) in enumerate(spans_of(s, row["answers"] or [], row["smaller"] or [], width)):
                    size = int(s.sizes[k])
                    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), size]
                    kept = b"".join(data[begin + a:begin + b] for a, b in zip(edges[::2], edges[1::2]))
                    rows.append((int(s.docs[k]) if s.known[k] else None, size, size - len(kept), len(starts), kept))
                yield batch_of(CLEANED, rows)

    return shards.mapInArrow(clean, CLEANED)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
