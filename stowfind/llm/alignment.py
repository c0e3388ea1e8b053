"""Alignment of two tokenizers' tokens on the same bytes.

A text with a space before it is encoded by a byte-level vocabulary (A, tokenizers) and by a piece vocabulary (B,
sentencepiece, which adds the space itself). Each library's spans are the coarse cuts: character offsets of A, turned
into byte offsets, and the byte spans of B's pieces (the library's newer form of its immutable proto). A span that does not hold its token's decoded bytes, because
the token is part of a character or a byte-fallback piece, is refined by those bytes. Where tokens of both end, a group
ends; within a group, tokens whose byte ranges overlap are linked.

Both libraries end a token at some places for certain: before a single space between two characters that are no white
space, around a single newline between such, and between a plain letter and a plain mark. A's split pattern never goes
on there, and B's vocabulary is checked to hold no piece that does (``separable``). Groups never cross such places, so
texts are cut there into units, and each distinct unit is encoded and aligned once and remembered, in a memory bounded
by ``REMEMBERED`` letters. Without that proof a text is one unit. Fresh words and runs of marks are encoded together,
as the lines of one text; any other unit is encoded by itself.

How many documents hold a linked pair of ids is counted in blocks of consecutive documents: a block has a list of its
distinct pairs, and its documents hold places in that list. Only the lists are shuffled to be counted and come back to
their block, each document meeting the counts of its own block; no table of pairs is broadcast.

Cases: null and empty texts, and texts whose decoded tokens are not their bytes (such as those with the letter U+2581),
have no tokens: zeros and an empty digest. A null id stays null; each row is a document of its own, so repeated rows
repeat and count again; an empty table gives none. Strings of special tokens are plain text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import sys
import types
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowfind.llm.bpe import byte_letters, vocabulary
from stowfind.llm.common import scratch, texts

REMEMBERED = 4_000_000  # letters of remembered units in one worker
LONGEST = 64  # letters of a remembered unit
BLOCK_PAIRS, BLOCK_DOCS = 1 << 18, 2048  # a block ends at so many pairs of its documents, or so many documents
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r',.;:!?|()%*&$#"\-'  # no apostrophe, which A joins to letters
UNIT = re.compile(rf" ?[{LETTERS}]+(?=[{MARKS}]|[ \n]\S|\Z)| ?[{MARKS}]+(?=[{LETTERS}]|[ \n]\S|\Z)|(?<=\S)\n(?=\S)|"
                  rf"(?s:.)(?:(?!(?<=\S)[ \n]\S|(?<=[{LETTERS}])[{MARKS}]|(?<=[{MARKS}])[{LETTERS}])(?s:.))*")
LINE = re.compile(rf" ?(?:[{LETTERS}]+|[{MARKS}]+)")  # units that stand as lines of one text
SPACE = "▁"

DOCUMENT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, "
            "places array<int>, times array<int>, pairs array<long>, held array<long>")


def refined(ids: np.ndarray, spans: np.ndarray, pieces: list[bytes], sizes: np.ndarray, data: bytes
            ) -> np.ndarray | None:
    """Where each token ends in ``data``; None if the decoded bytes are not those of ``data``.

    A span as long as its token stands; other tokens (parts of a character, byte fallback) end as many decoded bytes
    after the last one that stands.
    """
    if b"".join([pieces[i] for i in ids.tolist()]) != data:
        return None
    decoded = np.cumsum(sizes[ids])
    stands = spans[:, 1] - spans[:, 0] == sizes[ids]
    last = np.maximum.accumulate(np.where(stands, np.arange(len(ids)), -1))
    ends = decoded + np.where(last >= 0, (spans[:, 1] - decoded)[last], 0)
    return ends if (ends == decoded).all() else decoded


def linked(a_ids, a_ends, b_ids, b_ends, names: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(ends of links, linked pairs, ends of groups, groups as text) of two tokenizations of the same bytes.

    Each stretch between neighbouring ends of either side is one overlap, hence one link.
    """
    stops = np.union1d(a_ends, b_ends)
    pairs = a_ids[np.searchsorted(a_ends, stops)] * width + b_ids[np.searchsorted(b_ends, stops)]
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    sides = np.concatenate([2 * np.searchsorted(cuts, a_ends), 2 * np.searchsorted(cuts, b_ends) + 1])
    order = np.argsort(sides, kind="stable")
    step = np.minimum(np.diff(sides[order], append=sides[order][-1]), 1)
    step[step > 0] += sides[order][step > 0] % 2  # 0: the next token is of the same side and group
    parts = [""] * (2 * len(order))
    parts[::2] = [names[i] for i in np.concatenate([a_ids, b_ids])[order].tolist()]
    parts[1::2] = [(",", "|", ";")[k] for k in step.tolist()]
    return stops, pairs, cuts, "".join(parts[:-1]).split(";")


class Aligner:
    """Two vocabularies and the units met so far; one in each worker."""

    def __init__(self, a_name: str, b_name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_name if os.path.isabs(a_name) else vocabulary(a_name))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(
            model_file=b_name if os.path.isabs(b_name) else vocabulary(b_name))
        back = {x: i for i, x in enumerate(byte_letters())}
        size = self.a.get_vocab_size()
        tokens = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(names)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.width = len(names)
        letter, mark = re.compile(f"[{LETTERS}]"), re.compile(f"[{MARKS}]")
        # No piece goes on with a space after another letter, holds a newline, or has a letter beside a mark.
        self.separable = not any(
            SPACE in p.lstrip(SPACE) or "\n" in p or " " in p or any(
                letter.match(x) and mark.match(y) or mark.match(x) and letter.match(y) for x, y in zip(p, p[1:]))
            for i, p in enumerate(names) if not self.b.is_byte(i))
        self.names = list(map(str, range(max(self.width, size))))
        self.units: dict[str, tuple | None] = {}
        self.letters = 0

    def split(self, text: str) -> list[str]:
        return UNIT.findall(text) if self.separable else [text]

    def learn(self, units: list[str]) -> dict[str, tuple | None]:
        """What each unit adds: (tokens of A, of B, groups, links, groups as text, pairs); None if bytes differ."""
        lines = [u for u in units if LINE.fullmatch(u)] if self.separable else []
        learned = self.aligned("\n" + "\n".join(lines) + "\n", lines) if lines else {}
        for u in units:
            if u not in learned:
                learned |= self.alone(u)
        return learned

    def alone(self, unit: str) -> dict[str, tuple | None]:
        """A unit by itself; where it brings neither, a newline before it keeps B from joining a space to it."""
        return self.aligned(unit, [unit], 0) if unit[0] in " \n" else self.aligned("\n" + unit, [unit])

    def aligned(self, text: str, units: list[str], start: int = 1) -> dict[str, tuple | None]:
        """Align a text of units; the first begins at ``start`` and each other after a newline."""
        data = text.encode()
        a = self.a.encode(text, add_special_tokens=False)
        a_ids = np.array(a.ids, dtype=np.int64)
        a_spans = np.array(list(itertools.chain.from_iterable(a.offsets)), dtype=np.int64).reshape(-1, 2)
        if len(data) != len(text):
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            wide = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            a_spans = np.concatenate([[0], np.cumsum(wide)])[a_spans]
        added = int(text[0] == " ")  # the space that B adds
        b = self.b.encode(text[added:], return_type="offset_mapping", return_bytes=True)
        b_ids = np.array(b["ids"], dtype=np.int64)
        b_spans = np.array(list(itertools.chain.from_iterable(b["offsets"])), dtype=np.int64).reshape(-1, 2) + added
        if added:
            b_spans[:1, 0] = 0
        else:
            b_ids, b_spans = b_ids[1:], b_spans[1:]
        a_ends = refined(a_ids, a_spans, self.a_bytes, self.a_sizes, data)
        b_ends = refined(b_ids, b_spans, self.b_bytes, self.b_sizes, data)
        if a_ends is None or b_ends is None:
            return dict.fromkeys(units) if len(units) == 1 else {u: self.alone(u)[u] for u in units}
        stops, pairs, cuts, groups = linked(a_ids, a_ends, b_ids, b_ends, self.names, self.width)
        sizes = np.array([len(u) if u.isascii() else len(u.encode()) for u in units], dtype=np.int64)
        starts = start + np.cumsum(np.concatenate([[0], sizes[:-1] + 1]))
        bounds = [(np.searchsorted(x, starts, "right").tolist(), np.searchsorted(x, starts + sizes, "right").tolist())
                  for x in (a_ends, b_ends, cuts, stops)]
        counts = [[y - x for x, y in zip(*at)] for at in bounds]
        pairs = pairs.tolist()
        return {u: (n_a, n_b, n_groups, n_links, ";".join(groups[g:h]), tuple(pairs[i:j]))
                for u, n_a, n_b, n_groups, n_links, g, h, i, j in zip(units, *counts, *bounds[2], *bounds[3])}

    def align(self, documents: list[str]) -> Iterator[tuple | None]:
        """For each text the sums of its units, with how often each pair is linked."""
        parts = [self.split(" " + t) if t else [] for t in documents]
        if self.letters > REMEMBERED:
            self.units.clear()
            self.letters = 0
        fresh = list(dict.fromkeys(u for units in parts for u in units if u not in self.units))
        once: dict[str, tuple | None] = {}
        for i in range(0, len(fresh), 4000):
            once |= self.learn(fresh[i:i + 4000])
        self.units |= once
        self.letters += sum(map(len, once))
        for units in parts:
            found = list(map(self.units.__getitem__, units))
            if not found or None in found:
                yield None
                continue
            n_a, n_b, n_groups, n_links, groups, pairs = zip(*found)
            times = Counter(itertools.chain.from_iterable(pairs))
            yield sum(n_a), sum(n_b), sum(n_groups), sum(n_links), ";".join(groups), times
        for u in once:
            if len(u) > LONGEST:
                del self.units[u]
                self.letters -= len(u)


def aligner(a_name: str, b_name: str) -> Aligner:
    """One in each worker process, whose memory of units serves later tasks too.

    This module travels by value, so each task has globals of its own; the process's table of modules is shared.
    """
    kept = sys.modules.setdefault("stowfind-aligners", types.ModuleType("stowfind-aligners"))
    if getattr(kept, "names", None) != (a_name, b_name):
        kept.names, kept.tool = (a_name, b_name), Aligner(a_name, b_name)
    return kept.tool


class Block:
    """Consecutive documents, and the distinct pairs that they hold."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, found: tuple | None) -> None:
        times = found[5] if found else {}
        n_a, n_b, n_groups, n_links = found[:4] if found else (0, 0, 0, 0)
        digest = hashlib.sha256(found[4].encode()).hexdigest() if found else ""
        self.rows.append((doc_id, n_a, n_b, n_groups, n_links, digest))
        self.pairs.append(np.fromiter(times.keys(), dtype=np.int64, count=len(times)))
        self.times.append(np.fromiter(times.values(), dtype=np.int32, count=len(times)))
        self.size += len(times)

    def full(self) -> bool:
        return self.size >= BLOCK_PAIRS or len(self.rows) >= BLOCK_DOCS

    def batch(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        """The documents, and one row more with the list of pairs and the number of documents that hold each."""
        pairs, places, held = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        bounds = np.cumsum([0, *map(len, self.pairs)])
        n = len(self.rows)
        columns = [[*c, None] for c in zip(*self.rows)]
        lists = pa.ListArray.from_arrays
        ends = pa.array([*bounds, bounds[-1]], pa.int32())
        listed = pa.array([*[0] * (n + 1), len(pairs)], pa.int32())
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
        arrays += [pa.array([number] * (n + 1), pa.int64()), lists(ends, pa.array(places.astype(np.int32))),
                   lists(ends, pa.array(np.concatenate(self.times))), lists(listed, pa.array(pairs)),
                   lists(listed, pa.array(held.astype(np.int64)))]
        return pa.record_batch(arrays, schema=schema)


def aligned_blocks(docs: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """Documents with their places in their block's list of pairs, and one row for each block with that list."""
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in DOCUMENT.split(", "))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, block, count = aligner(a_name, b_name), Block(), 0
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, found in zip(part["doc_id"].to_pylist(), tool.align(part["text"].to_pylist())):
                    block.add(doc_id, found)
                    if block.full():
                        yield block.batch(first + count, schema)
                        block, count = Block(), count + 1
        if block.rows:
            yield block.batch(first + count, schema)

    return texts(docs).mapInArrow(align, DOCUMENT)


def cross_alignment(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model"
                    ) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``."""
    aligned = scratch(aligned_blocks(docs, a_name, b_name), "aligned")
    listed = aligned.where("n_a is null").select(F.col("block").alias("listing"),
                                                    F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p"))
    listed = listed.select("listing", "at", "p.pairs", "p.held")
    width = aligner(a_name, b_name).width
    counts = scratch(listed.groupBy("pairs").agg(F.sum("held").alias("n"))
                     .withColumn("a", F.floor(F.col("pairs") / width)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = counts.join(best, "a").select("pairs", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = listed.join(known, "pairs").select("listing", "at", "n", "best")
    held = aligned.where("n_a is not null").drop("pairs", "held")

    def weigh(documents: pa.Table, answers: pa.Table) -> pa.Table:
        documents, answers = documents.combine_chunks(), answers.combine_chunks()
        n = np.zeros(answers.num_rows, dtype=np.int64)
        top = np.zeros(answers.num_rows, dtype=np.int64)
        at = answers["at"].to_numpy()
        n[at], top[at] = answers["n"].to_numpy(), answers["best"].to_numpy().astype(np.int64)
        lengths = np.array([len(x) for x in documents["places"]], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in documents["places"].chunks)])
        times = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in documents["times"].chunks)])
        bounds = np.cumsum([0, *lengths])
        sums = [np.concatenate([[0], np.cumsum(x[flat] * times)]) for x in (top, n)]
        n_best, count_sum = ((s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64) for s in sums)
        kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        kept = kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
        return kept.append_column("groups_sha256", documents["groups_sha256"])

    return held.groupBy("block").cogroup(answers.groupBy("listing")).applyInArrow(
        weigh, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
               "groups_sha256 string")
