"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of words are counted over the whole corpus: exactly for words of the benchmark, by a hash of
   the word for all others.
2. Each benchmark item is a TF-IDF passage. A randomised SVD of these passages, whose products are summed by Spark over
   parts of the items, gives a latent space of at most ``rank`` dimensions. A lot has at most ``items_at_once`` items and
   never more than ``rank``, so its space is complete and latent products are the exact ones. This bounds what is
   broadcast as well; each lot reads the documents once.
3. Documents are cut to overlapping windows of a few lengths. A window's cosine to an item is its latent product over
   its own norm. It is a candidate by the least cosine, or by a product as large as that of any window which holds
   what verification asks for, made of the item's words of least weight; so a passage of an item's length that would be
   accepted is a candidate in any surroundings. A window whose words cannot reach either with any item, by the most that
   each word can add for the items of a part, is not projected.
4. A candidate is verified word by word: the longest common subsequence of the item and the text around the window must
   hold ``copy_share`` of the item's words, or, for a paraphrase, ``paraphrase_share`` and the item's answer: the words
   of highest IDF of its last sentence.

Cases: a null or empty text has no windows and no hits; a text shorter than a window is one window; null or empty
benchmark texts match nothing; a null id keeps its hits, with a null id; repeated rows repeat; empty tables give no
hits; other columns are ignored, or passed through by ``decontaminated``. Hits of an item in a document are one row, the
one of largest overlap, then the earliest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowfind.llm.common import texts
from stowfind.session import scratch

PUNCTUATION = bytes(b for b in range(128) if not (chr(b).isalnum() or b in b" "))
TO_SPACE = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
# Numbers of the hash of words that no benchmark item has.
OTHERS = 1 << 16
# Words of a block: windows begin at blocks.
STEP = 8
BYTES_AT_ONCE = 1 << 20
TEXTS_AT_ONCE = 1000
BLOCKS_AT_ONCE = 4096
# Where items are cut to parts that share a bound, blocks that are bounded at once, and room for single precision.
EDGES = (1, 2, 4, 8)
BLOCKS_OF_BOUND = 1 << 15
ROOM = 1e-3


def powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd number, modulo 2 to the 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of a base and of its inverse, as many as the longest run of bytes has needed."""

    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    up, down = powers(base, 1 << 16), powers(inverse, 1 << 16)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = powers(cls.base, 2 * n), powers(cls.inverse, 2 * n)
        return cls.up, cls.down


def word_hashes(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each text.

    A word's hash is a polynomial of its bytes, so all words of some texts are hashed by a few array operations.
    """
    spoken = [t.lower().encode("utf-8", "replace") for t in texts_]
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(spoken), np.int64)
    ends = np.cumsum([len(x) + 1 for x in spoken])
    low = 0
    while low < len(spoken):
        begin = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, begin + BYTES_AT_ONCE, side="right")))
        data = np.frombuffer((b" ".join(spoken[low:high]) + b" ").translate(TO_SPACE), np.uint8)
        inside = data != 32
        edges = np.diff(inside.astype(np.int8), prepend=0)
        starts = np.flatnonzero(edges == 1)
        if len(starts):
            up, down = Powers.of(len(data))
            h = np.add.reduceat(np.where(inside, data, 0).astype(np.uint64) * up[:len(data)], starts) * down[starts]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            hashes.append(h ^ (h >> np.uint64(29)))
            counts[low:high] = np.bincount(np.searchsorted(ends[low:high] - begin, starts, side="right"),
                                           minlength=high - low)
        low = high
    return np.concatenate(hashes), counts


class Numbers:
    """Word numbers: the benchmark's words first, by their hashes, then a shorter hash of all other words."""

    def __init__(self, own: np.ndarray):
        self.own = own  # sorted
        self.likely = np.zeros(OTHERS, dtype=bool)
        self.likely[self.short(own)] = True

    @staticmethod
    def short(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - OTHERS.bit_length() + 1)).astype(np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        short = self.short(hashes)
        out = short + len(self.own)
        maybe = np.flatnonzero(self.likely[short])
        at = np.minimum(np.searchsorted(self.own, hashes[maybe]), len(self.own) - 1)
        same = self.own[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out


@dataclass
class Lot:
    """What a task needs to search for one lot of items; its size is bounded by the lot."""

    item_ids: list
    items: list[np.ndarray]  # word numbers of each item
    answers: list[np.ndarray]  # word numbers of each item's answer, in order
    own: np.ndarray  # sorted hashes of benchmark words
    idf: np.ndarray  # by word number
    basis: np.ndarray  # benchmark words by latent dimensions
    queries: np.ndarray  # items by latent dimensions, unit rows
    lengths: list[tuple[int, np.ndarray]]  # window length in words, items looked for in such windows

    def parts(self) -> tuple:
        """The fields alone: a broadcast object of a class of this package would need the package on executors."""
        return tuple(getattr(self, f.name) for f in fields(self))


def word_frequencies(rows: DataFrame, own: np.ndarray) -> tuple[int, np.ndarray]:
    """Documents, and the number that hold each word number: ``len(own) + OTHERS`` numbers, whatever the corpus."""
    size = len(own) + OTHERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = Numbers(own), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                hashes, n_words = word_hashes(batch["text"].slice(low, TEXTS_AT_ONCE).to_pylist())
                text = np.repeat(np.arange(len(n_words)), n_words)
                pairs = np.sort(text * size + numbers.of(hashes))
                once = pairs[np.append(True, pairs[1:] != pairs[:-1])[:len(pairs)]]
                counts[:size] += np.bincount(once % size, minlength=size)
            counts[size] += batch.num_rows
        found = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(counts[found])], ["word", "n"])

    summed = rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size + 1, dtype=np.int64)
    counts[summed["word"].to_numpy(dtype=int)] = summed["n"]
    return int(counts[size]), counts[:size]


def times_own(passages: DataFrame, right: np.ndarray) -> np.ndarray:
    """Aᵀ(A right) for the passages A (row, words, weights): partial sums in tasks, added by Spark, word by word."""
    wide = passages.sparkSession.sparkContext.broadcast(right)  # words of a lot by dimensions

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for words, weights in zip(batch["words"].to_pylist(), batch["weights"].to_pylist()):
                w = np.array(weights)
                image = w @ wide.value[words]
                for word, x in zip(words, w):
                    total[word] = total.get(word, 0) + x * image
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()])],
                                  ["word", "v"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"word": rows["word"].iloc[:1], "v": [np.sum(np.stack(rows["v"]), axis=0)]})

    summed = (passages.select("words", "weights").mapInArrow(parts, "word int, v array<double>")
              .groupBy("word").applyInPandas(add, "word int, v array<double>").toPandas())
    out = np.zeros_like(right)
    for word, v in zip(summed["word"], summed["v"]):
        out[word] = v
    return out


def latent_basis(passages: DataFrame, words: int, items: int, rank: int, rounds: int = 2, spare: int = 8) -> np.ndarray:
    """Words by dimensions: an orthonormal basis of the leading right singular vectors of the passages."""
    width = min(rank + spare, items, words)
    basis = np.random.default_rng(5).standard_normal((words, width))
    for _ in range(rounds):
        basis = np.linalg.qr(times_own(passages, basis))[0]
    # Rayleigh-Ritz: the leading directions within the range that was found.
    values, turn = np.linalg.eigh(basis.T @ times_own(passages, basis))
    lead = np.argsort(-values)[:rank]
    return basis @ turn[:, lead[values[lead] > 1e-9 * max(values.max(initial=0), 1e-30)]]


def prepare(rows: DataFrame, items: list[tuple[int, str]], rank: int, answer_words: int) -> Lot | None:
    """Statistics and latent space of one lot of items."""
    spark = rows.sparkSession
    hashes, n_words = word_hashes([t for _, t in items])
    ends, n_last = word_hashes([last_sentence(t) for _, t in items])
    own = np.unique(hashes)
    if not len(own):
        return None
    of = Numbers(own)
    every, last = np.split(of.of(hashes), np.cumsum(n_words)[:-1]), np.split(of.of(ends), np.cumsum(n_last)[:-1])
    named = [(i, n, e) for (i, _), n, e in zip(items, every, last) if len(n)]
    documents, counts = word_frequencies(rows, own)
    idf = np.log((documents + 1) / (counts + 1)) + 0.05
    numbers = [n for _, n, _ in named]
    sparse = []
    for k, n in enumerate(numbers):
        w, tf = np.unique(n, return_counts=True)
        x = tf * idf[w]
        sparse.append((k, w.tolist(), (x / np.sqrt((x * x).sum())).tolist()))
    passages = spark.createDataFrame(sparse, "row int, words array<int>, weights array<double>")
    basis = latent_basis(passages.repartition(8), len(own), len(numbers), rank)
    queries = np.stack([np.array(x) @ basis[w] for _, w, x in sparse])
    norms = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    answers = []
    for _, _, n in named:
        rare = sorted(range(len(n)), key=lambda i: (-idf[n[i]], i))[:answer_words]
        answers.append(n[sorted(rare)])
    # Windows that hold an item wherever it begins, and little more.
    sizes = np.array([window_length(len(n)) for n in numbers])
    return Lot([i for i, *_ in named], numbers, answers, own, idf, basis.astype(np.float32),
               (queries / np.maximum(norms, 1e-12)).astype(np.float32),
               [(int(s), np.flatnonzero(sizes == s)) for s in np.unique(sizes)])


def window_length(words: int) -> int:
    """Whole blocks for an item that begins anywhere in the first, in steps of an eighth for long items."""
    step = STEP * max(1, 1 << max(0, (words // (8 * STEP)).bit_length() - 1))
    return -(-(words + STEP - 1) // step) * step


def least_product(added: list[float], answer: list[float], copy_share: float, paraphrase_share: float) -> float:
    """The least product of an item and a window that holds a copy, or a paraphrase with the answer.

    ``added`` is what each place of the item adds, ``answer`` what each place of its answer does. The places of least
    weight are those kept, besides the answer's.
    """
    def kept(places: list[float], share: float, sure: int = 0) -> float:
        return sum(sorted(places)[:max(0, math.ceil(share * len(added) - 1e-9) - sure)])

    rest = list(added)
    for x in answer:
        rest.remove(x)
    return min(kept(added, copy_share), sum(answer) + kept(rest, paraphrase_share, len(answer)))


def last_sentence(text: str) -> str:
    parts = [p for p in text.replace("\n", " ").replace("!", ".").replace("?", ".").split(".") if p.strip()]
    return parts[-1] if parts else ""


def overlap(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, by one big number whose bits are the item's words."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in words.tolist():
        m = masks.get(w)
        if m:
            row = ((row + (row & m)) | (row & ~m)) & full
    return len(item) - row.bit_count()


class Search:
    """Finds the items of a lot in texts."""

    def __init__(self, lot: Lot, cosine: float, copy_share: float, paraphrase_share: float):
        self.lot, self.cosine, self.copy, self.paraphrase = lot, cosine, copy_share, paraphrase_share
        self.numbers, self.n_own = Numbers(lot.own), len(lot.own)
        self.weight = np.append(lot.idf, 0.0)  # the last number stands for no word
        self.square = self.weight ** 2
        # What each word adds to the product with an item; the least product of a window that holds as much of the item
        # as verification asks for, with room for single precision.
        adds, self.least = [], np.zeros(len(lot.items))
        for k, (item, answer) in enumerate(zip(lot.items, lot.answers)):
            w, tf = np.unique(item, return_counts=True)
            x = tf * lot.idf[w] ** 2
            adds.append((w, x / np.sqrt((tf * x).sum())))
            of = dict(zip(w.tolist(), adds[k][1].tolist()))
            self.least[k] = (1 - ROOM) * least_product([of[i] for i in item.tolist()], [of[i] for i in answer.tolist() if i in of],
                                                       copy_share, paraphrase_share)
        self.bounds = [self.bound(items[np.argsort(self.least[items])], adds) for _, items in lot.lengths]
        self.basis = np.vstack([lot.basis, np.zeros((1, lot.basis.shape[1]), np.float32)])
        self.basis[:-1] *= lot.idf[:self.n_own, None].astype(np.float32)

    def bound(self, items: np.ndarray, adds: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The most that words add with any item of a part, and a part's least product; small parts for small ones."""
        edges = [0, *(e for e in EDGES if e < len(items)), *range(EDGES[-1] + EDGES[-1], len(items), EDGES[-1])]
        parts = [p for p in np.split(items, edges[1:]) if len(p)]
        most = np.zeros((len(self.weight), len(parts)), np.float32)
        for i, part in enumerate(parts):
            for k in part:
                w, x = adds[k]
                most[w, i] = np.maximum(most[w, i], x)
        return most, np.array([self.least[p].min() for p in parts])

    def candidates(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(first word, window length, item, cosine) over texts padded to whole blocks."""
        every = numbers.reshape(-1, STEP)
        longest = max((length for length, _ in self.lot.lengths), default=0) // STEP
        for low in range(0, len(every), BLOCKS_OF_BOUND):
            blocks = every[low:low + BLOCKS_OF_BOUND + longest]
            for at, *found in self.candidates_of(blocks, min(BLOCKS_OF_BOUND, len(every) - low)):
                yield low * STEP + at, *found

    def candidates_of(self, blocks: np.ndarray, n_starts: int) -> Iterator[tuple[int, int, int, float]]:
        """``candidates`` that begin in the first ``n_starts`` blocks."""
        n = len(blocks)
        norm = np.append(0.0, self.square[blocks].sum(axis=1).cumsum())
        own = blocks < self.n_own
        spoken, place = blocks[own], np.append(0, own.sum(axis=1).cumsum())
        for (length, items), (most, least) in zip(self.lot.lengths, self.bounds):
            span = length // STEP
            start = np.arange(n_starts)
            stop = np.minimum(start + span, n)
            mass = norm[stop] - norm[start]
            added = np.zeros((len(spoken) + 1, most.shape[1]))
            np.cumsum(most[spoken], axis=0, out=added[1:])
            reach = added[place[stop]] - added[place[start]]
            enough = np.minimum(self.cosine * np.sqrt(mass)[:, None] * (1 - ROOM), least)
            live = np.flatnonzero((reach >= enough).any(axis=1) & (mass > 0))
            queries = self.lot.queries[items]
            for a in range(0, len(live), BLOCKS_AT_ONCE):
                part = live[a:a + BLOCKS_AT_ONCE]
                use = np.zeros(n + 1, dtype=np.int64)
                np.add.at(use, part, 1)
                np.add.at(use, stop[part], -1)
                needed = np.flatnonzero(use.cumsum()[:n] > 0)
                if not len(needed):
                    continue
                w = np.minimum(blocks[needed], self.n_own)
                sums = np.vstack([np.zeros((1, self.basis.shape[1])),
                                  self.basis[w].sum(axis=1).cumsum(axis=0, dtype=np.float64)])
                first = np.searchsorted(needed, part)
                latent = sums[first + (stop[part] - part)] - sums[first]
                # A window is at least as long as its image; both bound its norm, which counts repeated words.
                norms = np.maximum(np.sqrt(mass[part]), np.sqrt((latent * latent).sum(axis=1)))
                product = latent @ queries.T
                near = product / norms[:, None]
                i, j = np.nonzero((near >= self.cosine) | (product >= self.least[items]))
                yield from zip((part[i] * STEP).tolist(), [length] * len(i), items[j].tolist(), near[i, j].tolist())

    def hits_of(self, texts_: list[str]) -> list[dict]:
        """``hits`` a number of texts at a time."""
        return [x for low in range(0, len(texts_), TEXTS_AT_ONCE) for x in self.hits(texts_[low:low + TEXTS_AT_ONCE])]

    def hits(self, texts_: list[str]) -> list[dict[int, tuple[float, float, int, bool]]]:
        """For each text, by item: (cosine, overlap, first word, answer)."""
        if not texts_:
            return []
        nothing = len(self.weight) - 1
        hashes, n_words = word_hashes(texts_)
        spoken = np.split(self.numbers.of(hashes), np.cumsum(n_words)[:-1])
        begins = np.cumsum([0, *(-(-len(x) // STEP) * STEP for x in spoken)])
        flat = np.full(begins[-1], nothing, dtype=np.int64)
        for x, b in zip(spoken, begins):
            flat[b:b + len(x)] = x
        best: list[dict] = [{} for _ in texts_]
        if not len(flat):
            return best
        tried: set[tuple[int, int, int]] = set()
        for at, length, item, near in sorted(self.candidates(flat), key=lambda c: -c[3]):
            k = int(np.searchsorted(begins, at, side="right")) - 1
            words, at = spoken[k], at - int(begins[k])
            wanted = self.lot.items[item]
            # Neighbouring windows lie within the text that one of them looks at.
            if any((k, item, at + d * STEP) in tried for d in (-1, 0, 1)):
                continue
            tried.add((k, item, at))
            low = max(0, at - len(wanted) - STEP)
            around = words[low:at + length + len(wanted) + STEP]
            share = overlap(wanted, around) / len(wanted)
            if share < self.paraphrase:
                continue
            answer = self.lot.answers[item]
            answered = overlap(answer, around) == len(answer)
            if share < self.copy and not answered:
                continue
            old = best[k].get(item)
            if old is None or (share, near) > (old[1], old[0]):
                best[k][item] = (near, share, low + int(np.argmax(np.isin(around, wanted))), answered)
        return best


def lots(docs: DataFrame, benchmark: DataFrame, rank: int, items_at_once: int, answer_words: int,
         item_id: str, item_text: str) -> Iterator[Lot]:
    """Lots of at most ``items_at_once`` and ``rank`` items, one after another, from a table that Spark deals out."""
    rows = texts(docs)
    items = (benchmark.where(F.col(item_text).isNotNull())
             .select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("words")))
    n, most = items.count(), min(items_at_once, rank)
    parts = max(1, -(-n // most))
    items = items.withColumn("lot", F.pmod(F.xxhash64("item", "words"), F.lit(parts)))
    for k in range(parts):
        lot = [(r["item"], r["words"]) for r in items.where(F.col("lot") == k).orderBy("item", "words").collect()]
        for low in range(0, len(lot), most):
            if (prepared := prepare(rows, lot[low:low + most], rank, answer_words)) is not None:
                yield prepared


HITS = "doc_id long, item_id long, cosine double, overlap double, first_word long, answered boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, copy_share: float = 0.8,
                 paraphrase_share: float = 0.65, rank: int = 256, items_at_once: int = 1000, answer_words: int = 3,
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, overlap, first_word, answered) for each document and item that it holds."""
    spark = docs.sparkSession
    out = None
    for lot in lots(docs, benchmark, rank, items_at_once, answer_words, item_id, item_text):
        shared = spark.sparkContext.broadcast(lot.parts())  # bounded by items_at_once

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(Lot(*shared.value), cosine, copy_share, paraphrase_share)
            names = search.lot.item_ids
            for batch in batches:
                found = search.hits_of(batch["text"].to_pylist())
                rows = [(d, names[i], *h) for d, hits in zip(batch["doc_id"].to_pylist(), found)
                        for i, h in sorted(hits.items())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          HITS.replace(",", "").split()[::2])

        part = texts(docs).mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], HITS) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, copy_share: float = 0.8,
                   paraphrase_share: float = 0.65, rank: int = 256, items_at_once: int = 1000, answer_words: int = 3,
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns."""
    spark = docs.sparkSession
    for lot in lots(docs, benchmark, rank, items_at_once, answer_words, item_id, item_text):
        shared = spark.sparkContext.broadcast(lot.parts())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(Lot(*shared.value), cosine, copy_share, paraphrase_share)
            for batch in batches:
                found = search.hits_of([t or "" for t in batch["text"].to_pylist()])
                yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
