"""Language identification by string kernels.

A text is lower-cased, white space becomes single spaces, and it is cut into pieces of ``piece`` characters. A piece is
the set of its character n-grams of lengths 1 to ``longest`` (the blended spectrum), each hashed to one of ``slots``
places; only presence counts. The kernel of two pieces is the number of places that both hold, divided by the roots of
how many each holds. A text's kernel is the mean over its pieces, weighted by length, so whole texts count however long
they are and no piece fills the places.

Fitting is a Nyström approximation of kernel ridge regression: ``landmarks`` drawn pieces are the reference points; a
text's kernels with them, times the inverse root of the landmarks' own kernel matrix, are its coordinates; one ridge
regression per language is solved in them against all other languages, each language weighing the same. It is fitted
on at most ``sample`` labelled rows, drawn by hash and dealt evenly to the languages; with more than ``sample``
languages the rest are not learned. Landmarks (as bits), kernels of the sample and weights are all that the driver
holds. Every row is then scored, without a shuffle, by products of matrices of 64 pieces with the folded matrix
landmarks x weights.

Cases: a null text and a text without a letter are ``und`` with score 0, as is every text when nothing could be
learned; a null id is neither learned from nor held out; null languages are not learned from; repeated rows repeat and
count once in the sample; ties go to the language first in order; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowfind.llm.common import scratch
from stowfind.llm.quality import held_out

UNKNOWN = "und"
AT_ONCE = 64  # pieces in one product


@dataclass(frozen=True)
class Spectrum:
    """How texts become sets of places."""

    longest: int = 4
    slots: int = 1 << 15
    piece: int = 4096

    def pieces(self, text: str) -> list[tuple[int, np.ndarray]]:
        """(length, places with repeats) of each piece of a text."""
        clean = f" {' '.join(text.lower().split())} "
        codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return [(len(codes[i:i + self.piece]), self.places(codes[i:i + self.piece]))
                for i in range(0, len(codes), self.piece)]

    def places(self, codes: np.ndarray) -> np.ndarray:
        shift = np.uint32(32 - (self.slots - 1).bit_length())
        grams = np.zeros(len(codes), dtype=np.uint32)
        found = []
        for n in range(1, self.longest + 1):
            if n > len(codes):
                break
            grams = grams[:len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] + np.uint32(n)
            mixed = grams ^ (grams >> np.uint32(15))
            found.append((mixed * np.uint32(0x9E3779B1)) >> shift)
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)

    def products(self, texts: list[str], matrix: np.ndarray) -> np.ndarray:
        """Each text's mean, by length of its pieces, of (presence / root of the places held) x matrix."""
        out = np.zeros((len(texts), matrix.shape[1]))
        total = np.zeros(len(texts))
        held = np.zeros((AT_ONCE, self.slots), dtype=np.float32)
        waiting: list[tuple[int, int, np.ndarray]] = []

        def flush() -> None:
            rows = np.repeat(np.arange(len(waiting)), [len(p) for _, _, p in waiting])
            places = np.concatenate([p for _, _, p in waiting])
            held[rows, places] = 1.0
            part = held[:len(waiting)]
            values = (part @ matrix) / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1.0))
            held[rows, places] = 0.0
            owner = np.array([i for i, _, _ in waiting])
            weight = np.array([n for _, n, _ in waiting], dtype=float)
            np.add.at(out, owner, values * weight[:, None])
            np.add.at(total, owner, weight)
            waiting.clear()

        for i, text in enumerate(texts):
            for n, places in self.pieces(text):
                waiting.append((i, n, places))
                if len(waiting) == AT_ONCE:
                    flush()
        if waiting:
            flush()
        return out / np.maximum(total, 1.0)[:, None]

    def landmark(self, text: str) -> bytes:
        """The places of the text's richest piece, as bits."""
        sets = [np.unique(places) for _, places in self.pieces(text)]
        bits = np.zeros(self.slots, dtype=np.uint8)
        bits[max(sets, key=len)] = 1
        return np.packbits(bits).tobytes()

    def matrix(self, landmarks: list[bytes]) -> np.ndarray:
        """Places x landmarks, each landmark divided by the root of the places that it holds."""
        bits = np.array([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=self.slots) for x in landmarks],
                        dtype=np.float32).reshape(len(landmarks), self.slots)
        return (bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1.0))).T


@dataclass(frozen=True)
class Languages:
    """A fitted model: names in order, and the matrix (places x languages) and constants that score them."""

    names: tuple[str, ...]
    folded: np.ndarray
    constants: np.ndarray


def ridge(kernels: np.ndarray, between: np.ndarray, languages: list[str], penalty: float
          ) -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    """(names, weights of the landmarks, constants) of one-versus-rest ridge regressions on Nyström coordinates."""
    names = tuple(sorted(set(languages)))
    values, vectors = np.linalg.eigh(between)
    strong = values > max(values.max(), 0.0) * 1e-6
    root = vectors[:, strong] / np.sqrt(values[strong])
    points = kernels @ root
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    counts = {x: languages.count(x) for x in names}
    share = np.array([1.0 / (len(names) * counts[x]) for x in languages])[:, None]
    middle, level = (share * points).sum(axis=0), (share * y).sum(axis=0)
    centred = points - middle
    system = (share * centred).T @ centred + penalty * np.eye(points.shape[1])
    weights = np.linalg.solve(system, (share * centred).T @ (y - level))
    return names, root @ weights, level - middle @ weights


def labelled_sample(docs: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows (place, lang, text) that may be learned from, dealt evenly to the languages."""
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
            .where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
                   & F.col("text").rlike(r"\p{L}"))
            .withColumn("draw", F.xxhash64("doc_id", "text")))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    dealt = (rows.select("doc_id", "lang", "draw").withColumn("turn", F.row_number().over(order))
             .where(F.col("turn") <= sample).orderBy("turn", "draw", "doc_id", "lang").limit(sample)
             .groupBy("doc_id", "lang", "draw").agg(F.min("turn").alias("turn")))
    drawn = scratch(dealt, "dealt")
    # At most ``sample`` rows of four numbers.
    return (rows.join(F.broadcast(drawn), ["doc_id", "lang", "draw"]).dropDuplicates(["doc_id", "lang", "draw"])
            .select("turn", "draw", "doc_id", "lang", "text"))


def train(docs: DataFrame, landmarks: int = 128, sample: int = 4000, penalty: float = 1e-4,
          spectrum: Spectrum = Spectrum()) -> Languages:
    drawn = scratch(labelled_sample(docs, sample), "language-sample")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([spectrum.landmark(x.as_py()) for x in batch["text"]], pa.binary())],
                                  ["bits"])

    first = drawn.orderBy("turn", "draw", "doc_id", "lang").limit(landmarks)
    points = sorted({r["bits"] for r in first.mapInArrow(bits, "bits binary").collect()})
    if not points:
        return Languages((), np.zeros((spectrum.slots, 0), dtype=np.float32), np.zeros(0))
    matrix = spectrum.matrix(points)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                k = spectrum.products(part["text"].to_pylist(), matrix)
                yield pa.record_batch([part["lang"], pa.array(list(k), pa.list_(pa.float64()))], ["lang", "k"])

    rows = sorted((r["lang"], r["k"]) for r in drawn.mapInArrow(kernels, "lang string, k array<double>").collect())
    names, weights, constants = ridge(np.array([k for _, k in rows]), (matrix.T @ matrix).astype(float),
                                      [x for x, _ in rows], penalty)
    return Languages(names, (matrix @ weights).astype(np.float32), constants)


def languages(docs: DataFrame, landmarks: int = 128, sample: int = 4000, penalty: float = 1e-4,
              spectrum: Spectrum = Spectrum()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``."""
    model = train(docs, landmarks, sample, penalty, spectrum)
    # Plain values, so that workers need no class of this module for the broadcast itself: slots x languages numbers.
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.folded, model.constants))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, folded, constants = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4 * AT_ONCE):
                part = batch.slice(i, 4 * AT_ONCE)
                texts = [x if x is not None and any(map(str.isalpha, x)) else "" for x in part["text"].to_pylist()]
                known = np.array([bool(x) for x in texts]) & bool(names)
                picked, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known.any():
                    margins = spectrum.products([x for x in texts if x], folded) + constants
                    chance = np.clip((1.0 + np.round(margins, 6)) / 2.0, 0.0, 1.0)
                    best = np.round(margins, 6).argmax(axis=1)
                    share = chance.max(axis=1) / np.maximum(chance.sum(axis=1), 1e-9)
                    for at, lang, p in zip(np.flatnonzero(known), best, share):
                        picked[at], sure[at] = names[lang], round(float(p), 6)
                yield pa.record_batch([part["doc_id"], pa.array(picked, pa.string()), pa.array(sure)],
                                      ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (rows.mapInArrow(score, "doc_id long, lang_pred string, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
