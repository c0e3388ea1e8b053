"""Dense vectors: exact top-k, pooling and batch encoding of texts."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowfind.operators.ordered import top_n

QUERY_BLOCK, VECTOR_SLICE = 2_048, 32_768
QUERIES_AT_ONCE = 64  # rows of scores in memory at once, in two arrays
DIGITS = 12


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = -1.0,
                key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact ``k`` nearest rows per query by cosine: (query_id, key, score, rank).

    Queries are dealt to blocks and vectors to slices of about ``QUERY_BLOCK`` and ``VECTOR_SLICE`` rows. Each pair of a
    block and a slice is one task's matrix product, which sends on its best ``k`` per query; the partial lists
    are merged by a limited window. Nothing of the tables passes the driver but their two counts.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    slices = max(1, -(-vectors.count() // VECTOR_SLICE))

    def every(n: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                          F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice"), every(blocks, "block"))
    right = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"), every(slices, "of_slice"),
                           F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("of_block"))

    def search(found: pa.Table, asked: pa.Table) -> pa.Table:
        parts = [best_of(found, asked, k, min_score)] if found.num_rows and asked.num_rows else [([], [], [])]
        q, v, s = map(np.concatenate, zip(*parts))
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
                        ["query_id", key, "score"])

    hits = left.groupBy("slice", "block").cogroup(right.groupBy("of_slice", "of_block")).applyInArrow(
        search, f"query_id long, {key} long, score double")
    return top_n(hits, ["query_id"], [F.desc("score"), F.asc(key)], k)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.combine_chunks()
    sizes = np.unique(flat.value_lengths().to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(1)
    if flat.null_count or len(sizes) != 1:
        raise ValueError(f"a vector is null or of another dimension than others: {sizes.tolist()}")
    values = flat.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if not np.isfinite(values).all():
        raise ValueError("a vector holds a value that is not finite")
    return values.reshape(len(flat), int(sizes[0]))


def best_of(found: pa.Table, asked: pa.Table, k: int, min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of the best ``k`` rows for each query; ties go to smaller ids."""
    q, m = matrix(asked["q"]), matrix(found["v"])
    if m.shape[1] != q.shape[1]:
        raise ValueError(f"vectors of {m.shape[1]} against queries of {q.shape[1]} dimensions")
    ids, query_ids = found["id"].to_numpy(), asked["query_id"].to_numpy()
    m_norm = np.sqrt((m * m).sum(1))
    out = []
    for at in range(0, len(q), QUERIES_AT_ONCE):
        part = q[at:at + QUERIES_AT_ONCE]
        norms = np.outer(np.sqrt((part * part).sum(1)), m_norm)
        scores = part @ m.T
        some = norms > 0
        np.divide(scores, norms, out=scores, where=some)
        scores[~some] = 0.0
        np.round(np.clip(scores, -1.0, 1.0, out=scores), DIGITS, out=scores)
        np.copyto(norms, scores)
        last = scores.shape[1] - min(k, scores.shape[1])
        norms.partition(last, axis=1)
        least = np.maximum(norms[:, last], min_score)
        for i, row in enumerate(scores):
            near = np.flatnonzero(row >= least[i])
            near = near[np.lexsort((ids[near], -row[near]))[:k]]
            out.append((np.full(len(near), query_ids[at + i]), ids[near], row[near]))
    return tuple(map(np.concatenate, zip(*out)))


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Masked mean per key, scaled to length 1: (key, pos, value).

    Sums combine per task before the shuffle, so a key with very many vectors is fine.
    """
    live = tokens.filter(F.col(mask)).select(key, F.posexplode(vector).alias("pos", "v"))
    means = live.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    norms = means.groupBy(key).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    return means.join(norms, key).select(
        key, "pos", F.when(F.col("norm") > 0, F.col("mean") / F.col("norm")).otherwise(F.col("mean")).alias("value"))


class TransientError(Exception):
    """Raised by an encoder for failures worth a retry."""


@dataclass(frozen=True)
class BatchEncoder:
    """A user's function from texts to vectors, with batch caps, retries and checks."""

    id: str
    version: int
    encode: Callable[[list[str]], "np.ndarray"]
    dimensions: int
    max_inputs: int = 32
    max_bytes: int = 1 << 20
    retries: int = 2
    settings: str = ""

    def __post_init__(self) -> None:
        if not self.id.strip():
            raise ValueError("encoder id must not be blank")
        if not 1 <= self.max_inputs <= 256:
            raise ValueError("max_inputs must lie in 1..256")

    @property
    def provider_id(self) -> str:
        """Id with a 12-byte digest of the settings, so changed settings re-encode."""
        material = f"{self.settings}\n{self.dimensions}"
        return f"{self.id}-{hashlib.sha256(material.encode()).hexdigest()[:24]}"

    def _call(self, texts: list[str]) -> np.ndarray:
        for attempt in range(self.retries + 1):
            try:
                matrix = np.asarray(self.encode(texts), dtype="float64")
                break
            except TransientError:
                if attempt == self.retries:
                    raise
                time.sleep(0.05 * 2 ** attempt)
        if matrix.shape != (len(texts), self.dimensions):
            raise ValueError(f"encoder returned shape {matrix.shape}")
        if not np.isfinite(matrix).all():
            raise ValueError("encoder returned a value that is not finite")
        if (matrix * matrix).sum(1).min() <= 0:
            raise ValueError("encoder returned a zero vector")
        return matrix

    def _groups(self, texts: list[str]) -> Iterator[list[int]]:
        group, size = [], 0
        for i, text in enumerate(texts):
            n = len(text.encode())
            if group and (len(group) == self.max_inputs or size + n > self.max_bytes):
                yield group
                group, size = [], 0
            group.append(i)
            size += n
        if group:
            yield group

    def run(self, texts: DataFrame, key: str) -> DataFrame:
        """(key, vector, norm) for a frame of (key, text)."""

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                values = batch["text"].to_list()
                for group in self._groups(values):
                    matrix = self._call([values[i] for i in group])
                    yield pd.DataFrame({
                        key: batch[key].to_numpy()[group],
                        "vector": list(matrix.astype("float32")),
                        "norm": np.sqrt((matrix * matrix).sum(1)),
                    })

        kind = texts.schema[key].dataType.simpleString()
        return texts.select(key, "text").mapInPandas(encode, f"{key} {kind}, vector array<float>, norm double")
