"""Quality scores by Bradley-Terry pairwise ranking.

Each text has a few numbers: ratios of capitals, symbols, digits, repeated neighbours and distinct words, lengths and
line shapes. A preference pair is a document of label 1 and one of label 0; the score's weights minimise the logistic
loss of the feature differences of such pairs, which is the Bradley-Terry likelihood. The cut is the quantile of the
training scores at the share of label 0, and the logistic curve is moved so that the cut has the score ``cut_score``.

Weights are fitted on at most ``sample`` labelled documents and ``pairs`` pairs, both drawn by hash; every document is
scored, whole, by DataFrame expressions without a shuffle. Only the sample's numbers come to the driver.

Cases: a null or empty text is scored as an empty one; a null id is never a training row and not held out; repeated
rows repeat, a document's repeated labels count as their largest; null labels are ignored; an empty table gives no
rows. With no labels, or labels of one kind, all weights are zero and every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.session import scratch

FOLDS = 5
SYMBOLS = "#%&$*!|@^~<>{}[]=+_\\"


def features(text: Column) -> list[Column]:
    """The numbers that a text is judged by, in a fixed order."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    words = F.array_remove(F.split(t, r"\s+"), "")
    n_words = F.size(words).cast("double")

    def share(part: Column, of: Column) -> Column:
        return part.cast("double") / F.greatest(of, F.lit(1.0))

    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    symbols = n - F.length(F.translate(t, SYMBOLS, ""))
    bars = n - F.length(F.translate(t, "|", ""))
    shouts = n - F.length(F.translate(t, "!", ""))
    digits = n - F.length(F.translate(t, "0123456789", ""))
    stops = n - F.length(F.translate(t, ".,;:?", ""))
    lines = n - F.length(F.translate(t, "\n", "")) + 1
    repeats = F.size(F.regexp_extract_all(t, F.lit(r"(?<!\S)(\S+)\s+(?=\1(?!\S))"), F.lit(1)))
    distinct = F.size(F.array_distinct(words))
    return [
        share(capitals, n), F.log1p(capitals), share(symbols, n), F.log1p(symbols), share(bars, n_words),
        F.log1p(bars), share(shouts, n_words), share(digits, n), share(stops, n_words), share(n, n_words),
        share(repeats, n_words), F.log1p(repeats), share(distinct, n_words), F.log1p(n_words), share(lines, n_words),
        (n_words <= 5).cast("double")]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Ranking:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    steepness: float
    cut_score: float

    def score(self, text: Column) -> Column:
        """The score of a text from 0 to 1, as an expression."""
        if not self.weights.any():
            return F.lit(0.5)
        w = self.weights / self.scale
        total = F.lit(float(-(w * self.mean).sum() - self.cut))
        for weight, feature in zip(w, features(text)):
            total = total + F.lit(float(weight)) * feature
        shift = float(np.log(self.cut_score / (1 - self.cut_score)))
        return 1.0 / (1.0 + F.exp(-(total * self.steepness + shift)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int, cut_score: float, penalty: float = 1.0) -> Ranking:
    """Weights from differences between documents of label 1 and of label 0."""
    mean = x.mean(axis=0) if len(x) else np.zeros(0)
    scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(x.shape[1]), mean, scale, 0.0, 1.0, cut_score)
    z = (x - mean) / scale
    draw = np.random.default_rng(11)
    n = min(pairs, len(good) * len(bad))
    d = z[draw.choice(good, n)] - z[draw.choice(bad, n)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance of the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + penalty * np.eye(len(w)), d.T @ p - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cut = float(np.quantile(s, len(bad) / len(y)))
    return Ranking(w, mean, scale, cut, 1.0, cut_score)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, pairs: int = 100_000,
          cut_score: float = 0.3) -> Ranking:
    """Fit on at most ``sample`` labelled documents that are not held out."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").alias("__y"))
             .orderBy(F.xxhash64("__id"), "__id").limit(sample))
    known = scratch(known, "labelled")
    # At most ``sample`` rows of two numbers.
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(known), F.col("doc_id") == known["__id"])
            .select("doc_id", "__y", F.array(*features(F.col("text"))).alias("__x"))
            .groupBy("doc_id").agg(F.min(F.struct("__y", "__x")).alias("__r")))
    drawn = rows.select("__r.__y", "__r.__x").toPandas()
    x = np.array(drawn["__x"].tolist(), dtype=float).reshape(len(drawn), -1 if len(drawn) else len(features(F.lit(""))))
    order = np.lexsort(x.T[::-1])  # the same draw of pairs however rows arrive
    return fit(x[order], drawn["__y"].to_numpy(dtype=int)[order], pairs, cut_score)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000, pairs: int = 100_000,
                   cut_score: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    ranking = train(docs, labels, sample, pairs, cut_score)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ranking.score(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= cut_score).cast("int").alias("predicted"))


def quality_kept(docs: DataFrame, labels: DataFrame, cut_score: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score ``cut_score`` or more, with their columns."""
    ranking = train(docs, labels, cut_score=cut_score, **options)
    # As a generated column the score is computed once; inside a filter, Spark would compute shared parts repeatedly.
    scored = docs.select("*", F.inline(F.array(F.struct(ranking.score(F.col("text")).alias("__score")))))
    return scored.where(F.col("__score") >= cut_score).drop("__score")
