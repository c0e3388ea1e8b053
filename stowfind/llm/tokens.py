"""Token counts by the whole-token shortcut.

Offline, the vocabulary strings that merge to exactly one token are proven (``Bpe.whole``). In a text, each pre-token
that is such a string counts one; only the others are merged. Texts with unusual characters or special strings, and
vocabularies of other kinds, are counted by their library as a whole.

Cases: a null or empty text has 0 bytes and 0 tokens; a null id stays null; every row of the input gives one row, so
repeated rows repeat; an empty table gives an empty one; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowfind.llm.bpe import SPLIT, load, vocabulary
from stowfind.llm.common import texts

# Merged words remembered by a worker; beyond that it forgets and merges again.
REMEMBERED = 400_000


class Counter(dict):
    """Tokens of each pre-token: one if proven whole, else merged once and remembered."""

    def __init__(self, bpe):
        super().__init__(dict.fromkeys(bpe.whole, 1))
        self.bpe, self.known = bpe, len(bpe.whole)

    def __missing__(self, word: str) -> int:
        n = self.bpe.pieces(word)
        self[word] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > self.known + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.bpe.whole, 1))
        return sum(map(self.__getitem__, SPLIT.findall(text)))


def counter(name: str):
    """A function from a text to its number of tokens."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        return lambda text: len(model.encode(text))
    bpe = load(name)
    words = Counter(bpe) if bpe.byte_level else None

    def count(text: str) -> int:
        if words is not None and bpe.plain(text):
            return words.count(text)
        return len(bpe.library.encode(text, add_special_tokens=False).ids)

    return count


def token_counts(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json", limit: int = 1024,
                 id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``; no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens = counter(vocabulary_name)
        for batch in batches:
            numbers = pa.array([n_tokens(x.as_py()) for x in batch["text"]], pa.int64())
            yield pa.record_batch([batch["doc_id"], batch["n_bytes"], numbers], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs, id_column, text).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
