"""Byte-level BPE vocabularies of the tokenizers library, with proven shortcuts for plain text.

The library's own encoder is the meaning of every result here. Two shortcuts give the same ids sooner:

* ``whole``: vocabulary strings that the library merges to one token by themselves. A pre-token that equals one of
  them is one token, as merges never cross pre-tokens.
* ``fast``: the same merges run by another public library, when each merge's id is its rank.

Both hold for *plain* texts only: characters on whose classes all libraries agree, and no special string. Any other
text goes to the library whole.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

# Letters of European alphabets and ASCII without the information separators, which libraries class differently.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſΑ-ΡΣ-Ω"
                     "α-ωА-я–—‘’“”…]")
# The public split pattern, written for texts without unusual characters.
SPLIT = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary strings: itself if printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Bpe:
    """One vocabulary, loaded once in each worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], [x["content"] for x in spec.get("added_tokens", ())]
        splitter = spec.get("pre_tokenizer") or {}
        self.byte_level = (model.get("type") in (None, "BPE") and splitter.get("type") == "ByteLevel"
                           and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
                           and not spec.get("normalizer") and not model.get("dropout")
                           and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix"))
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.vocab, self.merges = model["vocab"], model.get("merges", [])
        self.letters = {ord(chr(b)): x for b, x in enumerate(byte_letters())}

    def plain(self, text: str) -> bool:
        return self.byte_level and not UNUSUAL.search(text) and not (self.special and self.special.search(text))

    def pieces(self, word: str) -> int:
        """Tokens of one pre-token, merged by the library."""
        return len(self.library.model.tokenize(word.encode().decode("latin-1").translate(self.letters)))

    @functools.cached_property
    def whole(self) -> frozenset[str]:
        """Vocabulary strings proven to be one token when they stand as a pre-token."""
        back = {x: b for b, x in enumerate(byte_letters())}
        proven = []
        for key in self.vocab:
            if all(x in back for x in key) and len(self.library.model.tokenize(key)) == 1:
                try:
                    proven.append(bytes(back[x] for x in key).decode())
                except UnicodeDecodeError:
                    continue
        return frozenset(proven)

    @functools.cached_property
    def fast(self):
        """An encoder of the same merges, or None if ids do not follow the order of merges."""
        if not self.byte_level:
            return None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in self.merges]
        merged = [a + b for a, b in pairs]
        ids = [self.vocab.get(x, -1) for x in merged]
        if ids != sorted(set(ids)) or (ids and ids[0] < 256) or any(self.vocab.get(x, 256) > 255 for x in byte_letters()):
            return None
        import tiktoken

        back = {x: b for b, x in enumerate(byte_letters())}
        ranks = {bytes(back[c] for c in x): self.vocab[x] for x in [*byte_letters(), *merged]}
        return tiktoken.Encoding("same-merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit numbers."""
        if self.fast is not None and self.plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def load(name: str) -> Bpe:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Bpe(name if os.path.isabs(name) else vocabulary(name))
