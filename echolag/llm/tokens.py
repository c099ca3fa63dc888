"""Token ids of a public tokenizer, word by word.

The tokenizer drops white space and treats the words between it alone, so the ids of a text are those of its words one after
the other. Words repeat; their ids are kept in a table of bounded size. Words of plain letters, perhaps with marks after
them, go straight to the tokenizer's merges; any other word goes through the whole tokenizer.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# most words whose ids a worker keeps, about 90 MB
KEPT_WORDS = 400_000
# Latin letters that stand alone under composition, and marks that split off as one
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints, else one beyond U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in prints}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + len(letters) - len(prints)))
    return [letters[b] for b in range(256)]


class WordEncoder:
    """Little-endian 32-bit ids of UTF-8 texts."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.marks = lru_cache(10_000)(self._merged)
        outer = self

        class Known(dict):
            def __missing__(self, word: bytes) -> bytes:
                ids = outer._encode(word)
                if len(self) < KEPT_WORDS:
                    self[word] = ids
                return ids

        self.known = Known()

    @staticmethod
    @lru_cache(1)
    def shared(path: str) -> WordEncoder:
        """One encoder for all tasks of a worker."""
        return WordEncoder(path)

    def __call__(self, text: bytes) -> bytes:
        # bytes.split() parts at the six ASCII spaces, all of which the tokenizer drops
        return b"".join(map(self.known.__getitem__, text.split()))

    def _merged(self, word: str) -> bytes:
        ids = [t.id for t in self.merge("".join(map(self.letters.__getitem__, word.encode())))]
        return np.asarray(ids, "<u4").tobytes()

    def _encode(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _PLAIN.match(text)
        if plain and plain[2] == "":
            return self._merged(text.lower())
        if plain:
            core = plain[1].encode()
            return self.known[core] + self.marks(plain[2])
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
