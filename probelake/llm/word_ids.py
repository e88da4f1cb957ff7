"""Token ids of texts by a public tokenizer file, word by word.

The tokenizer drops white space and no pre-token spans it, so the ids of a text are
those of its words in order. Words are cached per Python worker; what is not cached is
encoded by the tokenizer's own model (plain Latin words) or by the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Cached words of a worker (about 250 bytes each); beyond it the cache starts anew, ids stay the same. Words from ``LONG`` bytes on are not cached.
CACHE, LONG = 400_000, 64
#: ASCII marks that end a pre-token of letters or digits; the apostrophe is not among them.
_MARKS = b"!#$%&()*+,-./:;<=>?@[\\]^_`{|}~\""
_LATIN = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, the others as 256 and up, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


_LETTERS = _byte_letters()


class WordIds:
    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = cache
        self.cache: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _model(self, raw: bytes) -> bytes:
        return np.array([t.id for t in self.model.tokenize(raw.decode("latin-1").translate(_LETTERS))], "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        if core and core != word:
            last = core.decode("utf-8")[-1]
            if last.isascii() and last.isalnum() or _LATIN.fullmatch(last):
                return self._cached(core) + self._cached(word[len(core) :])
        if not core:
            return self._model(word)
        text = word.decode("utf-8")
        if _LATIN.fullmatch(text):
            return self._model(text.lower().encode("utf-8"))
        return self._whole(text)

    def _cached(self, word: bytes) -> bytes:
        ids = self.cache.get(word)
        if ids is None:
            ids = self._word(word)
            if len(word) < LONG:
                self.cache[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without special tokens."""
        raw = (text or "").encode("utf-8")
        if b"<|" in raw:  # may spell a special token, which is told apart before letters are lowered
            return self._whole(text)
        words = raw.lower().split()
        if len(self.cache) > self.size:
            self.cache = {}
        found = list(map(self.cache.get, words))
        if None in found:
            found = [self._cached(w) if f is None else f for w, f in zip(words, found, strict=True)]
        return b"".join(found)


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The one of this process, so that tasks of a worker share the cache."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
