"""Token ids of whole texts from a tokenizers file, by a memo of space-separated words."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache
from operator import attrgetter

import numpy as np

_ID = attrgetter("id")
#: Python's str.split also splits at these four, the tokenizer's white space doesn't hold them.
_OTHER_SPACE = re.compile("[\x1c-\x1f]")
#: Marks that the pre-tokenizer always separates from the letters before them, as one run.
_TAIL = ".,!?;:|#$%&*()"


class _Memo(dict):
    """Computes what it lacks; remembers strings of at most `longest` characters, in about `most` bytes.

    When new entries take half of that, they become the old half: an old entry that is asked for again is new, the
    others go.
    """

    def __init__(self, compute, most: int, longest: int = 256):
        super().__init__()
        self.compute, self.half, self.longest, self.used, self.old = compute, most // 2, longest, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if self.used > self.half:
            self.old, self.used = dict(self), 0
            self.clear()
        # a character takes at most four bytes; 200 for the two objects and the table's entry
        self.used += 4 * len(key) + len(value) + 200
        self[key] = value
        return value


class WordEncoder:
    """Ids (little-endian unsigned 32-bit) of a text under a tokenizer that never joins text across white space.

    Texts are lower-cased first, as the tokenizer would do. A new word is a word core and the marks after it; every new
    core goes through the library once, letters alone straight to its BPE model. A text for which this could differ
    goes to the library whole. `memory` is about the bytes of the words and cores that a worker remembers, in one table.
    """

    def __init__(self, path: str, memory: int = 160 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: whether a word of letters alone is one pre-token: NFC, lower case, bytes, then the model
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.words = _Memo(self._word, memory)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _core(self, core: str) -> bytes:
        if self.plain and core.isalpha():
            known = core if core.isascii() else core.encode().decode("latin-1").translate(self.shown)
            return array("I", map(_ID, self.tokenizer.model.tokenize(known))).tobytes()
        return self.whole(core)

    def _word(self, word: str) -> bytes:
        """A word by its core and the marks after it, which are words of their own; any other as a core."""
        if self.plain and not word.isalpha():
            core = word.rstrip(_TAIL)
            if core.isalpha():
                return self.words[core] + self.words[word[len(core) :]]
        return self._core(word)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; none for a null or empty one."""
        if not text:
            return b""
        if _OTHER_SPACE.search(text) or "<|" in text or "Σ" in text:
            return self.whole(text)
        if self.plain:
            low = text.lower()
            if not low.isascii() and not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
                return self.whole(text)
            text = low
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """The worker process's encoder: what it remembers serves the tasks that follow."""
    return WordEncoder(path)
