"""Token ids of whole texts, equal to the tokenizers library's, with each distinct chunk encoded once.

Both tokenizers split a text before any merge, and never join what stands on the two sides of a space
between two other characters: the byte-level one begins a new unit at such a space, the word-level one
drops it. So the ids of a text are those of its chunks in a row, and a chunk that has been seen needs
no second encoding. Spaces beside white space, or beside characters outside plain Latin ranges, are no
chunk borders; the library itself sees such stretches whole.
"""

from __future__ import annotations

import array
import os
import re

_PLAIN = "!-~¡-ſ"
_OTHER = re.compile(f"[^\n {_PLAIN}]")
_BORDER = re.compile(f"(?<=[{_PLAIN}]) (?=[{_PLAIN}])")
_BORDERS = re.compile(f"(?<=[{_PLAIN}])[ \n\t\r]+(?=[{_PLAIN}])")
#: Longer chunks are rare and are not kept.
KEPT_CHARS = 48
_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a worker and kept to one thread."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def byte_level_chunks(text: str) -> list[str]:
    """Chunks of a text for a byte-level tokenizer; all but the first follow a space."""
    if _OTHER.search(text) or "  " in text or " \n" in text or "\n " in text:
        return _BORDER.split(text)
    return text.split(" ")


def word_chunks(text: str) -> list[str]:
    """Chunks of a text for a tokenizer that drops white space."""
    return _BORDERS.split(text) if _OTHER.search(text) else text.split()


#: A word of plain Latin letters, perhaps with one mark behind it: two units for either tokenizer.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-į]+)([.,;:!?]?)")


def _byte_alphabet() -> list[str]:
    """Characters that byte-level tokenizers write bytes as: visible ones as themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_ALPHABET = dict(enumerate(_byte_alphabet()))


def _bytes_as_characters(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET)


class ChunkCache(dict):
    """chunk -> value, computed on a miss. Two generations of at most ``most`` chunks bound the memory;
    a chunk of the older one that is asked for moves to the newer."""

    def __init__(self, compute, most: int = 700_000):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, chunk: str):
        value = self.older.get(chunk)
        if value is None:
            value = self.compute(chunk)
        if len(chunk) <= KEPT_CHARS:
            self[chunk] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


_CACHES: dict[tuple, ChunkCache] = {}


def _cache(key: tuple, compute) -> ChunkCache:
    if key not in _CACHES:
        _CACHES[key] = ChunkCache(compute)
    return _CACHES[key]


class ByteLevelCounter:
    """Number of tokens of a text under a byte-level tokenizer file."""

    def __init__(self, path: str):
        t = tokenizer(path)
        self.encode = lambda s: len(t.encode(s, add_special_tokens=False).ids)
        self.alone = _cache((path, "alone"), self.encode)
        self.after_space = _cache((path, "count"), self._count)
        self.model = t.model

    def _count(self, chunk: str) -> int:
        m = _WORD.fullmatch(chunk)
        if m and m[2]:
            return self.after_space[m[1]] + self.alone[m[2]]
        if m:  # one unit of the pattern; the byte alphabet writes a space as U+0120
            return len(self.model.tokenize("\u0120" + _bytes_as_characters(chunk)))
        return self.encode(" " + chunk)

    def __call__(self, text: str) -> int:
        chunks = byte_level_chunks(text)
        self.after_space.trim()
        return self.encode(chunks[0]) + sum(map(self.after_space.__getitem__, chunks[1:]))


class WordIds:
    """Ids of a text under a tokenizer file that lower-cases and drops white space, as little-endian
    unsigned 32-bit bytes."""

    def __init__(self, path: str):
        t = tokenizer(path)
        self.encode = lambda s: t.encode(s, add_special_tokens=False).ids
        self.cache = _cache((path, "ids"), self._ids)
        self.model = t.model

    def _ids(self, chunk: str) -> bytes:
        m = _WORD.fullmatch(chunk)
        if m:
            low = m[1].lower()
            if m[2]:
                return self.cache[low] + self.cache[m[2]]
            if low != chunk:
                return self.cache[low]
        ids = [x.id for x in self.model.tokenize(_bytes_as_characters(chunk))] if m else self.encode(chunk)
        return array.array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        self.cache.trim()
        return b"".join(map(self.cache.__getitem__, word_chunks(text)))
