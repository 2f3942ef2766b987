"""Compound files: sectors, chains, and the tree of storages and streams."""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
#: From here on numbers of sectors are marks, not places.
_MARKS = 0xFFFFFFFA
_NONE = 0xFFFFFFFF


def _numbers(raw: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])


class Compound:
    """The streams of a compound file. ValueError where sectors lie outside the file or run in a circle."""

    def __init__(self, data: memoryview) -> None:
        self.data, self.size, self.small = data, 1 << data[30], 1 << data[32]
        word = lambda at: int.from_bytes(data[at : at + 4], "little")
        listed, more = list(_numbers(bytes(data[76:512]))), word(68)
        for _ in range(word(72)):
            if more >= _MARKS:
                break
            *own, more = _numbers(bytes(self.sector(more)))
            listed += own
        self.table = _numbers(b"".join(bytes(self.sector(k)) for k in listed[: word(44)] if k < _MARKS))
        self.least, self.minor_first = word(56), word(60)
        raw = self.chained(word(48))
        self.entries = [self.entry(raw[at : at + 128]) for at in range(0, len(raw) - 127, 128)]
        self.pool: bytes | None = None

    @staticmethod
    def entry(raw: bytes) -> tuple[str, int, int, int, int, int, int]:
        """(name, kind, left, right, child, first sector, length)."""
        kind, left, right, child = raw[66], *struct.unpack_from("<III", raw, 68)
        return raw[:64].decode("utf-16-le", "replace").split("\0")[0], kind, left, right, child, *struct.unpack_from("<II", raw, 116)

    def sector(self, k: int) -> memoryview:
        own = self.data[(k + 1) * self.size : (k + 2) * self.size]
        if not len(own):
            raise ValueError(f"no sector {k}")
        return own

    def chain(self, first: int, follow: tuple[int, ...]) -> Iterator[int]:
        for _ in range(len(follow) + 1):
            if first >= _MARKS:
                return
            yield first
            if first >= len(follow):
                raise ValueError(f"no sector {first}")
            first = follow[first]
        raise ValueError("sectors in a circle")

    def chained(self, first: int) -> bytes:
        return b"".join(bytes(self.sector(k)) for k in self.chain(first, self.table))

    def read(self, first: int, length: int) -> bytes:
        """A stream; short ones lie in the pool of small sectors, which belongs to the root."""
        if length >= self.least:
            return self.chained(first)[:length]
        if self.pool is None:
            self.pool, self.minor = self.chained(self.entries[0][5]), _numbers(self.chained(self.minor_first))
        return b"".join(self.pool[k * self.small : (k + 1) * self.small] for k in self.chain(first, self.minor))[:length]

    def streams(self) -> dict[str, tuple[int, int]]:
        """Path of each stream, with slashes between storages -> (first sector, length)."""
        found: dict[str, tuple[int, int]] = {}
        seen: set[int] = set()
        todo = [("", self.entries[0][4])] if self.entries else []
        while todo:
            base, k = todo.pop()
            if k == _NONE or k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, left, right, child, first, length = self.entries[k]
            todo += [(base, left), (base, right)]
            if kind == 1:
                todo.append((f"{base}{name}/", child))
            elif kind == 2:
                found[base + name] = (first, length)
        return found
