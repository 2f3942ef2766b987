"""VBA projects for tests and round trips: compressed containers, the list of a project, compound files with storages."""

from __future__ import annotations

import struct

import numpy as np


def deflated(data: bytes, copies: int = 256) -> bytes:
    """A compressed container; the first ``copies`` bytes of each chunk are searched for copies, the rest are literals."""
    out = bytearray(b"\1")
    for start in range(0, len(data), 4096):
        chunk, body, at = data[start : start + 4096], bytearray(), 0
        # a last chunk of literals alone would be longer than a chunk may be
        searched = len(chunk) if 3600 < len(chunk) < 4096 else copies
        while at < len(chunk):
            if at >= searched:  # eight literals behind an empty byte of flags
                rest = np.zeros((-(-(len(chunk) - at) // 8), 9), np.uint8)
                rest[:, 1:] = np.frombuffer(chunk[at:].ljust(8 * len(rest), b"\0"), np.uint8).reshape(-1, 8)
                body += rest.tobytes()[: len(chunk) - at + len(rest)]
                break
            flags, own = 0, bytearray()
            for bit in range(8):
                if at >= len(chunk):
                    break
                wide = max(4, (at - 1).bit_length()) if at else 4
                most, length, back = (0xFFFF >> wide) + 3, 0, 0
                for n in range(3, min(18, most, len(chunk) - at) + 1):  # the longest that is there already, itself included
                    found = chunk.rfind(chunk[at : at + n], 0, at + n - 1)
                    if found < 0:
                        break
                    length, back = n, at - found
                if length:
                    flags |= 1 << bit
                    own += struct.pack("<H", (back - 1) << 16 - wide | length - 3)
                    at += length
                else:
                    own.append(chunk[at])
                    at += 1
            body += bytes([flags]) + own
        if len(body) > 4096 and len(chunk) == 4096:
            out += struct.pack("<H", 0x3FFF) + chunk
        else:
            out += struct.pack("<H", 0xB000 | len(body) + 2 - 3) + body
    return bytes(out)


def _record(kind: int, data: bytes = b"") -> bytes:
    return struct.pack("<HI", kind, len(data)) + data


def _sized(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def project(modules: dict[str, str], references: list[tuple[str, str, str]] = (), codec: str = "utf-8", page: int = 65001, junk: int = 10) -> dict[str, bytes]:
    """Streams of a project by path; references: (kind, name, identifier) of kind registered, project or control. Before each text ``junk`` bytes lie."""
    code = lambda s: s.encode(codec)
    own = _record(0x01, struct.pack("<I", 1)) + _record(0x02, struct.pack("<I", 1033)) + _record(0x14, struct.pack("<I", 1033)) + _record(0x03, struct.pack("<H", page)) + _record(0x04, b"P")
    own += _record(0x05) + _record(0x40) + _record(0x06) + _record(0x3D) + _record(0x07, bytes(4)) + _record(0x08, bytes(4)) + struct.pack("<HIIH", 0x09, 4, 1, 1) + _record(0x0C) + _record(0x3C)
    for kind, name, identifier in references:
        own += _record(0x16, code(name)) + _record(0x3E, name.encode("utf-16-le"))
        if kind == "registered":
            own += _record(0x0D, _sized(code(identifier)) + bytes(6))
        elif kind == "project":
            own += _record(0x0E, _sized(code(identifier)) + _sized(b"*\\Crelative") + bytes(6))
        else:
            own += _record(0x33, code(identifier)) + _record(0x2F, _sized(b"*\\G{0}#1#0##") + bytes(6)) + _record(0x16, b"inner") + _record(0x3E, "inner".encode("utf-16-le")) + _record(0x30, _sized(b"*\\G{0}#1#0#twice#desc") + bytes(26))
    own += _record(0x0F, struct.pack("<H", len(modules))) + _record(0x13, bytes(2))
    streams = {}
    for k, (name, text) in enumerate(modules.items()):
        stream = f"m{k}"
        own += _record(0x19, code(name)) + _record(0x47, name.encode("utf-16-le")) + _record(0x1A, code(stream)) + _record(0x32, stream.encode("utf-16-le")) + _record(0x1C) + _record(0x48)
        own += _record(0x31, struct.pack("<I", junk)) + _record(0x1E, bytes(4)) + _record(0x2C, bytes(2)) + _record(0x22 if k % 2 else 0x21) + (_record(0x25) if k % 3 == 0 else b"") + _record(0x2B)
        streams[f"VBA/{stream}"] = bytes(junk) + deflated(code(text))
    return {"VBA/dir": deflated(own + _record(0x10)), "PROJECT": b"ID=1", **streams}


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with a tree of storages; siblings hang on each other to the right."""
    free, end, least = 0xFFFFFFFF, 0xFFFFFFFE, 4096
    names: list[tuple[str, bytes | None]] = [("", None)]
    known = {""}
    for path, data in streams.items():
        parts = path.split("/")
        for k in range(1, len(parts)):
            if "/".join(parts[:k]) not in known:
                known.add("/".join(parts[:k]))
                names.append(("/".join(parts[:k]), None))
        known.add(path)
        names.append((path, data))
    sectors, table, pool, minor = [], [], bytearray(), []

    def stored(data: bytes) -> int:
        """First sector of data that is written out."""
        first = len(sectors)
        n = -(-len(data) // 512)
        for k in range(n):
            sectors.append(data[512 * k : 512 * k + 512].ljust(512, b"\0"))
            table.append(first + k + 1 if k + 1 < n else end)
        return first if n else end

    places = {}
    for path, data in names:
        if data is not None and len(data) >= least:
            places[path] = stored(data)
        elif data:
            first, n = len(minor), -(-len(data) // 64)
            places[path] = first
            minor += [*range(first + 1, first + n), end]
            pool += data.ljust(64 * n, b"\0")
    root = stored(bytes(pool))
    small = stored(struct.pack(f"<{len(minor)}I", *minor).ljust(-(-len(minor) // 128) * 512, b"\xff")) if minor else end
    first_child: dict[str, int] = {}
    next_of: dict[int, int] = {}
    last: dict[str, int] = {}
    for k, (path, _) in enumerate(names):
        if k:
            above = path.rpartition("/")[0]
            first_child.setdefault(above, k)
            if above in last:
                next_of[last[above]] = k
            last[above] = k
    raw = bytearray()
    for k, (path, data) in enumerate(names):
        child = first_child.get(path, free) if data is None else free
        right = next_of.get(k, free)
        name = path.rpartition("/")[2] or "Root Entry"
        kind = 5 if not k else 1 if data is None else 2
        first, length = (root, len(pool)) if not k else (0, 0) if data is None else (places.get(path, end), len(data))
        raw += name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, free, right, child) + bytes(36) + struct.pack("<III", first, length, 0)
    folder = stored(bytes(raw).ljust(-(-len(raw) // 512) * 512, b"\0"))
    tables = 1
    while tables * 128 < len(sectors) + tables:
        tables += 1
    own = [len(sectors) + k for k in range(tables)]
    extra = own[109:]
    follow = [*table, *[0xFFFFFFFD] * tables]
    lists = [extra[k : k + 127] for k in range(0, len(extra), 127)]
    at = len(sectors) + tables
    chains = b"".join(struct.pack("<128I", *(part + [free] * (127 - len(part))), at + k + 1 if k + 1 < len(lists) else end) for k, part in enumerate(lists))
    follow += [0xFFFFFFFC] * len(lists)
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", tables, folder, 0, least, small, -(-len(minor) // 128), at if lists else end, len(lists))
    rows = struct.pack(f"<{len(follow)}I", *follow).ljust(tables * 512, b"\xff")[: tables * 512]
    return head + struct.pack("<109I", *(own[:109] + [free] * (109 - len(own[:109])))) + b"".join(sectors) + rows + chains
