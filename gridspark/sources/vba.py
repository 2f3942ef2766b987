"""VBA projects of workbooks: module texts and references.

A project is a tree of storages, in a member of zipped workbooks or in the compound file of an xls itself. Its streams are
compressed in chunks. A helper reads the tree, inflates the streams and decodes the list of modules and references, which is
a flat row of (number, length, data); everything else is a relation.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .compound import MAGIC, Compound
from .parts import files

SCHEMA = "path string, kind string, seq int, name string, stream string, text string, raw binary, description string, location string"
# Numbers of records in the list of a project.
CODE_PAGE, VERSION, MODULES, NAME, NAME_WIDE, ORIGINAL, CONTROL, EXTENDED, REGISTERED, PROJECT = 0x03, 0x09, 0x0F, 0x16, 0x3E, 0x33, 0x2F, 0x30, 0x0D, 0x0E
MODULE, STREAM, OFFSET, END = 0x19, 0x1A, 0x31, 0x10
KINDS = ("module", "reference")
CODECS = {1200: "utf-16-le", 10000: "mac_roman", 65001: "utf-8"}


def inflated(data: bytes) -> bytes:
    """A compressed container: chunks of up to 4,096 bytes, stored or of literal bytes and copies of what the chunk has so far.

    A copy's 16 bits hold a distance and a length; the more of a chunk is there, the more bits the distance has.
    """
    if data[:1] != b"\1":
        raise ValueError("no compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head = int.from_bytes(data[at : at + 2], "little")
        if head >> 12 & 7 != 3:
            raise ValueError("no chunk signature")
        end = min(at + (head & 0xFFF) + 3, len(data))
        at += 2
        if not head >> 15:
            out += data[at : at + 4096]
            at += 4096
            continue
        start = len(out)
        while at < end:
            flags = data[at]
            at += 1
            if not flags:  # eight literals, and those of the empty bytes of flags that follow at once
                row = data[at - 1 : end : 9]
                own = bytearray(data[at - 1 : min(at - 1 + 9 * (len(row) - len(row.lstrip(b"\0"))), end)])
                at += len(own) - 1
                del own[::9]
                out += own
                continue
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                token = int.from_bytes(data[at : at + 2], "little")
                at += 2
                wide = max(4, (len(out) - start - 1).bit_length())
                length, back = (token & 0xFFFF >> wide) + 3, (token >> 16 - wide) + 1
                if back > len(out) - start:
                    raise ValueError("a copy from before its chunk")
                if back >= length:
                    out += out[-back : len(out) - back + length]
                else:  # it runs into itself
                    out += (out[-back:] * (length // back + 1))[:length]
    return bytes(out)


def listed(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, data) of each record of a project's list."""
    at = 0
    while at + 6 <= len(data):
        kind, size = struct.unpack_from("<HI", data, at)
        if kind == VERSION:  # its length leaves out two bytes
            size = 6
        if at + 6 + size > len(data):
            raise ValueError("the list of the project is cut off")
        yield kind, data[at + 6 : at + 6 + size]
        if kind == END:
            return
        at += 6 + size


def _sized(data: bytes, at: int = 0) -> bytes:
    return data[at + 4 : at + 4 + int.from_bytes(data[at : at + 4], "little")]


def project(streams: dict[str, bytes], kinds: tuple[str, ...] = KINDS) -> Iterator[dict]:
    """Modules and references of a project; streams: of its storage, by name. Of modules that are not asked for no stream is read."""
    codec, own, after, module = "cp1252", None, None, {}
    references, modules = [], []

    def point(reference: dict, library: bytes) -> None:
        """A library's identifier ends with its path and its description."""
        if not library or library.endswith(b"##"):
            return
        parts = library.decode(codec, "replace").rsplit("#", 2)
        if len(parts) < 2:
            raise ValueError("no identifier of a library")
        reference["description"] = parts[-1]
        reference["location"] = reference["location"] or parts[-2]

    for kind, data in listed(inflated(streams["dir"])):
        text = lambda b=data: b.decode(codec, "replace")
        if kind == CODE_PAGE:
            page = int.from_bytes(data[:2], "little")
            codec = CODECS.get(page, f"cp{page}")
        elif kind == NAME and after != CONTROL:  # behind a control it is that control's own
            own = {"name": text(), "description": text(), "location": ""}
            references.append(own)
        elif kind in (CONTROL, EXTENDED, REGISTERED) and own is not None:
            point(own, _sized(data))
        elif kind == ORIGINAL and own is not None:
            point(own, data)
        elif kind == PROJECT and own is not None:
            own["location"] = _sized(data).decode(codec, "replace").removeprefix("*\\C")
        elif kind == MODULE:
            module = {"name": text()}
            modules.append(module)
        elif kind == STREAM:
            module["stream"] = text()
        elif kind == OFFSET:
            module["offset"] = int.from_bytes(data[:4], "little")
        if kind != NAME_WIDE:
            after = kind
    for k, m in enumerate(modules if "module" in kinds else []):
        raw = inflated(streams[m["stream"]][m["offset"] :])
        yield {"kind": "module", "seq": k, "name": m["name"], "stream": m["stream"], "text": raw.decode(codec, "replace"), "raw": raw}
    for k, r in enumerate(r for r in references if r["name"] and "reference" in kinds):
        yield {"kind": "reference", "seq": k, **r}


def storages(data: memoryview, kinds: tuple[str, ...] = KINDS) -> Iterator[dict[str, bytes]]:
    """Streams by name of each storage that holds a project: the one with a list. Where no modules are asked for, that is all."""
    file = Compound(data)
    found = file.streams()
    for path in found:
        if path.rpartition("/")[2].lower() == "dir" and path.split("/")[-2:-1] == ["VBA"]:
            base = path[: -len("dir")]
            yield {p[len(base) :]: file.read(*where) for p, where in found.items() if (p.startswith(base) if "module" in kinds else p == path)}


def _projects(content: memoryview, kinds: tuple[str, ...]) -> Iterator[dict[str, bytes]]:
    if bytes(content[:8]) == MAGIC:
        yield from storages(content, kinds)
    elif bytes(content[:2]) == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if info.filename.replace("\\", "/").lower().endswith("vbaproject.bin"):
                    yield from storages(memoryview(z.read(info)), kinds)


def _rows(spark: SparkSession, paths, wanted: tuple[str, ...]) -> DataFrame:
    ship(spark)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"seq": pa.int32(), "raw": pa.binary()}
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    for streams in _projects(memoryview(content.as_buffer()), wanted):
                        held, size = [], 0
                        for row in project(streams, wanted):
                            held.append({"path": path, **row})
                            size += len(row.get("raw", b""))
                            if size > 4_000_000:
                                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], kinds.get(c, pa.string())) for c in names], names=names)
                                held, size = [], 0
                        if held:
                            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], kinds.get(c, pa.string())) for c in names], names=names)
                except (ValueError, KeyError, IndexError, struct.error, LookupError) as e:
                    raise ValueError(f"{path}: the VBA project cannot be read: {e}") from e

    return files(spark, paths).mapInArrow(run, SCHEMA)


def modules(spark: SparkSession, paths) -> DataFrame:
    """(path, seq, name, stream, text, raw) of the modules of all workbooks that have a project."""
    return _rows(spark, paths, ("module",)).select("path", "seq", "name", "stream", "text", "raw")


def references(spark: SparkSession, paths) -> DataFrame:
    """(path, seq, name, description, location): libraries and projects that a project names."""
    return _rows(spark, paths, ("reference",)).select("path", "seq", "name", "description", "location")


def missing_references(spark: SparkSession, paths, known: DataFrame) -> DataFrame:
    """(path, missing): how many references of each project are at no location of ``known`` (location).

    Which files a machine has, only that machine can say, so it is a relation here.
    """
    own = references(spark, paths).join(known.select("location").distinct().withColumn("_known", F.lit(True)), "location", "left")
    return own.groupBy("path").agg(F.count_if(F.col("_known").isNull()).alias("missing"))
