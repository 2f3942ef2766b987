"""GIF media columns: palettes, LZW, disposal, transparency and timing.

``encode_gifs`` stores bytes losslessly as 8-bit samples: frames of 64 samples a row under a grey palette,
each an LZW stream of its own. ``decode`` reads any GIF: LZW code streams of every minimal code size,
global and local palettes, interlacing, delays, transparent indices and the disposal methods; it gives the
frames as they are shown, each with its time and a colour histogram. The code widths of LZW follow from
the number of codes since the last clear code, so all codes up to the next clear are cut out of the bit
stream at once in numpy; only the table itself is followed code by code.

Memory is bounded by what is worked on at once: ``LANES`` code streams while encoding, whose tables have the
size that their longest one needs, and ``PIXELS`` samples (or one frame) while decoding.

Defined cases: a null text is empty; an empty text is one row of zeros; equal texts, and rows that repeat,
give equal media; an empty table gives no rows; other columns are not read, whatever their names; very long
texts have as many frames as they need. Streams and files that end early give the frames and samples that
they have, the rest of a frame staying zero; a table that is full stays as it is until a clear code, however
many codes follow. What is no GIF, or asks for a screen or frame of more than ``MOST_PIXELS``, has one row in
``gif_frames`` that states the error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, slices, texts

WIDTH = 64
ROWS = 16
DELAY_CS = 4
#: Code streams that are encoded at once, entries of their tables together, and samples of them together.
LANES, ENTRIES, SAMPLES = 1024, 1 << 23, 1 << 24
#: Samples that are decoded at once, and the most that a screen or a frame may have.
PIXELS, MOST_PIXELS = 1 << 20, 1 << 26
#: Codes behind a full table that are decoded at once.
FOLLOWING = 1024
_GREY = bytes(x for i in range(256) for x in (i, i, i))


def _widths(size: int) -> np.ndarray:
    """Widths of the codes after a clear code, for samples of ``size`` bits: they follow from how many were read."""
    return np.minimum(12, np.maximum(size + 1, np.ceil(np.log2((1 << size) + 2 + np.arange(4097))).astype(np.int64)))


_SCHEDULE = {s: _widths(s) for s in range(2, 9)}


def _table_bits(longest: int) -> int:
    """Size of the table of a stream, a quarter full at most."""
    return (4 * min(3838, longest)).bit_length()


def lzw_codes(lanes: list[bytes]) -> list[np.ndarray]:
    """Codes of several streams of 8-bit samples, each led by a clear code and ended by the end code.

    Streams of about the same length are encoded together, a bounded number of them at once.
    """
    found: list = [None] * len(lanes)
    order = sorted(range(len(lanes)), key=lambda k: -len(lanes[k]))
    while order:
        longest = len(lanes[order[0]])
        n = max(1, min(LANES, ENTRIES >> _table_bits(longest), SAMPLES // longest))
        for k, codes in zip(order[:n], _lane_codes([lanes[k] for k in order[:n]])):
            found[k] = codes
        order = order[n:]
    return found


def _lane_codes(lanes: list[bytes]) -> list[np.ndarray]:
    """``lzw_codes`` of a bounded number of streams, the longest first.

    All streams advance by one sample in each step. A stream's table (prefix code, sample) -> code is an
    open hash table of its own; when it is full, a clear code empties it.
    """
    sizes = np.array([len(x) for x in lanes])
    n, longest = len(lanes), int(sizes[0])
    samples = np.zeros((n, longest), np.uint8)
    for k, lane in enumerate(lanes):
        samples[k, : sizes[k]] = np.frombuffer(lane, np.uint8)
    samples = np.ascontiguousarray(samples.T).astype(np.uint32)
    bits = _table_bits(longest)
    table = np.zeros(n << bits, np.uint32)
    lane = np.arange(n, dtype=np.int64)
    base, mask = lane << bits, (1 << bits) - 1
    out = np.zeros((n, longest + longest // 3000 + 4), np.uint16)
    out[:, 0] = 256
    count, free, prefix = np.ones(n, np.int64), np.full(n, 258, np.uint32), samples[0].copy()
    alive = np.searchsorted(-sizes, -np.arange(longest), "left")  # lanes longer than t
    for t in range(1, longest):
        a = int(alive[t])
        c, p = samples[t, :a], prefix[:a]
        key = p << np.uint32(8) | c
        slot = base[:a] + ((key * np.uint32(2654435761)) >> np.uint32(32 - bits))
        entry = table[slot]
        wrong = np.flatnonzero((entry >> np.uint32(12) != key) & (entry != 0))
        while len(wrong):
            slot[wrong] = base[wrong] + (slot[wrong] + 1 & mask)
            entry[wrong] = e = table[slot[wrong]]
            wrong = wrong[(e >> np.uint32(12) != key[wrong]) & (e != 0)]
        new = np.flatnonzero(entry == 0)
        prefix[:a] = entry & np.uint32(4095)
        out[new, count[new]] = key[new] >> np.uint32(8)
        count[new] += 1
        table[slot[new]] = key[new] << np.uint32(12) | free[new]
        free[new] += np.uint32(1)
        prefix[new] = c[new]
        full = new[free[new] > 4096]
        if len(full):
            out[full, count[full]] = 256
            count[full] += 1
            free[full] = 258
            table.reshape(n, -1)[full] = 0
    out[lane, count], out[lane, count + 1] = prefix, 257
    return [out[k, : count[k] + 2].copy() for k in range(n)]


def _ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of these lengths in a row: which stretch each place is in, and where in it."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]


def lzw_pack(streams: list[np.ndarray]) -> list[bytes]:
    """The bit stream of each stream's codes (8-bit samples); every one begins with a clear code."""
    codes, counts = np.concatenate(streams).astype(np.int32), np.array([len(x) for x in streams])
    clear = np.flatnonzero(codes == 256)
    _, since = _ragged(np.diff(np.concatenate([clear, [len(codes)]])))
    first = np.cumsum(counts) - counts
    width = _SCHEDULE[8][np.maximum(since - 1, 0)].astype(np.int64)
    # a later clear code is read at the width of the code it stands for, the first one at the least width
    again = clear[~np.isin(clear, first)]
    width[again] = _SCHEDULE[8][since[again - 1]]
    before = np.concatenate([[0], np.cumsum(width)])
    sizes = (before[first + counts] - before[first] + 7) >> 3
    byte0 = np.cumsum(sizes) - sizes
    at = before[:-1] + np.repeat(8 * byte0 - before[first], counts)
    shifted, byte = codes << (at & 7).astype(np.int32), at >> 3
    total = np.zeros(int(sizes.sum()) + 3)
    for k in range(3):  # bits of different codes never overlap, so sums do for unions
        total += np.bincount(byte + k, shifted >> 8 * k & 255, len(total))
    packed = total.astype(np.uint8).tobytes()
    return [packed[a : a + n] for a, n in zip(byte0.tolist(), sizes.tolist())]


def lzw_decode(streams: list[bytes], size: int, most: list[int]) -> list[bytes]:
    """Samples of code streams of one minimal code size, at most ``most`` of each.

    A table entry is the string of the code that was read when it was made and one sample more, so a code
    is a pointer to an earlier code of its stretch, and each of its samples a pointer to an earlier sample.
    Following pointers by doubling gives first the lengths and then the samples, with no table at all.
    A stretch that goes on when its table is full only points into what it has written until then.
    """
    n, clear, schedule = len(streams), 1 << size, _SCHEDULE[size]
    before = np.concatenate([[0], np.cumsum(schedule)])
    raw = np.frombuffer(b"".join(x + b"\0\0\0\0" for x in streams), np.uint8).astype(np.uint32)
    first = np.cumsum([0, *(len(x) + 4 for x in streams)])[:-1]
    stop = np.array([len(x) * 8 for x in streams])
    at, live = np.zeros(n, np.int64), np.arange(n)
    pieces: list[list[bytes]] = [[] for _ in range(n)]
    got = np.zeros(n, np.int64)

    def codes_at(base: np.ndarray | int, bit: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        byte = base + (bit >> 3)
        code = (raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)) >> (bit & 7).astype(np.uint32)
        return code & ((np.uint32(1) << np.asarray(width, np.uint32)) - np.uint32(1))

    while len(live):
        fits = np.searchsorted(before, stop[live] - at[live], "right") - 1  # of the codes until the table is full
        owner, index = _ragged(fits)
        code = codes_at(first[live][owner], at[live][owner] + before[index], schedule[index])
        marks = np.flatnonzero((code == clear) | (code == clear + 1))
        ended = np.full(len(live), len(code))
        own, where = np.unique(owner[marks], return_index=True)
        ended[own] = marks[where]
        begin = np.cumsum(fits) - fits
        data = np.minimum(ended - begin, fits)
        owner, index = _ragged(data)
        closed = np.zeros(len(live), bool)
        closed[own] = code[marks[where]] == clear
        at[live] += before[data] + np.append(schedule, 0)[data]
        strings, position, length = _strings(code[begin[owner] + index].astype(np.int64), data, clear)
        codes_before = np.cumsum(data) - data
        for j, (k, part) in enumerate(zip(live.tolist(), strings)):
            pieces[k].append(part)
            got[k] += len(part)
            if data[j] == len(schedule):
                head = slice(codes_before[j], codes_before[j] + data[j])
                starts = position[head] - position[head.start]
                while got[k] < most[k] and not closed[j] and (m := min(FOLLOWING, int(stop[k] - at[k]) // 12)):
                    more = codes_at(first[k], at[k] + 12 * np.arange(m), 12).astype(np.int64)
                    mark = np.flatnonzero((more == clear) | (more == clear + 1))
                    use = more[: mark[0]] if len(mark) else more
                    part = _pointed(strings[j], starts, length[head], use, clear)
                    pieces[k].append(part)
                    got[k] += len(part)
                    at[k] += 12 * (len(use) + bool(len(mark)))
                    if len(mark):
                        closed[j] = more[mark[0]] == clear
                        break
        live = live[closed & (got[live] < np.array(most)[live])]
    return [b"".join(p)[:m] for p, m in zip(pieces, most)]


def _pointed(head: bytes, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray, clear: int) -> bytes:
    """Samples of codes of a full table: an entry is the string of a code of the head and the sample behind it."""
    entry = np.maximum(codes - clear - 2, 0)
    literal = codes < clear
    source = np.frombuffer(head + bytes(range(256)), np.uint8)
    start, size = np.where(literal, len(head) + codes, starts[entry]), np.where(literal, 1, lengths[entry] + 1)
    owner, offset = _ragged(size)
    return source[start[owner] + offset].tobytes()


def _strings(code: np.ndarray, lengths: np.ndarray, clear: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Samples of stretches of codes with no clear code in them; where each code's samples begin, and how many they are."""
    owner, index = _ragged(lengths)
    begin = (np.cumsum(lengths) - lengths)[owner]
    literal = code < clear
    here = np.arange(len(code))
    parent = np.where(literal, here, np.minimum(begin + code - clear - 2, here))
    bad = ~literal & ((parent >= here) | (code < clear + 2))
    parent[bad] = here[bad]  # a code that no table has yet: one zero sample
    hops, depth = parent, (parent != here).astype(np.int64)
    while (further := hops[hops]) is not None and (further != hops).any():
        depth = depth + depth[hops]
        hops = further
    size = depth + 1
    position = np.cumsum(size) - size
    of, offset = _ragged(size)
    source = np.where((parent == here)[of], np.arange(len(of)), position[parent][of] + offset).astype(np.int32)
    open_ = np.flatnonzero(~(parent == here)[of]).astype(np.int32)
    while len(open_):
        now = source[open_]
        further = source[now]
        source[open_] = further
        open_ = open_[further != now]
    value = np.where(bad, 0, code).astype(np.uint8)
    samples = value[of[source]].tobytes()
    ends = np.cumsum(np.bincount(owner, size, len(lengths))).astype(np.int64).tolist()
    return [samples[a:b] for a, b in zip([0, *ends], ends)], position, size


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(payloads: list[bytes], width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> list[bytes]:
    """GIFs whose frames hold the payloads (positive multiples of ``width`` bytes) as grey samples."""
    frames = [[p[i : i + width * rows] for i in range(0, len(p), width * rows)] for p in payloads]
    streams = iter(lzw_pack(lzw_codes([f for own in frames for f in own])) if frames else ())
    out = []
    for own in frames:
        parts = [b"GIF89a", struct.pack("<HHBBB", width, len(own[0]) // width, 0xF7, 0, 0), _GREY]
        for samples in own:
            parts += [b"\x21\xf9\x04", struct.pack("<BHB", 0x04, delay_cs, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(samples) // width, 0), b"\x08", _blocks(next(streams))]
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def _chain(data: bytes, at: int) -> tuple[bytes, int]:
    """Joined sub-blocks from a place on, and the place behind them; a file that is cut off ends the chain."""
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _rows_of_passes(height: int) -> np.ndarray:
    """Which row each row of an interlaced frame is."""
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def parse(data: bytes) -> tuple[int, int, list[dict]]:
    """Width and height of a GIF's screen, and its frames with their code streams not yet decoded.

    Of a file that is cut off, the frames that it has: the last one with the part of its stream that is there.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, colours, frames = 13, None, []

    def palette(n: int) -> np.ndarray:
        return np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)

    if width * height > MOST_PIXELS:
        raise ValueError(f"a screen of {width} x {height}")
    if flags & 0x80:
        colours = palette(2 << (flags & 7))
        at += 3 * len(colours)
    control = {"delay_ms": 0, "transparent": None, "disposal": 0}
    state = dict(control)
    while at + 1 < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _chain(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                f, delay, index = struct.unpack_from("<BHB", body)
                state = {"delay_ms": 10 * delay, "transparent": index if f & 1 else None, "disposal": f >> 2 & 7}
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        if at + 10 > len(data):
            break
        left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > MOST_PIXELS:
            raise ValueError(f"a frame of {w} x {h}")
        at += 10
        own = colours
        if f & 0x80:
            own = palette(2 << (f & 7))
            at += 3 * len(own)
        if at >= len(data):
            break
        size = data[at]
        if not 2 <= size <= 8:
            raise ValueError(f"samples of {size} bits")
        stream, at = _chain(data, at + 1)
        frames.append({"box": (left, top, w, h), "palette": own, "interlaced": bool(f & 0x40), "size": size, "stream": stream, **state})
        state = dict(control)
    return width, height, frames


def show(width: int, height: int, frames: list[dict], samples: list[bytes]) -> Iterator[dict]:
    """Frames as they are shown: start_ms, delay_ms, box (left, top, width, height) and the canvas as RGBA."""
    canvas, clock = np.zeros((height, width, 4), np.uint8), 0
    for f, got in zip(frames, samples):
        left, top, w, h = f["box"]
        own = np.frombuffer(got + b"\0" * (w * h - len(got)), np.uint8).reshape(h, w)
        if f["interlaced"]:
            rows = np.empty_like(own)
            rows[_rows_of_passes(h)] = own
            own = rows
        before = canvas.copy() if f["disposal"] == 3 else None
        lut = np.zeros((256, 4), np.uint8)
        if f["palette"] is not None:
            lut[: len(f["palette"]), :3] = f["palette"]
        lut[:, 3] = 255
        box = canvas[top : top + h, left : left + w]
        own = own[: box.shape[0], : box.shape[1]]
        seen = slice(None) if f["transparent"] is None else own != f["transparent"]
        box[seen] = lut[own[seen]]
        yield {"start_ms": clock, "delay_ms": f["delay_ms"], "box": f["box"], "rgba": canvas.copy()}
        clock += f["delay_ms"]
        if f["disposal"] == 2:
            box[:] = 0
        elif f["disposal"] == 3:
            canvas = before


def decode(images: list[bytes]) -> Iterator[Iterator[dict]]:
    """The shown frames of each GIF; images are decoded together as far as they have ``PIXELS`` samples."""
    held, pixels = [], 0
    for image in map(parse, images):
        n = sum(f["box"][2] * f["box"][3] for f in image[2])
        if held and pixels + n > PIXELS:
            yield from _decoded(held)
            held, pixels = [], 0
        held.append(image)
        pixels += n
    yield from _decoded(held)


def _decoded(parsed: list[tuple[int, int, list[dict]]]) -> Iterator[Iterator[dict]]:
    wanted = [(i, k, f) for i, (_, _, frames) in enumerate(parsed) for k, f in enumerate(frames)]
    samples: list[list] = [[None] * len(frames) for _, _, frames in parsed]
    for size in sorted({f["size"] for _, _, f in wanted}):
        own, pixels = [], 0
        for i, k, f in [*(x for x in wanted if x[2]["size"] == size), (None, None, None)]:
            n = f["box"][2] * f["box"][3] if f else 0
            if own and (f is None or pixels + n > PIXELS):
                for (a, b, _), got in zip(own, lzw_decode([x["stream"] for _, _, x in own], size, [x["box"][2] * x["box"][3] for _, _, x in own])):
                    samples[a][b] = got
                own, pixels = [], 0
            own.append((i, k, f))
            pixels += n
    for (width, height, frames), got in zip(parsed, samples):
        yield show(width, height, frames, got)


def colour_histogram(rgba: np.ndarray) -> np.ndarray:
    """64 counts: two bits of each of red, green and blue, over what is not transparent."""
    flat = rgba.reshape(-1, 4)
    q = (flat[:, 0] >> 6 << 4) | (flat[:, 1] >> 6 << 2) | (flat[:, 2] >> 6)
    return np.bincount(q[flat[:, 3] > 0], minlength=64)


def pad(text: bytes) -> bytes:
    return text + b"\0" * (max(1, -(-len(text) // 64)) * 64 - len(text))


def encode_gifs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, payload_bytes and media (the GIF) of every row's text."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            raw = [x.encode("utf-8", "surrogatepass") for x in texts(b)]
            payloads = [pad(x) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([len(x) for x in payloads], pa.int64()), pa.array(encode(payloads), pa.binary())], names=names)

    return docs.selectExpr(f"cast(`{id_col}` AS long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def gif_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame: id, frame, start_ms, delay_ms, width, height, rgba, histogram, and error (null).

    What cannot be read has one row, with the error alone; null media have none.
    """
    ship(media.sparkSession)
    names = ["doc_id", "frame", "start_ms", "delay_ms", "width", "height", "rgba", "histogram", "error"]

    def trouble(image: bytes) -> str | None:
        try:
            parse(image)
        except ValueError as e:
            return str(e)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", 500_000):
            held = [(i, x, trouble(x)) for i, x in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()) if x is not None]
            if broken := [{"doc_id": i, "error": e} for i, _, e in held if e]:
                yield pa.RecordBatch.from_pylist(broken, schema=schema)
            held = [(i, x) for i, x, e in held if not e]
            for (doc_id, _), frames in zip(held, decode([x for _, x in held])):
                for k, f in enumerate(frames):
                    h, w = f["rgba"].shape[:2]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (doc_id, k, f["start_ms"], f["delay_ms"], w, h, f["rgba"].tobytes(), colour_histogram(f["rgba"]).tolist(), None)))], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
    return media.selectExpr(f"cast(`{id_col}` AS long) AS doc_id", f"`{media_col}` AS media").mapInArrow(run, "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, histogram array<long>, error string")


def read_samples(shown: Iterator[dict], payload_bytes: int) -> tuple[bytes, np.ndarray, int, int]:
    """What encode() stored, read from an image's shown frames; with the colour histogram, the frames and their time in ms."""
    parts, last = [], 0
    for f in shown:
        left, top, w, h = f["box"]
        parts.append(f["rgba"][top : top + h, left : left + w].reshape(-1, 4))
        last = f["start_ms"] + f["delay_ms"]
    rgba = np.concatenate(parts)
    return np.ascontiguousarray(rgba[:, 0]).tobytes()[:payload_bytes], colour_histogram(rgba), len(parts), last


def gif_features(media: DataFrame) -> DataFrame:
    """Digests and features of what ``encode_gifs`` stored, from the stored bytes."""
    ship(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "duration_ms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", 2_000_000):
            rows = []
            columns = [b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "payload_bytes", "media")]
            for doc_id, n, size, data, shown in zip(*columns, decode(columns[3])):
                payload, histogram, frames, last = read_samples(shown, size)
                feature = ",".join(f"{k}:{v}" for k, v in enumerate(histogram.tolist()) if v)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, frames, last))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, duration_ms long")
