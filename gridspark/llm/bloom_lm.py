"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are quantised to q = 1 + floor(log2(count)); an
n-gram is put into the filter q times, as (n-gram, 1) to (n-gram, q). A lookup probes (n-gram, 1), (n-gram, 2), ...
until a probe fails, which gives q back; a false positive must happen once for each step too far.
A word's probability after another is the pair's count smoothed by the word's own probability.

Counting: a task adds up its texts in sorted arrays of 64-bit hashes and sends them as blocks by hash range
(a few rows, not one for each n-gram). A range is merged in one task and turned into its own part of the
filter, ``BITS`` bits for each level of each n-gram: the filter holds all n-grams and grows with them. The
number of ranges grows with the bytes of the training texts (``RANGE_BYTES`` to a range), so that a range
stays small; it changes no score but by the filter's false positives. Of a pair's hash 48 bits are kept: two
of a billion pairs share one with a probability of 4 in a million, far less than the filter errs.

Scoring: no process holds the filter. Texts are stored in slices of about ``SLICE`` bytes. A slice sends its
distinct words and pairs, as blocks by hash range, to the task that holds the range's part of the filter and
the exact counts of its words, and gets back levels and counts in the same order; these meet the slice's texts
again in one task.

Defined cases: a null text is empty and has the end token alone; equal texts get equal scores; without
training texts all counts are 0; rows that repeat a doc_id are scored each on its own; rows without a doc_id
are not held out; an empty table gives no rows; other columns are not read. A text longer than a slice is a
slice of its own, scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, stored, texts

BITS, PROBES = 10, 6
#: Bytes of text whose distinct n-grams are looked up together.
SLICE = 16_000_000
#: Bytes of training text for each hash range.
RANGE_BYTES, MOST_RANGES = 4_000_000, 1 << 16
#: Weight of a word's own probability, in tokens.
PRIOR = 100.0
#: n-grams that a task holds before it sends them.
HELD = 3_000_000
_PAIR_BITS = np.uint64(0xFFFFFFFFFFFF0000)
_START, _END = np.uint64(0x5374617274), np.uint64(0x456E64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def tokens(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then the end token), and where each text begins."""
    import xxhash

    words = [x.encode("utf-8", "surrogatepass").lower().split() for x in batch_texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), _END)
    inner = np.ones(len(out), bool)
    inner[starts + sizes - 1] = False
    out[inner] = np.fromiter((h for own in words for h in map(xxhash.xxh3_64_intdigest, own)), np.uint64, len(out) - len(words))
    return out, starts


def pairs(token: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token's pair with the one before it, and the one before it."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[starts] = _START
    with np.errstate(over="ignore"):
        return _mix(before * _A + token) & _PAIR_BITS, before


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with their summed counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def packed(keys: np.ndarray) -> bytes:
    """Ascending hashes as the first one and gaps of as few bytes as the largest gap needs."""
    gaps, shift = np.diff(keys), 0
    if len(gaps) and not (gaps & ~_PAIR_BITS).any():
        gaps, shift = gaps >> np.uint64(16), 16
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return bytes([width | shift]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(block: bytes) -> np.ndarray:
    width, shift = block[0] & 15, block[0] & 16
    gaps = np.frombuffer(block, np.uint8, offset=9).reshape(-1, width)
    keys = np.zeros((len(gaps) + 1, 8), np.uint8)
    keys[1:, :width] = gaps
    keys = keys.view("<u8").ravel() << np.uint64(shift)
    keys[0] = np.frombuffer(block, "<u8", 1, 1)[0]
    return np.cumsum(keys, dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, and eight more behind them for each that is 255 or more."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpacked_counts(block: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(block, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(block, "<u8", -1, n)
    return counts


def _by_range(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """Ranges that ascending hashes fall into, and where each lies."""
    at = np.searchsorted(keys >> np.uint64(64 - int(math.log2(ranges))), np.arange(ranges + 1, dtype=np.uint64)).tolist()
    return ((k, slice(at[k], at[k + 1])) for k in range(ranges) if at[k + 1] > at[k])


def count_blocks(docs: DataFrame, ranges: int) -> DataFrame:
    """Blocks (kind, range, hashes, counts): kind 1 words, 2 pairs; a range is the top bits of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if not parts:
                    continue
                keys, counts = _merged(parts)
                if own := list(_by_range(keys, ranges)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(own), pa.int32()), pa.array([k for k, _ in own], pa.int32()), pa.array([packed(keys[x]) for _, x in own], pa.binary()), pa.array([packed_counts(counts[x]) for _, x in own], pa.binary())],
                        names=["kind", "range", "hashes", "counts"],
                    )
                held[kind] = []

        for b in slices(batches, "text"):
            token, starts = tokens(texts(b))
            held[2].append(np.unique(pairs(token, starts)[0], return_counts=True))
            ends = np.append(starts[1:], len(token)) - 1
            held[1].append(np.unique(np.delete(token, ends), return_counts=True))
            if sum(len(x) for x, _ in held[2]) > HELD:
                held[2] = [_merged(held[2])]
                held[1] = [_merged(held[1])]
                if len(held[2][0][0]) > HELD // 2:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "kind int, range int, hashes binary, counts binary")


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1.0) - 0.5, 0.0)


def _probe(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        y = _mix(x + np.uint64(level) * _A)
    return y & np.uint64(0xFFFFFFFF), (y >> np.uint64(32)) | np.uint64(1)


def _places(low: np.ndarray, high: np.ndarray, k: int, bits) -> np.ndarray:
    return ((low + np.uint64(k) * high) & np.uint64(0xFFFFFFFF)) * bits >> np.uint64(32)


def filter_part(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Part of the filter for one range, with all its n-grams."""
    level = levels_of(counts)
    bits = max(64, -(-int(level.sum()) * BITS // 64) * 64)
    held = np.zeros(bits, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        low, high = _probe(keys[level >= j], j)
        for k in range(PROBES):
            held[_places(low, high, k, np.uint64(bits))] = 1
    return np.packbits(held, bitorder="little").tobytes()


class LogFrequencyFilter:
    """The filter's parts, by kind and range."""

    def __init__(self, sizes: dict[tuple[int, int], int], ranges: int):
        """sizes: bytes of each part, by kind and range; ``put`` fills them in."""
        self.shift, self.ranges = np.uint64(64 - int(math.log2(ranges))), ranges
        self.first = np.zeros(3 * ranges, np.int64)
        self.bits = np.full(3 * ranges, 64, np.uint64)
        at = 8  # the first 64 bits stay empty, for what has no part
        for (kind, r), n in sizes.items():
            self.first[kind * ranges + r], self.bits[kind * ranges + r] = at, n * 8
            at += n
        self.data = np.zeros(at, np.uint8)

    def put(self, kind: int, r: int, part: bytes) -> None:
        at = self.first[kind * self.ranges + r]
        self.data[at : at + len(part)] = np.frombuffer(part, np.uint8)

    def levels(self, x: np.ndarray, kind: int) -> np.ndarray:
        """The level of each n-gram, 0 where it is not held."""
        part = kind * self.ranges + (x >> self.shift).astype(np.int64)
        first, bits = self.first[part], self.bits[part]
        out, live, level = np.zeros(len(x), np.int64), np.arange(len(x)), 1
        while len(live):
            low, high = _probe(x[live], level)
            for k in range(PROBES):
                place = _places(low, high, k, bits[live])
                hit = self.data[first[live] + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
                live, low, high = live[hit], low[hit], high[hit]
            out[live] = level
            level += 1
        return out


def _reduce(key: tuple, group: pa.Table) -> pa.Table:
    """Merging of one range."""
    kind, r = (k.as_py() for k in key)
    blocks = [unpacked(h) for h in group.column("hashes").to_pylist()]
    keys, counts = _merged([(h, unpacked_counts(c, len(h))) for h, c in zip(blocks, group.column("counts").to_pylist())])
    words = kind == 1
    return pa.table({"kind": pa.array([kind], pa.int32()), "range": pa.array([r], pa.int32()), "n_distinct": [len(keys)], "n_total": [int(counts.sum())], "part": pa.array([filter_part(keys, counts)], pa.binary()), "hashes": pa.array([packed(keys) if words else None], pa.binary()), "counts": pa.array([packed_counts(counts) if words else None], pa.binary())})


def train(docs: DataFrame) -> DataFrame:
    """The stored model: a row for each kind and range."""
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(6, math.ceil(math.log2(min(MOST_RANGES, max(1, size / RANGE_BYTES)))))
    model = count_blocks(docs, ranges).groupBy("kind", "range").applyInArrow(_reduce, "kind int, range int, n_distinct long, n_total long, part binary, hashes binary, counts binary")
    return stored(model.withColumn("ranges", F.lit(ranges)), "language-model")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a number of their own and the number of their slice, which is that of its first row."""
    row = TaskContext.get().partitionId() << 40
    for b in slices(batches, "__text", SLICE):
        rows = pa.array(np.arange(row, row + b.num_rows))
        yield pa.RecordBatch.from_arrays([rows, pa.array(np.full(b.num_rows, row)), *b.columns], names=["__row", "__slice", *b.schema.names])
        row += b.num_rows


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one slice that follow each other: whole slices, but where Spark has cut one between tasks."""
    held, own = [], None
    for b in batches:
        numbers = b.column("__slice").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]]).tolist()
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            if held and numbers[i] != own:
                yield pa.Table.from_batches(held)
                held = []
            own = numbers[i]
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _tokens_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of many rows, some at a time."""
    token, starts, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for b in slices(rows.to_batches(), "__text", 2_000_000):
        own, first = tokens(texts(b, "__text"))
        token.append(own)
        starts.append(first + n)
        n += len(own)
    return np.concatenate(token), np.concatenate(starts)


def _questions(texts_of: DataFrame, ranges: int) -> DataFrame:
    """Blocks (slice, first, kind, range, hashes): distinct words and pairs of the rows of a slice from ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            token, starts = _tokens_of(rows)
            number, first = rows.column("__slice")[0].as_py(), rows.column("__row")[0].as_py()
            for kind, x in ((1, token), (2, pairs(token, starts)[0])):
                keys = np.unique(x)
                own = list(_by_range(keys, ranges))
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int64()), pa.array([first] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([k for k, _ in own], pa.int32()), pa.array([packed(keys[x]) for _, x in own], pa.binary())],
                    names=["slice", "first", "kind", "range", "hashes"],
                )

    return texts_of.mapInArrow(run, "slice long, first long, kind int, range int, hashes binary")


def _answers(ranges: int):
    """Levels, and exact counts of words, of the hashes of one range's blocks."""

    def run(key: tuple, asked: pa.Table, model: pa.Table) -> pa.Table:
        kind, r = (k.as_py() for k in key)
        known = counts = np.zeros(0, np.uint64)
        held = None
        if asked.num_rows and model.num_rows:
            part = model.column("part")[0].as_py()
            held = LogFrequencyFilter({(kind, r): len(part)}, ranges)
            held.put(kind, r, part)
            if kind == 1:
                known = unpacked(model.column("hashes")[0].as_py())
                counts = unpacked_counts(model.column("counts")[0].as_py(), len(known))
        levels, exact = [], []
        for block in asked.column("hashes").to_pylist():
            x = unpacked(block)
            levels.append((held.levels(x, kind) if held else np.zeros(len(x), np.int64)).astype(np.uint8).tobytes())
            found = np.zeros(len(x), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                found = np.where(known[at] == x, counts[at], 0)
            exact.append(found.astype("<i8").tobytes() if kind == 1 else None)
        return pa.table({**{c: asked.column(c) for c in ("slice", "first", "kind", "range")}, "levels": pa.array(levels, pa.binary()), "counts": pa.array(exact, pa.binary())})

    return run


def _scores(columns: list[str], total: int, distinct: int, train_docs: int):
    """Scores of the rows of one slice."""

    def scored(rows: pa.Table, answer: dict) -> list[np.ndarray]:
        token, starts = _tokens_of(rows)
        pair, _ = pairs(token, starts)
        unique, inverse = np.unique(token, return_inverse=True)
        unique_pairs, inverse_pairs = np.unique(pair, return_inverse=True)
        levels, exact, pair_levels = np.frombuffer(b"".join(answer[1, "levels"]), np.uint8), np.frombuffer(b"".join(answer[1, "counts"]), "<i8").copy(), np.frombuffer(b"".join(answer[2, "levels"]), np.uint8)
        if len(levels) != len(unique) or len(pair_levels) != len(unique_pairs):
            raise ValueError("answers do not fit the texts of a slice")
        counted = count_of(levels.astype(np.float64))
        counted[unique == _END] = train_docs
        exact[unique == _END] = train_docs
        own = counted[inverse]
        history = np.empty(len(token))
        history[1:] = own[:-1]
        history[starts] = train_docs
        alone = (own + 1) / (total + distinct + 1)
        seen = np.minimum(count_of(pair_levels.astype(np.float64))[inverse_pairs], np.minimum(own, history))
        logs = np.log10((seen + PRIOR * alone) / (history + PRIOR))
        sizes = np.diff(np.append(starts, len(token)))
        base = np.add.reduceat(np.log10(exact + 1.0)[inverse], starts) - sizes * math.log10(total + distinct + 1)
        return [sizes, np.add.reduceat((exact > 0).astype(np.int64)[inverse], starts), base, np.add.reduceat(logs, starts)]

    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers = rows.sort_by("__row"), answers.sort_by([("first", "ascending"), ("kind", "ascending"), ("range", "ascending")])
        number = rows.column("__row").to_numpy()
        by_run: dict[int, dict] = {}
        for first, kind, levels, counts in zip(*(answers.column(c).to_pylist() for c in ("first", "kind", "levels", "counts"))):
            own = by_run.setdefault(first, {(1, "levels"): [], (1, "counts"): [], (2, "levels"): []})
            own[kind, "levels"].append(levels)
            if kind == 1:
                own[1, "counts"].append(counts)
        cuts = np.append(np.searchsorted(number, list(by_run)), len(number)).tolist()
        found = [scored(rows.slice(i, j - i), answer) for i, j, answer in zip(cuts[:-1], cuts[1:], by_run.values())]
        sizes, known, base, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({**{c: rows.column(c) for c in columns}, "n_tokens": sizes, "n_known": known, "train_tokens": np.full(len(sizes), total), "base_score": base, "score": score})

    return run


def score(docs: DataFrame, model: DataFrame, train_docs: int, columns: list[str]) -> DataFrame:
    """The named columns, n_tokens, n_known, train_tokens, base_score and score of every row."""
    ship(docs.sparkSession)
    parts = model.select("kind", "ranges", "n_distinct", "n_total").where("kind = 1").collect()
    total = sum(r["n_total"] for r in parts) + train_docs
    distinct = sum(r["n_distinct"] for r in parts) + (train_docs > 0)
    ranges = parts[0]["ranges"] if parts else 1 << 6
    keep = docs.select(*columns, F.col("text").alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema]
    sliced = stored(keep.mapInArrow(_sliced, ", ".join(["__row long, __slice long", *kinds])), "slices")
    asked = _questions(sliced.select("__row", "__slice", "__text"), ranges)
    answers = asked.groupBy("kind", "range").cogroup(model.select("kind", "range", "part", "hashes", "counts").groupBy("kind", "range")).applyInArrow(_answers(ranges), "slice long, first long, kind int, range int, levels binary, counts binary")
    out = ", ".join([*kinds[:-1], "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return sliced.groupBy("__slice").cogroup(answers.groupBy("slice")).applyInArrow(_scores(columns, total, distinct, train_docs), out)


def language_model(docs: DataFrame, parts: int = 7, held_out: int = 2) -> DataFrame:
    """Scores of every document; learns from rows that are not held out."""
    rows = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held_out, F.lit(False)).alias("held_out"))
    learnt = rows.where(~F.col("held_out"))
    model = train(learnt)
    return score(rows, model, learnt.count(), ["doc_id", "held_out"])
