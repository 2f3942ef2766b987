"""Best-fit packing of token sequences by linear grouping.

Lengths are integers up to the capacity, so a histogram of at most ``capacity`` rows says all that a
packing needs to know; it alone reaches the driver, whatever the size of the corpus.

1. Large pieces, in order of length, are cut into groups of equal cardinality and rounded up to the longest
   of their group. Few sizes remain; configurations (multisets of sizes within the capacity) are made for
   them one after another, each the fullest that still holds the largest size left, and used as often as
   the counts allow. Of several numbers of groups, up to one for each length, and of best fit alone for all
   pieces, the one that needs the fewest sequences is taken: all of them are counted out on the histogram, so
   the result is never worse than best-fit decreasing.
2. Actual pieces are substituted by their rank: the rank of a piece among all large ones gives its sequence
   by a lookup in the configurations, on the executors.
3. What each sequence really has left is summed up, and the small pieces go, longest first, to the
   sequences with the least room that holds them; again the driver sees counts by room only. A piece finds
   its sequence by (room, rank of the sequence among those with that room).

Ranks come from counts by (length, salt) and a window within each such part, so that a length which a third
of all pieces share is no hot group.

Defined cases: a null text is empty and is one piece with the end id alone; equal rows, or rows that repeat
a doc_id, are packed each on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ship, slices, stored, texts
from .encoding import WordIds

CAPACITY = 2048
#: Pieces over capacity / SMALL are large.
SMALL = 8
GROUPS = 256
#: Parts of a hot length or room: so many at least, and one for so many rows.
SALTS, SALTED_ROWS = 64, 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document's ids (with the end id); only documents over the capacity are cut."""
    ship(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(tokenizer_path)
        for b in slices(batches, "text"):
            rows = []
            for doc_id, x in zip(b.column("doc_id").to_pylist(), texts(b)):
                raw = ids_of(x) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    rows.append((doc_id, k, k * capacity, len(own) // 4, zlib.crc32(own)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, PIECES)


def ranked(df: DataFrame, key: str, order: list[str], total: int) -> DataFrame:
    """df (of ``total`` rows) with ``rank``: 0, 1, ... within each value of key, in no particular order between salts."""
    salts = max(SALTS, total // SALTED_ROWS)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(key, "__salt").count()
    before = F.sum("count").over(Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(key, "__salt", F.coalesce(before, F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*order)) - 1
    return salted.withColumn("__within", within).join(bases, [key, "__salt"]).withColumn("rank", F.col("__base") + F.col("__within")).drop("__salt", "__base", "__within")


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {group: how many}) that use up all counts; sizes ascend."""
    left, plan = list(counts), []
    top = len(sizes) - 1
    while True:
        while top >= 0 and not left[top]:
            top -= 1
        if top < 0:
            return plan
        room = capacity - sizes[top]
        # sums that can be reached, as bits, after each group from the largest down
        reach, stages, full = 1, [], (1 << room + 1) - 1
        for g in range(top, -1, -1):
            spare = left[g] - (g == top)
            if spare <= 0 or sizes[g] > room:
                continue
            now = reach
            for _ in range(min(spare, room // sizes[g])):
                grown = now | (now << sizes[g] & full)
                if grown == now:
                    break
                now = grown
            if now != reach:
                stages.append((g, reach))
                reach = now
            if reach >> room & 1:
                break
        used: dict[int, int] = defaultdict(int)
        used[top] = 1
        total = reach.bit_length() - 1
        for g, before in reversed(stages):
            while not before >> total & 1:
                used[g] += 1
                total -= sizes[g]
        times = min(left[g] // k for g, k in used.items())
        for g, k in used.items():
            left[g] -= times * k
        plan.append((times, dict(used)))


def _groups(histogram: list[tuple[int, int]], groups: int | None) -> list[list[int]]:
    """[size, count] of groups of equal cardinality, sizes rounded up to the longest; None: a group for each length."""
    if groups is None:
        return [[x, n] for x, n in histogram]
    total = sum(n for _, n in histogram)
    lengths = np.array([x for x, _ in histogram])
    ends = np.cumsum([n for _, n in histogram])
    edges = np.unique(np.linspace(0, total, min(groups, total) + 1).astype(np.int64))
    merged: list[list[int]] = []  # groups of one size are one
    for size, n in zip(lengths[np.searchsorted(ends, edges[1:] - 1, "right")].tolist(), np.diff(edges).tolist()):
        if merged and merged[-1][0] == size:
            merged[-1][1] += n
        else:
            merged.append([size, n])
    return merged


def _rooms(histogram: list[tuple[int, int]], ends: np.ndarray, uses: list[tuple[int, int]], times: int, capacity: int, rooms: dict[int, int]) -> None:
    """Adds up what the sequences of a configuration have left; uses: (first place, pieces a sequence).

    The lengths of a group's pieces change at few places, between which all sequences have the same room.
    """
    cuts = {0, times}
    for first, k in uses:
        for end in ends[np.searchsorted(ends, first, "right") : np.searchsorted(ends, first + k * times)].tolist():
            cuts |= {(end - first) // k, min(times, (end - first) // k + 1)}
    order = sorted(cuts)
    for a, b in zip(order[:-1], order[1:]):
        places = np.array([first + k * a + j for first, k in uses for j in range(k)])
        held = sum(histogram[i][0] for i in np.searchsorted(ends, places, "right").tolist())
        rooms[capacity - held] += b - a


def plan_large(histogram: list[tuple[int, int]], capacity: int, groups: int | None) -> tuple[np.ndarray, int, dict[int, int]]:
    """Rows (first place, pieces a sequence, first sequence) by place among all large pieces; number of sequences; rooms.

    histogram: (length, count), ascending. A piece's place is the count of shorter ones and its rank.
    """
    merged = _groups(histogram, groups)
    ends = np.cumsum([n for _, n in histogram])
    at = np.concatenate([[0], np.cumsum([n for _, n in merged])]).tolist()
    rows, sequence, rooms = [], 0, defaultdict(int)
    for times, used in configurations([s for s, _ in merged], [n for _, n in merged], capacity):
        _rooms(histogram, ends, [(at[g], k) for g, k in used.items()], times, capacity, rooms)
        for g, k in used.items():
            rows.append((at[g], k, sequence))
            at[g] += times * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 3), sequence, dict(rooms)


def plan(histogram: list[tuple[int, int]], capacity: int, groups: int) -> tuple[int, np.ndarray, int, int]:
    """Longest small length, rows and number of sequences of the large pieces, and number of all sequences."""
    border = capacity // SMALL
    small, large = [h for h in histogram if h[0] <= border], [h for h in histogram if h[0] > border]
    tried = []
    for n in (groups, 4 * groups, None) if large else ():
        rows, sequences, rooms = plan_large(large, capacity, n)
        tried.append((border, rows, sequences, sequences + plan_small(small, sorted(rooms.items()), capacity)[1]))
    tried.append((capacity, np.zeros((0, 3), np.int64), 0, plan_small(histogram, [], capacity)[1]))
    return min(tried, key=lambda t: t[3])


def plan_small(histogram: list[tuple[int, int]], rooms: list[tuple[int, int]], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (first place, room, first rank) by place among all small pieces; number of new sequences (room -1).

    histogram: (length, count), ascending; rooms: (room, number of sequences).
    """
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # by room now: (room first, rank from, to)
    some = 0
    for room, n in rooms:
        if room:
            held[room].append((room, 0, n))
            some |= 1 << room
    first = dict(zip([x for x, _ in histogram], np.concatenate([[0], np.cumsum([n for _, n in histogram])]).tolist()))
    rows, new = [], 0
    for length, n in reversed(histogram):
        at = first[length]
        while n:
            fitting = some >> length
            if not fitting:
                more = -(-n // (capacity // length))
                held[capacity].append((-1, new, new + more))
                some |= 1 << capacity
                new += more
                continue
            room = length + (fitting & -fitting).bit_length() - 1
            origin, a, b = held[room].pop()
            m = min(n, b - a)
            if m < b - a:
                held[room].append((origin, a + m, b))
            if not held[room]:
                some &= ~(1 << room)
            rows.append((at, origin, a))
            if room > length:
                held[room - length].append((origin, a, a + m))
                some |= 1 << room - length
            at, n = at + m, n - m
    return np.array(sorted(rows), np.int64).reshape(-1, 3), new


def _looked_up(df: DataFrame, plan: np.ndarray, before: dict[int, int], names: list[str], value) -> DataFrame:
    """df with the named long columns: value(place - first place, plan row) at each row's place."""
    sent = df.sparkSession.sparkContext.broadcast((plan, np.array(sorted(before.items()), np.int64).reshape(-1, 2)))
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, firsts = sent.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            place = firsts[np.searchsorted(firsts[:, 0], length), 1] + rank
            at = np.searchsorted(rows[:, 0], place, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in value(place - rows[at, 0], rows[at]))], names=[*kept, *names])

    schema = StructType([*df.schema.fields, *(StructField(n, LongType()) for n in names)])
    return df.mapInArrow(run, schema)


def _before(histogram: list[tuple[int, int]]) -> dict[int, int]:
    return dict(zip([x for x, _ in histogram], np.concatenate([[0], np.cumsum([n for _, n in histogram])]).tolist()))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces (stored; with doc_id, piece, length and ids_crc32) with sequence_id and offset."""
    ids = ["doc_id", "piece", "ids_crc32"]
    histogram = sorted((r[0], r[1]) for r in pieces.groupBy("length").count().collect())  # capacity rows at most
    border, rows, sequences, _ = plan(histogram, capacity, groups)
    small, large = [h for h in histogram if h[0] <= border], [h for h in histogram if h[0] > border]
    sort = ranked(pieces, "length", ids, sum(n for _, n in histogram))
    placed = _looked_up(sort.where(F.col("length") > border), rows, _before(large), ["sequence_id"], lambda past, row: [row[:, 2] + past // row[:, 1]]).drop("rank")
    if small:
        placed = stored(placed, "packed")
        filled = placed.groupBy("sequence_id").agg((capacity - F.sum("length")).alias("room"))
        filled = stored(ranked(filled, "room", ["sequence_id"], sequences), "rooms")
        rooms = sorted((r[0], r[1]) for r in filled.groupBy("room").count().collect())
        fill, _ = plan_small(small, rooms, capacity)
        rest = sort.where(F.col("length") <= border)
        rest = _looked_up(rest, fill, _before(small), ["room", "bin"], lambda past, row: [row[:, 1], row[:, 2] + past]).drop("rank")
        rest = rest.join(filled.select("room", F.col("rank").alias("bin"), "sequence_id"), ["room", "bin"], "left")
        placed = placed.unionByName(rest.withColumn("sequence_id", F.coalesce("sequence_id", F.col("bin") + sequences)).drop("room", "bin"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *ids).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = stored(cut_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    return pack(pieces, capacity, groups).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
