"""Benchmark decontamination: edit-similar passages by CGK embedding and bit sampling.

Texts and items are sequences of words (letters and digits, lower case; in scripts without spaces, characters). The CGK random walk reads a
sequence by a pointer: step j writes the word under it and moves on if a random bit of (j, word) says so.
Walks of sequences at a small edit distance meet again after an edit, so the edit distance becomes a
Hamming distance of what was written. Locality-sensitive functions sample a few of the steps; windows that
agree in all steps of one function are candidates. A candidate whose walks agree in enough steps is then
verified by the exact edit distance between the whole item and the best stretch of the text around it.

Windows begin at every word of a text, and at every word of an item that leaves room for a window, so that
an edit at an item's begin spoils only the windows over it. Windows have ``SIZE`` words. Two walks with four
functions each take a window of twelve words with three edits with a probability of about 0.8; an item of
``SHORT`` words or more has seven windows at least.

Items of fewer than ``SHORT`` words have too few windows for that and are found without chance: an item that
allows e edits is cut into e + 1 pieces, of which e edits leave one as it is. Where a text has a piece word
for word, the item is verified.

Of the steps of a function the first ones lie early in the walk: what fails there needs no further step.

The items are the query set. They are taken in blocks of about ``BLOCK`` items and ``BLOCK_BYTES`` of text, each
broadcast and held against all texts; there is no join of all pairs.

Defined cases: null or empty texts, and items without words, have no windows; items of fewer than five words
allow no edit and are found word for word; rows that repeat a doc_id or an item_id give one row for the pair,
and rows without one count as one document or item; empty tables give no rows; very long texts are read whole;
other columns are not read by ``find_leaks``, and passed on as they are by ``without_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, stored, texts, widened

SIZE = 12
#: Items of fewer words are found by their pieces.
SHORT = 18
SIMILARITY = 0.8
BLOCK, BLOCK_BYTES = 5_000, 8_000_000
WALKS = 2
#: Steps that a function samples: those of the first walk, then those of the second.
_SAMPLED = (((0, 3, 9, 14), (1, 5, 11, 17), (2, 7, 10, 19), (3, 6, 13, 21)), ((0, 4, 8, 15), (1, 6, 12, 18), (2, 5, 9, 20), (3, 8, 14, 22)))
_EARLY = 4
#: Share of the steps of two walks that must agree before the exact distance is computed.
AGREE = 0.25
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEED = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)


#: Characters of scripts without spaces: Thai to Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(text: str) -> list[bytes]:
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _hashes(words: list[list[bytes]], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, each followed by ``gap`` zeros; where each begins; number of words."""
    import xxhash

    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + gap) - sizes - gap
    out = np.zeros(int((sizes + gap).sum()), np.uint64)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out[at] = np.fromiter((h for own in words for h in map(xxhash.xxh3_64_intdigest, own)), np.uint64, len(at))
    return out, starts, sizes


def _bits(word: np.ndarray, walk: int) -> np.ndarray:
    """64 random bits for each word, one for each step of a walk."""
    with np.errstate(over="ignore"):
        x = (word ^ _SEED[walk]) * _MIX
        x = (x ^ (x >> np.uint64(31))) * _MIX
        return x ^ (x >> np.uint64(29))


def _stepped(bits: np.ndarray, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Pointers after the steps from first to last (not included)."""
    for j in range(first, last):
        at = at + (bits[at] >> np.uint64(j) & np.uint64(1)).astype(np.int64)
    return at


def _joined(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (key ^ word) * _MIX
        return x ^ (x >> np.uint64(32))


def embed(word: np.ndarray, at: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """What each walk from a place writes: [place, step]."""
    bits, out = _bits(word, walk), np.empty((len(at), steps), np.uint64)
    for j in range(steps):
        out[:, j] = word[at]
        at = _stepped(bits, at, j, j + 1)
    return out


def _seen(key: np.ndarray) -> np.ndarray:
    """Which values the top 20 bits of some keys have, as packed bits."""
    seen = np.zeros(1 << 20, bool)
    seen[(key >> np.uint64(44)).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little")


def _may_hold(seen: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the keys whose top 20 bits have been seen."""
    top = key >> np.uint64(44)
    return np.flatnonzero(seen[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1)


class ItemIndex:
    """Item windows, by the keys of each function."""

    def __init__(self, size: int, items: list[tuple[int, list[bytes]]]):
        self.size, self.steps, self.items = size, 2 * size, [i for i, _ in items]
        gap = self.steps + 2
        self.word, self.start, self.length = _hashes([w for _, w in items], gap)
        self.owner = np.repeat(np.arange(len(items)), self.length - size + 1)
        first = np.cumsum(self.length - size + 1) - (self.length - size + 1)
        self.offset = np.arange(len(self.owner)) - first[self.owner]
        place = self.start[self.owner] + self.offset
        self.written = [embed(self.word, place, w, self.steps) for w in range(WALKS)]
        self.functions = []
        for w in range(WALKS):
            for steps in _SAMPLED[w]:
                key, prefixes = np.zeros(len(place), np.uint64), []
                for j in steps:
                    key = _joined(key, self.written[w][:, j])
                    prefixes.append(_seen(key))
                order = np.argsort(key, kind="stable")
                self.functions.append((w, steps, prefixes, key[order], order))

    def candidates(self, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the texts, window of an item) pairs that share a function's key and agree in enough steps."""
        found = []
        for w in range(WALKS):
            bits, early, pairs = _bits(word, w), [at], []
            for j in range(_EARLY - 1):
                early.append(_stepped(bits, early[-1], j, j + 1))
            for walk, steps, prefixes, keys, order in self.functions:
                if walk != w:
                    continue
                live, pointer, key, done = None, early[min(steps[0], _EARLY - 1)], np.uint64(0), min(steps[0], _EARLY - 1)
                for j, seen in zip(steps, prefixes):
                    pointer = _stepped(bits, pointer, done, j)
                    done = j
                    key = _joined(key, word[pointer])
                    ok = _may_hold(seen, key)
                    live, pointer, key = ok if live is None else live[ok], pointer[ok], key[ok]
                left, right = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = right - left
                rank = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(np.stack([np.repeat(live, n), order[np.repeat(left, n) + rank]]))
            pair = np.unique(np.concatenate(pairs, axis=1), axis=1)
            if pair.shape[1]:
                places, back = np.unique(pair[0], return_inverse=True)
                same = embed(word, at[places], w, self.steps)[back] == self.written[w][pair[1]]
                found.append(pair[:, same.mean(1) >= AGREE])
        pair = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return at[pair[0]], pair[1]


class PieceIndex:
    """Pieces of short items, by the words in them; one piece more than an item may have edits."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float):
        self.items = [i for i, _ in items]
        self.word, self.start, self.length = _hashes([w for _, w in items], 1)
        owner, offset, size = [], [], []
        for k, n in enumerate(self.length.tolist()):
            pieces = min(n, int((1 - similarity) * n + 1e-9) + 1)
            cuts = [n * j // pieces for j in range(pieces + 1)]
            owner += [k] * pieces
            offset += cuts[:-1]
            size += [y - x for x, y in zip(cuts[:-1], cuts[1:])]
        self.owner, self.offset, sizes = (np.array(x, np.int64) for x in (owner, offset, size))
        self.pieces = []
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            key = self._keys(self.word, self.start[self.owner[own]] + self.offset[own], n)
            order = np.argsort(key, kind="stable")
            self.pieces.append((n, _seen(key), key[order], own[order]))

    @staticmethod
    def _keys(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        key = np.zeros(len(at), np.uint64)
        for j in range(n):
            key = _joined(key, word[at + j])
        return key

    def candidates(self, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the texts, piece of an item) pairs of the same words."""
        places, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, seen, keys, own in self.pieces:
            key = self._keys(word, at, n)
            live = _may_hold(seen, key)
            left, right = np.searchsorted(keys, key[live], "left"), np.searchsorted(keys, key[live], "right")
            many = right - left
            rank = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            places.append(np.repeat(at[live], many))
            pieces.append(own[np.repeat(left, many) + rank])
        return np.concatenate(places), np.concatenate(pieces)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and any stretch of the text, and where the stretch ends."""
    along = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)  # a stretch may begin anywhere
    for k, w in enumerate(item):
        now = np.empty_like(row)
        now[0] = k + 1
        now[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(now - along) + along
    end = int(row.argmin())
    return int(row[end]), end


def verify(index: ItemIndex | PieceIndex, word: np.ndarray, begins: np.ndarray, sizes: np.ndarray, places: np.ndarray, window: np.ndarray, similarity: float) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) -> (distance, first word of the stretch around it), of what is similar enough."""
    text = np.searchsorted(begins, places, "right") - 1
    item = index.owner[window]
    head = places - begins[text] - index.offset[window]  # where the item would begin
    slack = np.ceil(index.length * (1 - similarity)).astype(np.int64) + 1
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if (fixed := index.length[item] * (1 - similarity) + 1e-9 < 1).any():  # no edit is allowed
        t, i, at = text[fixed], item[fixed], begins[text[fixed]] + head[fixed]
        same = (head[fixed] >= 0) & (head[fixed] + index.length[i] <= sizes[t])
        for k in range(int(index.length[i].max())):
            inside = same & (k < index.length[i])
            same[inside] &= word[at[inside] + k] == index.word[index.start[i[inside]] + k]
        best = {pair: (0, 0) for pair in set(zip(t[same].tolist(), i[same].tolist()))}
        text, item, head = text[~fixed], item[~fixed], head[~fixed]
    order = np.lexsort((head, item, text))
    text, item, head = text[order], item[order], head[order]
    new = np.ones(len(text), bool)  # neighbouring heads have the same stretch
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (head[1:] - head[:-1] > 1)
    groups = np.append(np.flatnonzero(new), len(text))
    for a, b in zip(groups[:-1].tolist(), groups[1:].tolist()):
        t, i = int(text[a]), int(item[a])
        n, s = int(index.length[i]), int(slack[i])
        low, high = max(0, int(head[a]) - s), min(int(sizes[t]), int(head[b - 1]) + n + s)
        own = index.word[index.start[i] : index.start[i] + n]
        distance, _ = edit_distance(own, word[begins[t] + low : begins[t] + high])
        if distance <= (1 - similarity) * n + 1e-9 and distance < best.get((t, i), (n + 1, 0))[0]:
            best[t, i] = (distance, low)
    return best


def _blocks(benchmark: DataFrame, similarity: float, block: int, block_bytes: int) -> Iterator[list]:
    """Indexes of the items, a block at a time."""
    items = stored(benchmark.where("text IS NOT NULL").select("item_id", "text").distinct(), "items")
    count, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // block), -(-(size or 0) // block_bytes))
    own = items.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        split = [(r["item_id"], words_of(r["text"])) for r in own.where(F.col("b") == k).collect()]
        long, short = [x for x in split if len(x[1]) >= SHORT], [x for x in split if 0 < len(x[1]) < SHORT]
        yield [ItemIndex(SIZE, long)] * bool(long) + [PieceIndex(short, similarity)] * bool(short)


def _found(indexes: list, batch: pa.RecordBatch, similarity: float) -> Iterator[tuple]:
    """(row of the batch, item_id, distance, words of the item) of each passage."""
    word, begins, sizes = _hashes([words_of(x) for x in texts(batch)], 2 * SIZE + 2)
    at = np.flatnonzero(word)
    for index in indexes:
        for (t, i), (distance, _) in verify(index, word, begins, sizes, *index.candidates(word, at), similarity).items():
            yield t, index.items[i], distance, int(index.length[i])


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance (in words), similarity and n_words of the item, for each contaminated pair."""
    spark = docs.sparkSession
    ship(spark)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32()]
    found = []
    for indexes in _blocks(benchmark, similarity, block, block_bytes):
        sent = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 3_000_000):
                doc_ids = b.column("doc_id").to_pylist()
                rows = [(doc_ids[t], item, distance, 1 - distance / n, n) for t, item, distance, n in _found(sent.value, b, similarity)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "distance", "similarity", "n_words"])

        found.append(docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance int, similarity double, n_words int"))
        if len(found) > 1:  # one block's index at a time
            found = [stored(found[0].unionByName(found[1]), "leaks")]
    return found[0].groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("similarity").alias("similarity"), F.max("n_words").alias("n_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, as they are, whose text has no passage of an item. Each row stands for itself, whatever its doc_id."""
    spark = docs.sparkSession
    ship(spark)
    for k, indexes in enumerate(_blocks(benchmark, similarity, block, block_bytes)):
        sent = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 3_000_000):
                clean = np.ones(b.num_rows, bool)
                clean[[t for t, *_ in _found(sent.value, b, similarity)]] = False
                yield b.filter(pa.array(clean))

        docs = widened(stored(docs, "clean") if k else docs, run)
    return docs
