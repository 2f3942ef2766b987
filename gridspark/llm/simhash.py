"""SimHash near-duplicates by BK-trees.

A fingerprint has 64 bits; two texts link when theirs differ in at most ``RADIUS`` (2). Equal fingerprints
are one node from the start (a grouping with map-side combine), so copies never meet as pairs.

Shards: cut a fingerprint into four blocks of 16 bits. Two that differ in two bits at most agree in two
blocks at least, so they meet in the shard of one of the six pairs of blocks. Each shard has a BK-tree
(children keyed by integer Hamming distance to the parent); its own fingerprints are looked up in it, and
only edges within the radius are followed. A tree is built where its shard's rows lie after the shuffle,
and not broadcast: all trees together grow with the corpus and would have to pass through the driver.

Shards have a proven bound. One that holds more than ``SHARD`` fingerprints is cut again: its 32 free bits
fall into three blocks, of which two fingerprints of the shard agree in one at least; and again in the same
way, until 13 to 16 bits are free, with at most 65,536 different fingerprints.

A shard gives one link from each fingerprint to the root of its own component, not all pairs. Components of
all links are found by large-star and small-star steps, each a shuffle, with checkpoints in between.

``near_duplicates`` links by fingerprints alone. ``one_of_each`` asks more: two texts belong together when
their sets of shingles of ``WIDE_WORDS`` words have a Jaccard similarity of ``SIMILARITY`` percent or more. Equal sets are one node.
Their fingerprints (of the set, each shingle once) then
differ in too many bits for blocks that agree for certain, so fingerprints have ``WIDE`` x 64 bits there, and
shards are the values of random samples of bits: as many bits as keep a shard small at the size of the corpus,
and as many samples as bring two texts of the least similarity together with a probability of ``RECALL``, and more
similar ones with a higher one. The radius takes in all but one in a thousand of them (three deviations). All trees of a batch of
shards are built and searched together, level by level.

A first round takes from each shard (or each salt of a crowded one) a spanning forest of what is within the radius, and
decides its edges by the exact similarity; what holds makes components. A forest alone would lose links: where
texts that are not similar lie between two that are, the path breaks. So in a second round all nodes that had something within
the radius, and all of the crowds, meet in their shards again, and every pair within the radius whose components differ is decided on whole
sets, inside the task (``links``). A crowd of true copies is one component by then and costs nothing more.

Defined cases: a text without words, or null, has fingerprint zero and is linked like any other; a text of
fewer words than a shingle has is one shingle; for ``near_duplicates`` shingles count as often as they occur; equal texts, and rows that
repeat, are in one group; an empty table gives no rows; other columns are not read by ``near_duplicates``, and
passed on as they are by ``one_of_each``, whatever their names. Long texts are handled whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import fresh, looked_up, ship, slices, stored, texts, widened
from .links import STEP, blocks, components, crowds, decided, mixed, remaining, salted, shapes_of, shingle_sets, spanning, whole_groups

WORDS = 3
SEED = 42
RADIUS = 2
SHARD = 4096
#: For one_of_each: words of a shingle, least similarity in percent, words of 64 bits, and radius.
WIDE_WORDS, SIMILARITY, WIDE, WIDE_RADIUS = 5, 80, 4, 58
#: Chance that two texts of the least similarity share a shard.
RECALL = 0.97
#: Members of a shard that one task takes as they are.
CROWD = 512
_ALL = range(64)
#: Pairs of 16-bit blocks: the bits of a first-level shard key.
_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: str) -> int:
    """SimHash of a text's shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and only ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    ones, n = np.zeros(64, np.int64), 0
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles)
    while len(part := np.fromiter(islice(hashes, 1 << 16), np.uint64)):
        # a byte of each hash at a time; counts of its 256 values give the counts of its 8 bits
        view = part.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(view[:, k], minlength=256) @ _BITS
        n += len(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


#: For each byte a 64-bit number whose bytes are its bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.fromiter(map(fingerprint, texts(b)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Distinct 64-bit values; the child of a node at key k holds what lies k bits from the node's value."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            members = todo.pop()  # the first is the node, the others stand below it
            below = members[1:]
            keys = np.bitwise_count(values[below] ^ values[members[0]])
            for k in np.unique(keys).tolist():
                own = below[keys == k]
                self.children[members[0]][k] = int(own[0])
                if len(own) > 1:
                    todo.append(own)

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and of values that are within the radius; all queries walk down together."""
        asked, found = [], []
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, own = todo.pop()
            distance = np.bitwise_count(queries[own] ^ self.values[node]).astype(np.int64)
            hit = own[distance <= radius]
            asked.append(hit)
            found.append(np.full(len(hit), node))
            for k, child in self.children[node].items():
                near = own[np.abs(distance - k) <= radius]
                if len(near):
                    todo.append((child, near))
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(asked or empty), np.concatenate(found or empty)


def _links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that have another within the radius, and the least value that each can reach inside the shard."""
    a, b = BKTree(values).search(values, radius)
    root = np.arange(len(values))
    a, b = a[a != b], b[a != b]
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(values)))
    return values[own], values[root[own]]


def _tree_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) inside each shard; keyed: shard, fp, distinct, shards of a proven size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        a, b = [], []

        def close() -> None:
            if held and (len(held) > 1 or len(held[0]) > 1):
                x, y = _links(np.sort(np.concatenate(held).view(np.uint64)), radius)
                a.append(x)
                b.append(y)

        for batch in batches:
            keys, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp"))
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if i == j:
                    continue
                if keys[i] != shard:
                    close()
                    shard, held = keys[i], []
                held.append(fp[i:j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])
                a, b = [], []
        close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return keyed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def _shard_key(mask: int, salt: int):
    """Shard of a fingerprint: a hash of the bits under the mask. Shards that share a hash only hold more candidates."""
    return F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")), F.lit(salt))


def shards(nodes: DataFrame, most: int = SHARD) -> DataFrame:
    """(shard, fp) rows such that any two fingerprints within the radius share a shard; lone rows are left out."""
    block = [0xFFFF << 16 * k for k in range(4)]
    masks = [block[a] | block[b] for a, b in _PAIRS]
    level = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), _shard_key(m, k).alias("shard")) for k, m in enumerate(masks)))).alias("s")).select("fp", "s.*")
    done = None
    for depth in (1, 2, 3):
        counts = level.groupBy("shard").count()
        fine = level.join(counts.where(F.col("count").between(2, most) if depth < 3 else F.col("count") >= 2).select("shard"), "shard")
        done = fine.select("shard", "fp") if done is None else done.unionByName(fine.select("shard", "fp"))
        if depth == 3:
            return done
        crowded = level.join(counts.where(F.col("count") > most).select("shard"), "shard").select("fp", "mask")
        narrower = []
        for m in masks:  # the free bits of a mask in three blocks
            free = [b for b in _ALL if not m >> b & 1]
            third = -(-len(free) // 3)
            narrower.append([m | sum(1 << b for b in free[k * third : (k + 1) * third]) for k in range(3)])
        base = 1000 * depth
        choice = F.lit(None)
        for k, own in enumerate(narrower):
            made = F.array(*(F.struct(F.lit(3 * k + j).alias("mask"), _shard_key(m, base + 3 * k + j).alias("shard")) for j, m in enumerate(own)))
            choice = F.when(F.col("mask") == k, made).otherwise(choice) if k else F.when(F.col("mask") == k, made)
        level = crowded.select("fp", F.explode(choice).alias("s")).select("fp", "s.*")
        masks = [m for own in narrower for m in own]
    return done


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every document."""
    if radius > 2:
        raise ValueError("shards of block pairs hold for a radius up to 2")
    rows = stored(fingerprints(docs), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    roots = components(_tree_links(shards(nodes.select("fp")), radius))
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(member.join(lowest, "root").select("fp", "component_id", "copies"), "labels")
    labelled = looked_up(rows, labels, "fp", "copies", rows.count())
    return labelled.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide_fingerprints(h: np.ndarray, bounds: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """SimHashes [set, word of 64 bits] of sets of hashes in a row, with the places where they begin and the last one's end."""
    out = np.zeros((len(bounds) - 1, wide), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    count = np.diff(bounds)[full]
    # eight counters of a byte each add up in one 64-bit number, over runs of 255 shingles at most
    runs = -(-count // 255)
    first = np.cumsum(runs) - runs
    begin = np.repeat(bounds[full], runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    for k in range(wide):
        own = mixed(h ^ STEP[k]).view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.add.reduceat(np.add.reduceat(_LANES[own[:, j]], begin).view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64) for j in range(8)], axis=1)
        out[full, k] = np.packbits(ones * 2 > count[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def tree_pairs(values: np.ndarray, shard: np.ndarray, radius: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) within the radius inside each shard; shard: ascending. A BK-tree for each shard, all at once.

    Trees grow level by level: the first member of a group is a node, the others fall into its children by
    their distance to it. Queries go down together too, only by edges whose key is within the radius of the
    query's distance to the node. Where they stand at more than ``most`` nodes, half of them wait.
    """
    n, keys_of_node = len(values), 64 * values.shape[1] + 1
    own, label = np.arange(n), np.unique(shard, return_inverse=True)[1]
    first = np.concatenate([[True], label[1:] != label[:-1]]) if n else np.zeros(0, bool)
    root = own[first][label] if n else own
    edges: list[np.ndarray] = []
    while len(own):
        first = np.concatenate([[True], label[1:] != label[:-1]])
        node = own[first][np.cumsum(first) - 1]
        own, node = own[~first], node[~first]
        key = node * keys_of_node + _apart(values[own], values[node])
        order = np.argsort(key, kind="stable")
        own, label = own[order], key[order]
        if len(own):
            new = np.concatenate([[True], label[1:] != label[:-1]])
            edges.append(np.stack([label[new], own[new]]))
    keys, children = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    order = np.argsort(keys, kind="stable")
    keys, children = keys[order], children[order]
    waiting = [(np.arange(n), root)] if n else []
    while waiting:
        asked, node = waiting.pop()
        if len(asked) > most:
            half = len(asked) // 2
            waiting += [(asked[half:], node[half:]), (asked[:half], node[:half])]
            continue
        distance = _apart(values[asked], values[node])
        hit = (distance <= radius) & (asked < node)
        if hit.any():
            yield asked[hit], node[hit]
        low = np.searchsorted(keys, node * keys_of_node + np.maximum(distance - radius, 0), "left")
        high = np.searchsorted(keys, node * keys_of_node + np.minimum(distance + radius, keys_of_node - 1), "right")
        count = high - low
        asked = np.repeat(asked, count)
        if len(asked):
            waiting.append((asked, children[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(asked))]))


def forest(values: np.ndarray, shard: np.ndarray, radius: int, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest (i, j) of what is within the radius inside each shard, thinned out as pairs come; shard: ascending."""
    i = j = np.zeros(0, np.int64)
    held = 0

    def thin(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = spanning(len(values), i, j, _apart(values[i], values[j]))
        return i[own], j[own]

    for a, b in tree_pairs(values, shard, radius):
        i, j, held = np.concatenate([i, a]), np.concatenate([j, b]), held + len(a)
        if held > most:
            (i, j), held = thin(i, j), 0
    return thin(i, j)


def samples(n: int, wide: int = WIDE, similarity: int = SIMILARITY, recall: float = RECALL) -> list[np.ndarray]:
    """The bits of each table: about log2(n / 8) of them, so that a shard holds few texts by chance.

    SimHashes of two sets differ in a bit with a probability of their angle over pi.
    """
    bits = min(60, max(6, math.ceil(math.log2(max(n, 1) / 8))))
    s = similarity / 100
    agree = 1 - math.acos(2 * s / (1 + s)) / math.pi
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(64 * wide, bits, replace=False)) for _ in range(tables)]


_FP = [f"f{k}" for k in range(WIDE)]


def _values(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Fingerprints [row, word]."""
    return np.ascontiguousarray(np.stack([t.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in _FP], axis=1))


def dealt(nodes: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """(grp, ...): each node (with f0, f1, ...) in the shard of each table."""
    columns = nodes.columns

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = np.unpackbits(_values(b).view(np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
            for t, places in enumerate(tables):
                own = np.zeros((b.num_rows, 64), np.uint8)
                own[:, : len(places)] = bits[:, places]
                shard = mixed(np.packbits(own, axis=1, bitorder="little").view(np.uint64)[:, 0] ^ mixed(np.array([t], np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), *b.columns], names=["grp", *columns])

    return nodes.mapInArrow(keyed, ", ".join(["grp long", *(f"{c} long" for c in columns)]))


def candidates(rows: DataFrame, crowded: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """Pairs (a < b) of a forest of each shard, or of each salt of a crowd with its leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 20_000):
            i, j = forest(_values(t), t.column("grp").to_numpy(), radius)
            node = t.column("node").to_numpy()
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    spread = salted(rows, crowded)
    return spread.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, words: int = WIDE_WORDS) -> DataFrame:
    """One row, as it is, of each group of near-duplicates: that of the least id (a null id is the last), then the least text.

    Rows have keys of their own, so that ids may be null or repeat. similarity: in percent.
    """
    ship(docs.sparkSession)
    columns = docs.columns
    key, node = fresh(columns, "row_key"), fresh(columns, "node_key")
    names = [fresh(columns, c) for c in _FP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, text_col):
            h, bounds = shingle_sets(texts(b, text_col), words)
            fp = wide_fingerprints(h, bounds).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(row, row + b.num_rows)), _node_keys(h, bounds), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WIDE))], names=[*columns, key, node, *names])
            row += b.num_rows

    rows = stored(widened(docs, run, *(StructField(c, LongType()) for c in (key, node, *names))), "wide-fingerprints")
    rank = F.struct(F.col(f"`{id_col}`").isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text"), F.col(key).alias("row"))
    nodes = rows.select(F.col(node).alias("node"), *(F.col(c).alias(f) for c, f in zip(names, _FP)), rank.alias("rank")).groupBy("node").agg(*(F.min(f).alias(f) for f in _FP), F.min("rank").alias("rank"))
    nodes = stored(nodes, "nodes")
    tables = samples(nodes.count(), similarity=similarity)
    with_words = nodes.where(F.col("node") != 0)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, made again from one text of each."""

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 1_000_000):
                h, bounds = shingle_sets(texts(b), words)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([h[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], names=["node", "shingles"])

        one = nodes.join(wanted, "node").select(F.col("rank.row").alias(key))
        return stored(rows.join(one, key, "left_semi").select(F.col(node).alias("node"), F.col(f"`{text_col}`").alias("text")).mapInArrow(made, "node long, shingles binary"), "shingles")

    own = dealt(with_words.select("node", *_FP), tables)
    crowded = stored(crowds(own, CROWD), "crowds")
    pairs = stored(candidates(own, crowded), "candidates")
    paired = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired")
    sets = sets_of(paired)
    links = stored(decided(pairs, sets, similarity), "links")
    # salts of a crowd may keep partners apart, so all of it looks again
    involved = paired if crowded.isEmpty() else paired.unionByName(own.join(crowded.select("grp"), "grp").select("node")).distinct()
    known = with_words.select("node", *_FP).join(involved, "node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    again = dealt(stored(known, "known"), tables)
    shapes = stored(shapes_of(again, 2 * CROWD), "shapes")

    def pairs_in(t: pa.Table, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in tree_pairs(_values(t), t.column("grp").to_numpy(), WIDE_RADIUS):
            apart = root[a] != root[b]
            yield a[apart], b[apart]

    rest = remaining(blocks(again, shapes).select("grp", "node", *_FP, "root"), sets, sets_of, similarity, pairs_in)
    roots = components(links.unionByName(rest))
    least = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("rank").alias("rank"))
    kept = least.select(F.col("rank.row").alias(key))
    return rows.join(kept, key, "left_semi").select(*(F.col(f"`{c}`") for c in columns))


def _node_keys(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A hash of each set; 0 for empty ones."""
    import xxhash

    keys = [xxhash.xxh3_64_intdigest(h[i:j].tobytes()) if j > i else 0 for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return pa.array(np.array(keys, np.uint64).view(np.int64))
