"""MinHash near-duplicates by tensored banding, decided on whole sets of shingles.

A text's set are its distinct shingles of ``WORDS`` words. Two texts link when their Jaccard similarity is at least
``SIMILARITY`` percent. Equal sets are one node from the start (a grouping with map-side combine).

Tables: two collections of m keys, each key made of k minhashes. A table is a pair of keys, one of each collection,
so m x m tables of 2k minhashes cost 2mk minhashes and not 2mmk. Two sets of similarity s share a table with
probability (1 - (1 - s^k)^m)^2; m is what makes that ``RECALL`` for the least similarity, and k grows with the
logarithm of the number of nodes, so that tables hold few sets by chance.

The pairs of keys are formed where rows meet: a node is dealt m times, by its keys of the first collection, and brings
its m keys of the second along. Groups of more than ``HELD`` nodes (a crowd of near copies) are dealt among salts.

Inside a group, pairs that share a second key are weighed by their sizes (a similarity bounds the ratio) and by sketches of
``SKETCH`` bits that come off the sorted set (the least shingle of each of as many ranges, one bit of it): pairs that
differ in more than ``APART`` bits have a similarity of 0.8 with a probability below one in a million. No pairs
leave a group, but a forest:

1. of each group (or salt of it) a spanning forest by nearest sketches, each edge decided on the full sets; edges that hold
   make components;
2. nodes that had a partner by sketch, and all of the crowds, go to their groups again with their component. A group that is of one
   component is done. Of the others, members that still have a partner in another component bring their full sets, and
   every such pair that shares a second key is decided exactly in the task, by bits over the shingles that the members
   share; again a forest leaves. In a crowd the largest component is dealt among salts and the other members go to every salt.
   Where these others are a crowd themselves (texts that are not similar but share a key by much boilerplate), tables are pairs of
   keys from the start, and what is large even then is compared block by block: that costs the product of sizes in
   comparisons, and nothing is left out.

So what is lost is what no table brings together: a thousandth of the pairs at similarity 0.8, and fewer above.

Defined cases: a text without words, or null, has an empty set, links with nothing and is its own component; a text of fewer
words than a shingle has the whole sequence as its shingle. Rows without a doc_id, and rows that repeat one, are rows
of their own; a component is named by its smallest id (null only if no member has one), and ``kept`` are rows
with that id (null equals null). Long texts are whole. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, ship, slices, stored, texts
from .links import Filter, blocks, components, crowds, decided, remaining, salted, shapes_of, shingle_sets, spanning, whole_groups

WORDS, SIMILARITY, RECALL, SEED = 2, 80, 0.999, 11
#: Bits of a sketch, and most bits in which two similar sets differ: (1 - s) / 2 of them on average, and 5 deviations.
SKETCH, APART = 256, 50
#: Nodes of a group that one task takes as it is.
HELD = 1024
_SKETCHES = [f"s{k}" for k in range(SKETCH // 64)]


def tables(n: int, similarity: int = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """k, the minhashes of a key, and m, the keys of each collection, for n nodes."""
    k = max(2, math.ceil(math.log(max(n, 2)) / math.log(64)))
    return k, math.ceil(math.log(1 - math.sqrt(recall)) / math.log(1 - (similarity / 100) ** k))


def _keys(h: np.ndarray, begin: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys [collection, set, key] of non-empty sets that begin at ``begin``."""
    rng = np.random.default_rng(SEED)
    factor = rng.integers(0, 1 << 63, 2 * m * k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, 2 * m * k, dtype=np.uint64)
    out = np.zeros((2, len(begin), m), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(2 * m * k):
            least = np.minimum.reduceat((h ^ shift[t]) * factor[t], begin)
            own = out[t // (m * k), :, t // k % m]
            own[:] = (own ^ (least >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)
    return out


def _sketches(h: np.ndarray, begin: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """[set, word]: for each range of hash values a bit of the least hash in it (0 for none); h: ascending in each set."""
    bin_ = (h >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    cell = owner * SKETCH + bin_
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]
    bits = np.zeros(n * SKETCH, np.uint8)
    low = h[first]
    bits[cell[first]] = ((low ^ (low >> np.uint64(17)) ^ (low >> np.uint64(33))) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.reshape(n, SKETCH), axis=1, bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, words: int, k: int, m: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, size, first, second, sketch) of every row.

    node: a hash of the whole set, null for an empty one; first, second: the m keys of each collection, null for copies
    of what the task has just seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for b in slices(batches, "text"):
            h, bounds = shingle_sets(texts(b), words)
            size = np.diff(bounds)
            node = np.array([xxhash.xxh3_64_intdigest(h[i:j].tobytes()) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())], np.uint64)
            new = np.zeros(len(size), bool)
            for i, (x, n) in enumerate(zip(node.tolist(), size.tolist())):
                if n and x not in seen:
                    seen.add(x)
                    new[i] = True
            if len(seen) > 100_000:
                seen.clear()
            own = size[new]
            begin = np.cumsum(own) - own
            h = h[np.repeat(bounds[:-1][new] - begin, own) + np.arange(int(own.sum()))]
            key = _keys(h, begin, k, m) if len(own) else np.zeros((2, 0, m), np.uint64)
            sketch = np.zeros((len(size), SKETCH // 64), np.uint64)
            sketch[new] = _sketches(h, begin, np.repeat(np.arange(len(own)), own), len(own))
            ends = np.concatenate([[0], np.cumsum(np.where(new, m, 0))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x), mask=pa.array(~new)) for x in (key[0].reshape(-1).view(np.int64), (key[1].reshape(-1) >> np.uint64(32)).astype(np.uint32).view(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(size), pa.array(node.view(np.int64), mask=size == 0), *lists, *(pa.array(np.ascontiguousarray(sketch[:, j]).view(np.int64)) for j in range(len(_SKETCHES)))],
                names=["doc_id", "text_key", "n_shingles", "node", "first", "second", *_SKETCHES],
            )

    schema = "doc_id long, text_key long, n_shingles long, node long, first array<long>, second array<int>, " + ", ".join(f"{s} long" for s in _SKETCHES)
    return _keyed(docs, id_col, text_col).mapInArrow(run, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _dealt(nodes: DataFrame, *also: str) -> DataFrame:
    """(grp, node, ...): each node in its group of each first key."""
    return nodes.select(F.posexplode("first").alias("i", "key"), "node", "size", "second", *_SKETCHES, *also).withColumn("grp", F.xxhash64("i", "key")).drop("i", "key")


def _longs(t: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in names], axis=1)


def _near(a: np.ndarray, b: np.ndarray, size: np.ndarray, second: np.ndarray, single: np.ndarray, sketch: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs of places (a, b) share a table and pass sizes and sketches."""
    ok = (np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * similarity)
    ok[ok] = np.bitwise_count(sketch[a[ok]] ^ sketch[b[ok]]).sum(1, dtype=np.int64) <= APART
    rest = np.flatnonzero(ok)
    ok[rest] = single[a[rest]] | (second[a[rest]] == second[b[rest]]).any(1)
    return ok


def pairs_of(grp: np.ndarray, size: np.ndarray, second: np.ndarray, single: np.ndarray, sketch: np.ndarray, similarity: int, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a < b) of pairs inside the groups (ascending) that share a table and pass sizes and sketches; with roots,
    of different ones only. Small groups go together, by the distance of places; large ones row block by row block."""
    n = len(grp)
    cuts = np.concatenate([[0], np.flatnonzero(grp[1:] != grp[:-1]) + 1, [n]])
    length = np.diff(cuts)
    end = np.repeat(cuts[1:], length)
    large = np.repeat(length > 64, length)
    places = np.flatnonzero(~large)
    for gap in range(1, 64):
        places = places[places + gap < end[places]]
        if not len(places):
            break
        a, b = places, places + gap
        if root is not None:
            other = root[a] != root[b]
            a, b = a[other], b[other]
        ok = _near(a, b, size, second, single, sketch, similarity)
        yield a[ok], b[ok]
    for start, stop in zip(cuts[:-1][length > 64].tolist(), cuts[1:][length > 64].tolist()):
        step = max(1, 200_000 // (stop - start))
        for low in range(start, stop, step):
            high = min(low + step, stop)
            a, b = np.repeat(np.arange(low, high), stop - low), np.tile(np.arange(low, stop), high - low)
            upper = a < b
            if root is not None:
                upper &= root[a] != root[b]
            a, b = a[upper], b[upper]
            ok = _near(a, b, size, second, single, sketch, similarity)
            yield a[ok], b[ok]


def _forest(t: pa.Table, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the edges of a forest by nearest sketches over all pairs of the groups, thinned out as pairs come."""
    grp, size, sketch = t.column("grp").to_numpy(), t.column("size").to_numpy().astype(np.int64), _longs(t, _SKETCHES)
    second, single = _second(t), np.zeros(len(t), bool)
    i = j = np.zeros(0, np.int64)
    held = 0

    def thin(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = spanning(len(grp), i, j, np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64))
        return i[own], j[own]

    for a, b in pairs_of(grp, size, second, single, sketch, similarity):
        i, j, held = np.concatenate([i, a]), np.concatenate([j, b]), held + len(a)
        if held > 500_000:
            (i, j), held = thin(i, j), 0
    return thin(i, j)


def candidates(dealt: DataFrame, crowded: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a < b): a forest of each group, or of each salt of a crowd with its leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            i, j = _forest(t, similarity)
            node = t.column("node").to_numpy()
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            own = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own])], names=["a", "b"])

    return salted(dealt, crowded).repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles): the sorted distinct hashes, as bytes, of the wanted nodes (node, doc_id, text_key; stored), made again from one text of each.

    A Bloom filter of the rows that are wanted saves most others the way; the join decides.
    """
    key = F.xxhash64("doc_id", "text_key").alias("row_key")
    passes = docs.sparkSession.sparkContext.broadcast(Filter.of(wanted.select(key), "row_key", wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            kept = whole.filter(pa.array(passes.value(whole.column("row_key").to_numpy().astype(np.int64).view(np.uint64))))
            for b in slices([kept], "text", 1_000_000):
                h, bounds = shingle_sets(texts(b), words)
                sets = [h[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                node = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sets, pa.binary())], names=["node", "shingles"])

    made = _keyed(docs, id_col, text_col).select(key, "text").mapInArrow(run, "node long, shingles binary")
    # rows may repeat an id and a text
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _second(t: pa.Table) -> np.ndarray:
    return t.column("second").combine_chunks().flatten().to_numpy().reshape(len(t), -1)


def regrouped(dealt: DataFrame) -> DataFrame:
    """Rows (with root) of groups of several components, in blocks; in very mixed crowds by pairs of keys."""
    own = ["grp", "j", "node", "size", "second", *_SKETCHES, "root"]
    dealt = dealt.withColumn("j", F.lit(None).cast("int")).select(*own)
    shapes = stored(shapes_of(dealt, HELD), "shapes")
    rows = blocks(dealt, shapes.where(F.col("others") <= 8 * HELD))
    wide = shapes.where(F.col("others") > 8 * HELD)
    if not wide.isEmpty():  # texts that are not similar but share a key
        fine = dealt.join(wide.select("grp"), "grp").drop("j").select(F.col("grp").alias("outer"), "node", "size", "second", *_SKETCHES, "root", F.posexplode("second").alias("j", "key"))
        fine = stored(fine.withColumn("grp", F.xxhash64("outer", "j", "key")).select(*own), "fine")
        rows = rows.unionByName(blocks(fine, shapes_of(fine, HELD)))
    return rows.select(*own)


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; similarity in percent, 80 at least (the sketches' bound)."""
    if similarity < 80:
        raise ValueError("sketches hold for a similarity of 80 or more")
    ship(docs.sparkSession)
    k, m = tables(docs.count(), similarity, recall)
    rows = stored(signatures(docs, words, k, m, id_col, text_col), "signatures")
    full = rows.where("node IS NOT NULL")
    nodes = stored(full.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key")).alias("one")), "nodes")
    signed = stored(rows.where("first IS NOT NULL").select("node", F.col("n_shingles").cast("int").alias("size"), "first", "second", *_SKETCHES).dropDuplicates(["node"]), "signed")
    dealt = _dealt(signed)
    crowded = stored(crowds(dealt, HELD), "crowds")
    pairs = stored(candidates(dealt, crowded, similarity), "candidates")
    paired = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return stored(full_sets(docs, stored(nodes.join(wanted, "node").select("node", "one.*"), "wanted"), words, id_col, text_col), "shingle-sets")

    sets = sets_of(paired)
    links = stored(decided(pairs, sets, similarity), "links")
    # salts of a crowd may keep partners apart, so all of it looks again
    involved = paired if crowded.isEmpty() else paired.unionByName(dealt.join(crowded.select("grp"), "grp").select("node")).distinct()
    known = signed.join(involved, "node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    again = _dealt(stored(known, "known"), "root")

    def pairs_in(t: pa.Table, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return pairs_of(t.column("grp").to_numpy(), t.column("size").to_numpy().astype(np.int64), _second(t), t.column("j").is_valid().to_numpy(), _longs(t, _SKETCHES), similarity, root)

    roots = components(links.unionByName(remaining(regrouped(again), sets, sets_of, similarity, pairs_in)))
    member = nodes.join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(member.join(lowest, "root").select("node", "component_id", "copies"), "labels")
    found = looked_up(full.select("doc_id", "n_shingles", "node"), labels, "node", "copies", rows.count()).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
