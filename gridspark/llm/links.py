"""Links between similar texts: sets of shingles, exact decisions, what is left after a first round, and components.

The operators on pairs bring texts together in groups, each in its own way. What follows is common: candidates are decided on
whole sets of shingles; pairs of different components are decided inside their groups, so that no pairs leave a task but
a forest of links; and components of all links are found by large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

_MIX = np.uint64(0xBF58476D1CE4E5B9)
STEP = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * STEP[0]
        return x ^ (x >> np.uint64(32))


def shingle_hashes(batch_texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text, repeats included, and where each text's begin (and the last one's end)."""
    import xxhash

    split = [x.encode("utf-8", "surrogatepass").lower().split() for x in batch_texts]
    size = np.array([len(w) for w in split], np.int64)
    begin = np.cumsum(size + words) - size - words
    token = np.zeros(int((size + words).sum()), np.uint64)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    token[at] = np.fromiter((h for own in split for h in map(xxhash.xxh3_64_intdigest, own)), np.uint64, len(at))
    count = np.where(size > 0, np.maximum(size - words + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(begin - bounds[:-1], count) + np.arange(bounds[-1])
    h = np.zeros(len(at), np.uint64)
    for k in range(words):  # places behind a short text are zeros
        h = mixed(h ^ token[at + k] + np.uint64(k))
    return h, bounds


def shingle_sets(batch_texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all texts in a row, and where each text's begin."""
    h, bounds = shingle_hashes(batch_texts, words)
    owner = np.repeat(np.arange(len(batch_texts)), np.diff(bounds))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(batch_texts)))]).astype(np.int64)


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node and root (the least node that it can reach) of every linked node that is not its own root; links: a, b.

    Large-star and small-star by turns: each node hands its neighbours the least one among them, first to
    those above it and then to those below. A node's neighbours are never gathered: only their least is.
    """
    spark = links.sparkSession
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = state(edges)
    for _ in range(most_rounds):
        if not now[0]:
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stored(small, "links")
        after = state(edges)
        if after == now:
            break
        now = after
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def spanning(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest: each part takes its shortest way out, until there is none."""
    part, chosen = np.arange(n), []
    order = np.argsort(distance, kind="stable")
    i, j = i[order], j[order]
    live = np.arange(len(i))
    while len(live):
        best = np.full(n, len(i))
        np.minimum.at(best, part[i[live]], live)
        np.minimum.at(best, part[j[live]], live)
        own = np.unique(best[best < len(i)])
        chosen.append(own)
        while True:  # joined parts take the least number
            low = np.minimum(part[i[own]], part[j[own]])
            before = part.copy()
            np.minimum.at(part, before[i[own]], low)
            np.minimum.at(part, before[j[own]], low)
            part = part[part]
            if (part == before).all():
                break
        live = live[part[i[live]] != part[j[live]]]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 8192) -> Iterator[pa.Table]:
    """Batches sorted by grp, put together so that no group is cut, each of some ``least`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held)
        key = t.column("grp").to_numpy()
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if last:
            yield t.slice(0, last)
            held, n = t.slice(last).to_batches(), len(key) - last
    if n:
        yield pa.Table.from_batches(held)


def _holds(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= similarity * (len(x) + len(y) - both)


def decided(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (a, b; stored) whose sets are similar. Sets of nodes with very many pairs go to 64 salts."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("pairs"))
    salts = F.when(F.col("pairs") * 1024 > F.lit(2 * pairs.count()), 64).otherwise(1)  # fewer than 1024 nodes have more
    counted = stored(degree.withColumn("salts", salts).select("node", "salts"), "degrees")
    spread = sets.join(counted, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    frequent = F.broadcast(counted.where("salts > 1").select("node"))

    def joined(df: DataFrame, end: str, other: str, into: str) -> DataFrame:
        met = df.join(frequent.withColumnRenamed("node", end).withColumn("many", F.lit(True)), end, "left")
        salted = met.withColumn("salt", F.when(F.col("many"), F.pmod(F.xxhash64(other), F.lit(64)).cast("int")).otherwise(0)).drop("many")
        return salted.join(spread.select(F.col("node").alias(end), F.col("shingles").alias(into), "salt"), [end, "salt"]).drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "x"):
            keep = [_holds(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), similarity) for x, y in zip(b.column("x"), b.column("y"))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = joined(joined(pairs.select("a", "b"), "a", "b", "x"), "b", "a", "y")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def exact_links(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: int, block: int = 4096) -> list[tuple[int, int]]:
    """Links among the pairs of places (a, b), as a forest over roots: pairs whose roots already hang together are passed over.

    Shingles that one member alone has cannot be common, so a set is a row of bits over the shared ones.
    """
    used = np.unique(np.concatenate([a, b]))
    size = np.array([len(sets[i]) for i in used.tolist()], np.int64)
    flat, owner = np.concatenate([sets[i] for i in used.tolist()]), np.repeat(np.arange(len(used)), size)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count > 1
    column = np.cumsum(common) - 1
    width = max(8, -(-int(common.sum()) // 64) * 8)
    bits = np.zeros((len(used), width), np.uint8)
    own, starts = common[at], np.concatenate([[0], np.cumsum(size)])
    for first in range(0, len(used), 128):  # some rows at once, so that unpacked bits stay few
        last = min(first + 128, len(used))
        part = slice(int(starts[first]), int(starts[last]))
        kept = own[part]
        plain = np.zeros((last - first, 8 * width), np.uint8)
        plain[owner[part][kept] - first, column[at[part][kept]]] = 1
        bits[first:last] = np.packbits(plain, axis=1)
    bits = bits.view(np.uint64)
    place = np.zeros(int(used[-1]) + 1, np.int64)
    place[used] = np.arange(len(used))
    part = {r: r for r in set(root[used].tolist())}

    def top(r: int) -> int:
        while part[r] != r:
            part[r] = part[part[r]]
            r = part[r]
        return r

    links = []
    step = max(1, min(block, 16_000_000 // bits.shape[1] // 8))
    for start in range(0, len(a), step):
        x, y = a[start : start + step], b[start : start + step]
        apart = np.fromiter((top(r) != top(s) for r, s in zip(root[x].tolist(), root[y].tolist())), bool, len(x))
        x, y = x[apart], y[apart]
        both = np.bitwise_count(bits[place[x]] & bits[place[y]]).sum(1, dtype=np.int64)
        hit = 100 * both >= similarity * (size[place[x]] + size[place[y]] - both)
        for i, j in zip(x[hit].tolist(), y[hit].tolist()):
            r, s = top(int(root[i])), top(int(root[j]))
            if r != s:
                part[max(r, s)] = min(r, s)
                links.append((int(node[i]), int(node[j])))
    return links


def crowds(rows: DataFrame, held: int) -> DataFrame:
    """(grp, salts, leader) of the groups of more than ``held`` members; the least member is the leader."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("many"), F.min("node").alias("leader"))
    return sizes.where(F.col("many") > held).select("grp", F.ceil(F.col("many") / held).cast("int").alias("salts"), "leader")


def salted(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows with crowds dealt among their salts; the leader stands in all of them, so that they hang together."""
    met = rows.join(crowded, "grp", "left")
    own = F.array(F.pmod(F.xxhash64("node", "grp"), F.col("salts")).cast("int"))
    salt = F.when(F.col("salts").isNull(), F.array(F.lit(0))).when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(own)
    return met.withColumn("salt", F.explode(salt)).withColumn("grp", F.when(F.col("salt") == 0, F.col("grp")).otherwise(F.xxhash64("grp", "salt"))).select(*rows.columns)


class Filter:
    """A Bloom filter of 64-bit keys, to leave rows out before a join. At most ``MOST`` bits: beyond, more rows pass, and the join decides."""

    MOST, HASHES = 1 << 28, 4

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
        for k in range(Filter.HASHES):
            yield mixed(keys ^ STEP[k]) & np.uint64(8 * size - 1)

    @classmethod
    def of(cls, keys: DataFrame, column: str, count: int) -> Filter:
        """Tasks fill filters of their own, which are joined pairwise on executors."""
        size = min(cls.MOST, 1 << max(13, (10 * count).bit_length())) // 8

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size, np.uint8)
            for b in batches:
                for at in cls.places(b.column(0).to_numpy().astype(np.int64).view(np.uint64), size):
                    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()])], names=["bits"])

        # stored in between, so that a task needs one Python worker at a time
        parts = stored(keys.select(column).coalesce(32).mapInArrow(fill, "bits binary"), "filter").rdd.map(lambda row: np.frombuffer(row[0], np.uint8))
        return cls(parts.treeReduce(np.bitwise_or, 2))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for at in self.places(keys, len(self.bits)):
            hit &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return hit


def shapes_of(rows: DataFrame, held: int) -> DataFrame:
    """(grp, main, salts, chunks, others) of the groups of more than one component: the largest one, how many tasks' worth it and the others have."""
    parts = rows.groupBy("grp", "root").agg(F.count("*").alias("rows"))
    shape = parts.groupBy("grp").agg(F.max(F.struct("rows", "root")).alias("main"), F.count("*").alias("roots"), F.sum("rows").alias("all")).where("roots > 1")
    others = F.col("all") - F.col("main.rows")
    return shape.select("grp", F.col("main.root").alias("main"), F.ceil(F.col("main.rows") / held).cast("int").alias("salts"), F.ceil(others / held).cast("int").alias("chunks"), others.alias("others"))


def blocks(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Rows in blocks, such that two of different components of a group meet in one: salts of the largest component with
    chunks of the others, and chunks of the others with each other. Up to ``held`` others are one chunk, and no row is doubled
    but theirs."""
    met = rows.join(shapes.drop("others"), "grp")
    salt, chunk = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    block = lambda kind, a, b: F.struct(F.lit(kind).alias("k"), a.alias("a"), b.alias("b"))
    all_salts, all_chunks = F.sequence(F.lit(0), F.col("salts") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
    main = F.transform(all_chunks, lambda c: block(0, salt, c))
    other = F.concat(F.transform(all_salts, lambda x: block(0, x, chunk)), F.transform(F.filter(all_chunks, lambda c: c != chunk), lambda c: block(1, F.least(c, chunk), F.greatest(c, chunk))))
    return met.withColumn("block", F.explode(F.when(F.col("root") == F.col("main"), main).otherwise(other))).withColumn("grp", F.xxhash64("grp", "block")).drop("block", "main", "salts", "chunks")


def remaining(rows: DataFrame, sets: DataFrame, more_sets: Callable[[DataFrame], DataFrame], similarity: int, pairs_in: Callable) -> DataFrame:
    """Links (a, b) between different components of each group, all pairs decided.

    rows: grp, node, root and what ``pairs_in(table, roots)`` needs to say which places of a table of whole groups are worth a
    decision. sets: (node, shingles); more_sets makes those of nodes that it lacks.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members that have a partner in another component."""
        for t in whole_groups(batches):
            has = np.zeros(len(t), bool)
            for a, b in pairs_in(t, t.column("root").to_numpy()):
                has[a] = has[b] = True
            yield from t.filter(pa.array(has)).to_batches()

    open_ = stored(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(near, rows.schema), "open")
    if open_.isEmpty():
        return open_.selectExpr("node AS a", "node AS b").limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 512):
            node, root = (t.column(c).to_numpy() for c in ("node", "root"))
            found = list(pairs_in(t, root))
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            if len(a):
                links = exact_links(node, root, [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("shingles").combine_chunks()], a, b, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    lacking = stored(open_.select("node").distinct().join(sets, "node", "left_anti"), "lacking")
    known = sets if lacking.isEmpty() else sets.unionByName(more_sets(lacking))
    return open_.join(known, "node").repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")
