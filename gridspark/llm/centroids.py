"""Centroid clustering of integer vectors (Lloyd's rounds), exact to the last digit.

A vector's components become integers floor(1024 * x). Squared distances come from the expansion
|x|^2 - 2 x.c + |c|^2, of which the middle term is one float64 matrix product for a block of vectors. All terms and
their sums are integers below 2^53 as long as no component of vectors or centroids exceeds 2^22 at 64 components
(``_bound`` says so for any width), so float64 gives them exactly, in any order of summation. A block that exceeds
the bound, or meets a centroid that does, is computed with Python integers instead.

Each round is one ``treeAggregate`` over blocks of vectors: a task sends k sums and counts, whatever it holds, and
partial sums meet in executors before the driver, which gets k x (width + 1) integers. No vector moves between
rounds and there are no groups, so a hot cluster or many copies of one vector change nothing. Blocks are stored once.

Defined cases: a vector that is null, has another number of components, or one that is null, NaN or infinite, is left
out. Fewer vectors than centroids: as many centroids as vectors. Rows that repeat an id are vectors of their own;
seeds are taken in the order of hash, id and components (a null id has no hash and comes last). A centroid that has
no vectors stays where it is. A distance or inertia beyond the largest long is returned as the largest long; which
cluster is nearest is exact then, too. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors of a block.
BLOCK = 4096
_LARGEST = (1 << 63) - 1


def _bound(width: int) -> int:
    """Components up to this size keep |x|^2 + 2 |x.c| + |c|^2 <= 4 width bound^2 below 2^53."""
    return math.isqrt((1 << 51) // width - 1)


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: float64 where that is exact in every later step, else Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if not out.size or np.abs(out).max() <= _bound(values.shape[-1]):
        return out
    # beyond 2^52 a double is an integer; below, scale (a power of two) only changes the exponent
    return np.array([int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in values.ravel().tolist()], object).reshape(values.shape)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances [vector, centroid]: float64 integers where bounds allow it, else Python integers."""
    bound = _bound(x.shape[1])
    if x.dtype != object and all(abs(c) <= bound for c in centroids.ravel().tolist()):
        c = centroids.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    x = x if x.dtype == object else x.astype(np.int64).astype(object)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller number) and the squared distance."""
    d = distances(x, centroids)
    own = np.argmin(d, axis=1)
    return own, d[np.arange(len(x)), own]


def sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Python integers [centroid, width + 1]: the sums of the components, and the number of vectors."""
    out = np.zeros((k, x.shape[1] + 1), object)
    for j in np.unique(own).tolist():
        part = x[own == j]
        out[j, :-1] = part.sum(0) if part.dtype == object else part.astype(np.int64).sum(0).tolist()
        out[j, -1] = len(part)
    return out


def blocks(vectors: DataFrame, vec_id: str, embedding: str, width: int) -> DataFrame:
    """(n, ids, present, x): blocks of kept vectors, doubles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                ids = part.column("vec_id")
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f8")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()]), pa.array([known.tobytes()]), pa.array([x.tobytes()])], names=["n", "ids", "known", "x"])

    x = F.col("x")
    kept = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("x")).where((F.size(x) == width) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return kept.mapInArrow(run, "n long, ids binary, known binary, x binary")


def _opened(row, width: int) -> np.ndarray:
    return np.frombuffer(row["x"], "<f8").reshape(row["n"], width)


def seeds(held: DataFrame, k: int, width: int, scale: int, seed: int) -> np.ndarray:
    """Python integers [centroid, component] of the k vectors with the smallest hashes; a block gives k rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, known = np.frombuffer(row["ids"], "<i8").tolist(), np.frombuffer(row["known"], bool)
                keys = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if ok else "~") for i, ok in zip(ids, known)]
                x = _opened(row, width)
                first = sorted(range(row["n"]), key=lambda i: (keys[i], ids[i], x[i].tolist()))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in first]), pa.array([ids[i] for i in first], pa.int64()), pa.array([x[i].tolist() for i in first], pa.list_(pa.float64()))], names=["key", "vec_id", "x"])

    rows = held.mapInArrow(run, "key string, vec_id long, x array<double>").orderBy("key", "vec_id", "x").limit(k).collect()
    return np.array([[int(v) for v in scaled(np.array(r["x"]), scale).tolist()] for r in rows], object).reshape(len(rows), width)


def _total(held: DataFrame, step, zero: np.ndarray) -> np.ndarray:
    """Sum of ``step`` over the blocks, by a tree over the executors."""
    return held.rdd.treeAggregate(zero, lambda acc, row: acc + step(row), lambda a, b: a + b, 2)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    ship(vectors.sparkSession)
    held = stored(blocks(vectors, vec_id, embedding, width), "vector-blocks")
    now = seeds(held, k, width, scale, seed)

    def lloyd(row, centroids):
        x = scaled(_opened(row, width), scale)
        return sums(x, nearest(x, centroids)[0], len(centroids))

    def cost(row, centroids):
        own, d = nearest(scaled(_opened(row, width), scale), centroids)
        out = np.zeros(len(centroids), object)
        for j in np.unique(own).tolist():
            out[j] = sum(map(int, d[own == j].tolist()))
        return out

    for _ in range(rounds if len(now) else 0):
        total = _total(held, lambda row, c=now: lloyd(row, c), np.zeros((len(now), width + 1), object))
        now = np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(total.tolist(), now.tolist())], object)
    inertia = [int(x) for x in _total(held, lambda row: cost(row, now), np.zeros(len(now), object))] if len(now) else []
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip = lambda v: min(int(v), _LARGEST)
        for b in batches:
            for row in b.to_pylist():
                own, d = nearest(scaled(_opened(row, width), scale), now)
                ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=~np.frombuffer(row["known"], bool))
                places, each = own.tolist(), pa.array([clip(v) for v in d.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own.astype(np.int32)), each, pa.array([clip(inertia[j]) for j in places], pa.int64()), pa.array([clip(sum(inertia))] * len(places), pa.int64()), pa.array([named[j] for j in places], pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return held.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
