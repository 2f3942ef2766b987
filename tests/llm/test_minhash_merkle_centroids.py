"""Tensored MinHash, Merkle manifest and centroid clustering: brute force, planted crowds, and odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import centroids, common, merkle, minhash
from test_operators import DOCS, SF, empty, odd  # noqa: F401


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)]) if words else frozenset()


def brute_groups(texts):
    """{id: (size, component)} by an inverted index of all shingles."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    places = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in places[s])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for s in sets[i]:
            places[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def crowd(words, n, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def minhash_of(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, **options).collect()}


def test_near_duplicates_by_brute_force(spark):
    df = common.table(spark, SF, "documents")
    assert minhash_of(df) == brute_groups({r["doc_id"]: r["text"] for r in df.collect()})


@pytest.mark.parametrize("held", [16, 64, 1024])
def test_crowds_are_whole(spark, monkeypatch, held):
    """True copies, a crowd of texts about as far apart as the least similarity, and unlike texts; with 16 and 64, groups are salted and compared block by block."""
    monkeypatch.setattr(minhash, "HELD", held)
    made = crowd(120, 300, 6, 1) + crowd(100, 300, 30, 2) + [" ".join(f"z{random.Random(k).randrange(500)}" for _ in range(40)) for k in range(100)]
    texts = dict(enumerate(made))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = minhash_of(df)
    assert got == brute_groups(texts) and len({c for _, c in got.values()}) > 100


def test_recall_at_the_least_similarity():
    """Pairs of exactly 80 percent share a table in all but about one in a thousand cases, and pass sketches and sizes."""
    rng = np.random.default_rng(3)
    for n in (1000, 100_000, 20_000_000):
        k, m = minhash.tables(n)
        lost = 0
        for _ in range(40):
            sets = []
            for _ in range(25):
                whole = rng.integers(0, 1 << 64, 270, dtype=np.uint64)
                sets += [np.sort(whole[:240 + 0]), np.sort(np.concatenate([whole[:213], whole[240:267]]))]
            size = np.array([len(s) for s in sets])
            begin = np.cumsum(size) - size
            h = np.concatenate(sets)
            first, second = minhash._keys(h, begin, k, m)
            sketch = minhash._sketches(h, begin, np.repeat(np.arange(len(sets)), size), len(sets))
            a, b = np.arange(0, len(sets), 2), np.arange(1, len(sets), 2)
            both = (first[a] == first[b]).any(1) & (second[a] == second[b]).any(1)
            near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1) <= minhash.APART
            lost += int((~(both & near)).sum())
        assert lost <= 8, (n, lost)  # of 1000; one is expected
    assert [minhash.tables(n) for n in (1000, 250_000, 15_000_000)] == [(2, 8), (3, 11), (4, 15)]


def test_near_duplicates_of_odd_rows(spark, odd, empty):  # noqa: F811
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()), key=repr)
    assert len(rows) == 12 and {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (10, 1, 4, False), (5, 4, 5, True), (6, 4, 5, False), (None, 1, None, True)} <= set(rows)
    assert rows.count((4, 1, 4, True)) == 2 and minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    with pytest.raises(ValueError, match="80"):
        minhash.near_duplicates(odd, similarity=70)


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))
    groups, path = {}, collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), k))

    def up(nodes):
        while len(nodes) > 1:
            above = []
            for i in range(0, len(nodes), 3):
                run = nodes[i : i + 3]
                for p, (_, members) in enumerate(run):
                    for m in members:
                        path[m].append(("".join(x[0] for x in run[:p]), "".join(x[0] for x in run[p + 1 :])))
                above.append((H("".join(x[0] for x in run)), [m for x in run for m in x[1]]))
            nodes = above
        return nodes[0]

    tops, subroot = [], {}
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops.append(up([(d, [k]) for _, d, k in own]))
        subroot |= dict.fromkeys(tops[-1][1], tops[-1][0])
    root = up(tops)[0]
    out = []
    for k, r in enumerate(rows):
        odd_id = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        folded = leaf(r, r["text"].replace("\n", "") if odd_id and r["text"] is not None else r["text"])
        for before, after in path[k]:
            folded = H(before + folded + after)
        out.append((r["doc_id"], leaf(r, r["text"]), subroot[k], root, H("".join(b + a for b, a in path[k])), folded, folded == root))
    return sorted(out, key=repr)


def manifest_of(df):
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=repr)


def test_manifest_by_brute_force(spark, odd, empty):  # noqa: F811
    df = common.table(spark, SF, "documents")
    got = manifest_of(df)
    assert got == brute_manifest([r.asDict() for r in df.collect()]) and {r[-1] for r in got} == {True, False}
    own = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert manifest_of(odd) == brute_manifest([r.asDict() for r in own.collect()])
    assert manifest_of(empty) == []


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [3, 4], [1, 9, 10, 28], [1] * 11])
def test_manifest_shapes(spark, sizes):
    rows = [(k * 100 + i, f"line {i}\n", "en", f"s{k}é" if k else None, i) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert manifest_of(df) == brute_manifest([r.asDict() for r in df.collect()])


def brute_clusters(rows, k=8, rounds=10):
    x = [(i, [math.floor(1024 * v) if abs(v) < 1e300 else int(v) * 1024 for v in e]) for i, e in rows]
    c = [list(v) for _, v in sorted(x, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        members = [[] for _ in c]
        for _, v in x:
            members[near(v)[1]].append(v)
        c = [[sum(q) // len(m) for q in zip(*m)] if m else w for m, w in zip(members, c)]
    final = [(i, *near(v)) for i, v in x]
    total = collections.Counter()
    for _, d, j in final:
        total[j] += d
    clip = lambda v: min(v, (1 << 63) - 1)
    return sorted((i, j, clip(d), clip(total[j]), clip(sum(total.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in final)


def clusters_of(df):
    return sorted(tuple(r) for r in centroids.cluster(df).collect())


def test_clusters_by_brute_force(spark):
    df = common.table(spark, SF, "embeddings")
    assert clusters_of(df) == brute_clusters([(r["vec_id"], list(map(float, r["embedding"]))) for r in df.collect()])


def test_clusters_of_large_components_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 64) * 10.0 ** int(rng.choice([0, 3, 7, 20, 300]))).tolist()) for i in range(60)] + [(100 + i, [0.0] * 64) for i in range(9)] + [(200, [-0.0001] * 64), (201, [1.7e308] * 64)]
    assert clusters_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)) == brute_clusters(rows)


def test_products_and_integers_agree():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(500, 64)) * (1 << 18))
    c = np.floor(rng.normal(size=(8, 64)) * (1 << 18)).astype(np.int64).astype(object)
    assert (np.abs(x).max() <= centroids._bound(64)) and centroids.distances(x, c).dtype == np.float64
    assert centroids.distances(x, c).astype(np.int64).tolist() == centroids.distances(x.astype(np.int64).astype(object), c).tolist()
    assert centroids.distances(x, c * 1000).dtype == object and 4 * 64 * centroids._bound(64) ** 2 < 1 << 53


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = lambda x: [x] + [0.0] * 63
    rows = [(1, v(1.0)), (1, v(1.0)), (2, None), (3, [0.0] * 63), (4, v(nan)), (5, v(inf)), (6, [None] + [0.0] * 63), (7, v(5.0)), (None, v(5.0)), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit(1)).withColumn("x", F.lit("a")).withColumn("n", F.lit(None))
    got = [tuple(r) for r in centroids.cluster(df).collect()]
    assert sorted(map(repr, (r[0] for r in got))) == ["1", "1", "7", "None"] and all(r[2] == r[3] == r[4] == 0 for r in got)
    assert centroids.cluster(df.where("vec_id = 2")).count() == 0
