import hashlib
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsearch.llm.centroids import BLOCK, Clustering, candidates, centroid_clusters, curve_blocks, hilbert_keys, nearest, whole_numbers
from tarnsearch.llm.vectordedup import VectorDedup, farthest_first, near_duplicate_vectors

VECTORS = "vec_id bigint, embedding array<float>, label int"
ODD = [
    (None, [1.0, 2.0], 0),
    (None, None, 0),
    (1, None, 0),
    (2, [], 0),
    (3, [0.0, 0.0], 0),
    (4, [1.0, None], 0),
    (5, [1.0, math.nan], 0),
    (6, [1.0, math.inf], 0),
    (7, [2.0, 4.0], None),
    (7, [-1.0, 0.0], 1),
    (8, [2.0, 4.0], 1),
    (9, [-3.0, 0.0], 1),
    (10, [1e38, 2e38], 1),
    (11, [1e-40, 2e-40], 1),
    (12, [1.0, 2.0, 0.0], 1),
    (13, [1.0, 2.0, 0.1], 1),
    (14, [5.0], 1),
    (15, [-5.0], 1),
]


def linked_rows(rows, cosine):
    """Per row its links, per id its component, all pairs compared."""
    units = []
    for vec_id, v, _ in rows:
        good = v and all(x is not None and math.isfinite(x) for x in v) and any(np.float32(x) != 0 for x in v)
        x = np.array(v, np.float32).astype(float) if good else None
        units.append(x / np.abs(x).max() if good else None)
    key = [-(2**63) if r[0] is None else r[0] for r in rows]
    links, parent = [0] * len(rows), {k: k for k in key}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = units[i], units[j]
        if a is None or b is None or len(a) != len(b) or a @ b / math.sqrt((a @ a) * (b @ b)) < cosine:
            continue
        links[i] += 1
        links[j] += 1
        x, y = sorted((root(key[i]), root(key[j])))
        parent[y] = x
    return sorted((k, n, root(k), root(k) == k) for k, n in zip(key, links))


def found_rows(frame):
    low = -(2**63)
    return sorted(
        (low if r.vec_id is None else r.vec_id, r.n_links, low if r.component_id is None else r.component_id, r.kept)
        for r in frame.collect()
    )


def families(seed, n, dim, spread, sizes):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.normal(size=dim)
        for _ in range(sizes[k % len(sizes)]):
            v = base + spread * rng.normal(size=dim) * np.linalg.norm(base) / math.sqrt(dim)
            rows.append([float(x) for x in np.float32(v * rng.uniform(0.5, 3))])
    order = rng.permutation(len(rows))
    return [(int(i), rows[j], 0) for i, j in enumerate(order)]


@pytest.mark.parametrize(
    "dim, spread, how",
    [
        (8, 0.2, VectorDedup(residents=16, visitors=40, sample=30)),  # many cells, blocks and chunks
        (64, 0.15, VectorDedup(residents=32, visitors=1000)),
        (3, 0.3, VectorDedup(cosine=0.99, residents=8, visitors=20)),
        (8, 0.2, VectorDedup()),  # one unit
    ],
)
def test_links_equal_brute_force(spark, dim, spread, how):
    rows = families(dim, 30, dim, spread, [1, 4, 30])
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)]
    found = found_rows(near_duplicate_vectors(spark.createDataFrame(rows, VECTORS), how))
    assert found == linked_rows(rows, how.cosine)
    assert any(n for _, n, _, _ in found)


def test_odd_vectors(spark):
    frame = spark.createDataFrame(ODD, VECTORS)
    for name in ("id", "vec", "k", "n", "node", "h", "home", "kept", "n_links", "component"):
        frame = frame.withColumn(name, F.lit("x"))
    assert found_rows(near_duplicate_vectors(frame)) == linked_rows(ODD, 0.95)
    doubles = frame.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert found_rows(near_duplicate_vectors(doubles)) == linked_rows(ODD, 0.95)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert near_duplicate_vectors(empty).count() == 0 and centroid_clusters(empty).count() == 0
    bad = spark.createDataFrame([(1, None, 0), (1, [0.0], 0)], VECTORS)
    assert found_rows(near_duplicate_vectors(bad)) == [(1, 0, 1, True)] * 2


def test_pivots_are_apart():
    rows = np.random.default_rng(0).normal(size=(200, 5))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[100:] = rows[:1]
    chosen = farthest_first(rows, 50, 0.6)
    angles = np.arccos(np.clip(rows[chosen] @ rows[chosen].T, -1, 1))
    assert angles[~np.eye(len(chosen), dtype=bool)].min() > 0.6
    assert np.arccos(np.clip(rows @ rows[chosen].T, -1, 1)).min(axis=1).max() <= 0.6


# ---- centroids


def brute_clusters(rows, how):
    kept = [
        (i, [max(-(2**27), min(2**27, math.floor(how.scale * float(np.float32(x))))) for x in v])
        for i, v, _ in rows
        if v is not None and len(v) == how.width and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = [hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept]
    centroids = [list(kept[j][1]) for j in sorted(range(len(kept)), key=lambda j: (name[j], kept[j][1]))[: how.k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(how.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, members in groups.items():
            centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, n in last:
        inertia[n] = inertia.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((-1 if i is None else i), n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in last
    )


def clusters(frame, how):
    return sorted(
        (-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
        for r in centroid_clusters(frame, how).collect()
    )


@pytest.mark.parametrize("how", [Clustering(k=5, rounds=3, width=8), Clustering(k=16, rounds=1, width=3, bits=2), Clustering(k=400, width=8)])
def test_clusters_equal_brute_force(spark, how):
    rows = families(how.k, 12, how.width, 0.2, [1, 5, 40])
    rows += [(None, rows[0][1], 1), (3, rows[1][1], 1), (2000, rows[0][1][:-1], 1), (2001, None, 1)]
    rows += [(2002, [math.nan] * how.width, 1), (2003, [1e30] * how.width, 1), (2004, [None] * how.width, 1), (2005, [], 1)]
    frame = spark.createDataFrame(rows, VECTORS)
    for name in ("id", "vec", "block", "cluster", "lo"):
        frame = frame.withColumn(name, F.lit("x"))
    assert clusters(frame, how) == brute_clusters(rows, how)


def test_curve_goes_by_single_steps():
    for bits, dim in ((3, 2), (2, 3), (1, 4)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dim, indexing="ij"), -1).reshape(-1, dim)
        keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[np.argsort(np.array(keys, object))]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_the_nearest():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-50, 50, (40, 6))
    rows = rng.integers(-5, 5, (100, 6)) + 20
    among = candidates(rows.min(axis=0), rows.max(axis=0), centroids)
    assert len(among) < 30
    for a, b in zip(nearest(rows, centroids, among), nearest(rows, centroids, np.arange(40))):
        assert (a == b).all()
    big = rows * 2**20
    exact = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(r, c)), n) for n, c in enumerate(centroids * 2**20)) for r in big]
    cluster, distance = nearest(big, centroids * 2**20, np.arange(40))
    assert exact == list(zip(distance.tolist(), cluster.tolist()))
    assert whole_numbers(np.array([-0.001, 0.999 / 64, 1e300]), 64).tolist() == [-1, 0, 2**27]


def test_blocks_are_narrow(spark):
    """In curve order most centroids of clustered vectors are no candidates of a block."""
    how = Clustering(k=10, width=4)
    rows = families(2, 10, 4, 0.02, [300])
    blocks = curve_blocks(spark.createDataFrame(rows, VECTORS), how).collect()
    heads = [r for r in blocks if r.lo is not None]
    assert len(blocks) == len(rows) and len(heads) >= len(rows) / BLOCK
    centroids = np.array([whole_numbers(np.array(rows[i][1]), 64) for i in range(0, 300, 30)])
    shares = [len(candidates(np.array(r.lo), np.array(r.hi), centroids)) / len(centroids) for r in heads]
    assert np.mean(shares) < 0.8
