"""Clusters against plain k-means over whole numbers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from rosterline.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string, v int"


def rows_of(n=400, seed=2, length=64):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(length)] for _ in range(20)]
    out = [(i, [x + draw.gauss(0, 0.3) for x in draw.choice(middles)], 0, 1, "d", 2) for i in range(n)]
    out += [out[3], out[3], (None, out[5][1], 0, 1, "d", 2), (9001, None, 0, 1, "d", 2), (9002, [], 0, 1, "d", 2)]
    out += [(9003, [0.5] * (length - 1), 0, 1, "d", 2), (9004, [None, *[0.5] * (length - 1)], 0, 1, "d", 2)]
    out += [(9005, [math.nan, *[0.5] * (length - 1)], 0, 1, "d", 2), (9006, [-math.inf, *[0.5] * (length - 1)], 0, 1, "d", 2)]
    return out + [(10_000 + i, [0.25] * length, 0, 1, "d", 2) for i in range(60)]


def plain(rows, k=16, rounds=3, scale=64, seed=1, length=64):
    kept = [(r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]]) for r in rows
            if r[1] and len(r[1]) == length and all(x is not None and math.isfinite(x) for x in r[1])]
    name = lambda i: "null" if i is None else str(i)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{name(r[0])}".encode()).hexdigest(), r[1]))
    middles = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        middles = [[sum(column) // len(groups[j]) for column in zip(*groups[j])] if j in groups else c for j, c in enumerate(middles)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found)


NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def got(df):
    return Counter(tuple(row[name] for name in NAMES) for row in df.collect())


def test_query(spark, tmp_path):
    rows = rows_of()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op12_centroid_clustering(spark, str(tmp_path))
    assert out.columns == NAMES
    assert got(out) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 40])
def test_few_vectors_and_many_rounds(spark, n):
    rows = rows_of(n=max(n, 6), length=3)[:n]
    vectors = centroids.whole_vectors(spark.createDataFrame(rows, SCHEMA), 3, 8)
    assert got(centroids.clustering(vectors, k=7, rounds=12, seed=4)) == plain(rows, 7, 12, 8, 4, 3)


def test_bounds_hold_and_save_scans(spark):
    rows = rows_of(n=2000)
    vectors = centroids.whole_vectors(spark.createDataFrame(rows, SCHEMA), 64, 64)
    found, _ = centroids.clusters(vectors, 16, 8)
    scans = [row["rescans"] for row in found.collect()]
    assert max(scans) <= 9 and sum(scans) < 0.7 * 9 * len(scans)


def test_total_displacement_not_summed_drifts():
    there, back = [[0, 0], [100, 0]], [[0, 40], [100, 40]]
    history = np.array([there, back, there], dtype=np.int64)
    assert centroids.displacement(history)[0].tolist() == [0.0, 0.0]
    x = np.array([[45, 0]], dtype=np.int64)
    state = centroids.assign(x, None, history[:1])
    away = centroids.assign(x, state, history[:2])  # moved by 40 each, while the gap is 10: scanned again
    assert away["rescans"].tolist() == [2]
    kept = centroids.assign(x, state, history)  # evaluated in round 0 only: they came back, so the bounds are as tight as then
    assert kept["rescans"].tolist() == [1] and kept["round"].tolist() == [0]


def test_exact_beyond_floats():
    x = np.array([[2**28, 1], [2**28, 3]], dtype=np.int64)
    middles = np.array([[-(2**28), 1], [2**28, 2]], dtype=np.int64)
    assert centroids.squared_distances(x, middles).tolist() == [[2**58, 1], [2**58 + 4, 1]]
