"""Clusters with bounds against plain rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from ledgerflow.llm.centroid_clustering import MOST, cluster, clusters, seeds, squared_distances, whole_components
from ledgerflow.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, row string, cluster string"


def brute(rows, k, rounds, scale, dimension, seed=3):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v and len(v) == dimension and None not in v and np.isfinite(v).all()]
    order = sorted(whole, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(column) // len(vs) for column in zip(*vs)]
    at = [(i, *nearest(v)[::-1]) for i, v in whole]
    inertia = {n: sum(d for _, m, d in at if m == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, n, d in at)


def found(frame, **options):
    return sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clusters(frame, **options).collect())


@pytest.mark.parametrize(("k", "rounds", "spread"), [(5, 6, 0.05), (8, 10, 1.0), (1, 3, 1.0), (4, 0, 0.3)])
def test_equals_plain_rounds(spark, k, rounds, spread):
    rng = np.random.default_rng(k)
    base = rng.normal(size=(7, 6))
    rows = [(i, (base[rng.integers(7)] + rng.normal(scale=spread, size=6)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(rows[3][0], rows[3][1])]  # a third are copies, one row is repeated
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    assert found(frame, k=k, rounds=rounds, scale=64, dimension=6) == brute(rows, k, rounds, 64, 6)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x)]) for i, x in enumerate([0, 4, 2, 2, 2, -1, 5])]
    frame = spark.createDataFrame([(i, v, 1, "", "") for i, v in rows], SCHEMA)
    assert found(frame, k=2, rounds=4, scale=1, dimension=1) == brute(rows, 2, 4, 1, 1)
    near = cluster(spark.createDataFrame([(1, [2])], "vec_id long, vector array<int>"), [[0], [4]], 0)
    assert [tuple(r) for r in near.rows.collect()] == [(1, 0, 4)]


def test_bounds_spare_most_scans_and_move_no_result(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(4, 8)) * 10
    rows = [(i, (base[i % 4] + rng.normal(size=8)).astype(np.float32).tolist()) for i in range(800)]
    frame = whole_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 100, 8)
    done = cluster(frame, seeds(frame, 4, 3), 10)
    assert done.scanned[0] == 800 and sum(done.scanned[1:]) < 400 * (len(done.scanned) - 1)


def test_left_out_extreme_and_empty(spark):
    v = [1.0, 2.0]
    rows = [(1, v), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1e30, -1e30]), (8, [])]
    frame = spark.createDataFrame([(i, x, None, "", "") for i, x in rows], SCHEMA)
    got = found(frame, k=8, rounds=2, scale=4, dimension=2)
    assert [r[0] for r in got] == [1, 7] and all(r[2] == 0 for r in got)
    one = found(frame, k=1, rounds=0, scale=4, dimension=2)
    assert max(r[2] for r in one) == (MOST - 4) ** 2 + (MOST + 8) ** 2
    null_id = spark.createDataFrame([(None, v, 1, "", ""), (2, v, 1, "", "")], SCHEMA)
    assert sorted((r.vec_id or 0, r.cluster) for r in clusters(null_id, k=1, dimension=2).collect()) == [(0, 0), (2, 0)]
    assert clusters(frame.limit(0), dimension=2).count() == 0


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    for most in (1000, 1 << 27):
        x, c = rng.integers(-most, most, (20, 64)), rng.integers(-most, most, (3, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, w)) for w in c] for u in x]
        assert squared_distances(x, c).tolist() == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in QUERIES["op12_centroid_clustering"](spark, sf).collect())
    assert got == brute(rows, 8, 10, 1024, 64)
