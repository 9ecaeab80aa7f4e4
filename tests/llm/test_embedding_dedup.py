"""Embedding near-duplicates against all-pairs cosine."""

import numpy as np

from ledgerflow.llm.embedding_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, row string, list string"


def brute(rows, threshold):
    good = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    label, count = {i: i for i, _, _ in rows}, dict.fromkeys((i for i, _, _ in rows), 0)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, (i, x, c) in enumerate(good):
        for j, y, d in good[:a]:
            if c == d and i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                count[i] += 1
                count[j] += 1
                low, high = sorted((find(i), find(j)))
                label[high] = low
    return {i: (count[i], find(i), find(i) == i) for i in label}


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(700):
        b = base[rng.integers(60) if i % 3 else 0]
        rows.append((5000 - i, (b + rng.normal(scale=rng.choice([0.02, 0.12, 0.2]), size=16)).astype(np.float32).tolist(), int(rng.integers(2))))
    rows += [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None, *[1.0] * 15], 1), (9005, rows[0][1], None), (9006, [], 0)]
    rows += [(9007, [2 * v for v in rows[0][1]], rows[0][2]), (9008, [1.0, 2.0], 0), (9009, [1.0, 2.0], 0), (9010, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(frame, 0.98).collect()}
    want = brute(rows, 0.98)
    assert got == want
    assert sum(n for n, _, _ in want.values()) > 1000


def test_nulls_repeats_and_empty(spark):
    v = [1.0, 0.5]
    rows = [(3, v, 1, "", ""), (3, v, 1, "", ""), (2, v, 1, "", ""), (None, v, 1, "", "")]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, None, True), (2, 1, 2, True), (3, 1, 2, False), (3, 1, 2, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1e200], 1), (3, [1e-200, 0.0], 1), (4, [3e-310, 0.0], 1), (5, [1.0, 1.0], 1), (6, [1e308, -1e308], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(frame, 0.98).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3), 6: (0, 6)}
