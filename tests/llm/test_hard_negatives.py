"""Hard negatives against plain loops over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import hard_negatives as h
from ledgerflow.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import difference

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, anchor string"


def brute(rows, every=10, positives=5, negatives=10, scale=16):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all():
            x = tuple(math.floor(scale * float(np.float32(c))) for c in v)
            kept[i] = min(kept.get(i, (label, x)), (label, x))
    out = []
    for a, (label, x) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == label) for i, (other, y) in kept.items() if i != a and len(y) == len(x))
        for s, i, _ in [r for r in scored if r[2]][:positives]:
            band = [r for r in scored if not r[2] and 30 * -s <= 100 * -r[0] <= 90 * -s]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j, _) in enumerate(band[:negatives], 1)]
    return sorted(out)


def found(frame, every=10, **options):
    return sorted(tuple(r) for r in h.hard_negatives(frame, F.col("vec_id") % every == 0, scale=16, **options).collect())


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize(("spread", "dimension"), [(1.0, 4), (0.1, 3), (1.0, 20)])
def test_equals_plain_loops(spark, monkeypatch, spread, dimension):
    monkeypatch.setattr(h, "BLOCK", 16)
    rng = np.random.default_rng(dimension)
    base = rng.normal(size=(6, dimension))
    rows = [(i, (base[rng.integers(6)] + rng.normal(scale=spread, size=dimension)).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(500)]
    rows += [(2000 + i, rows[0][1], i % 3) for i in range(250)]  # a third are copies of one vector, under three labels
    rows += [rows[7], (rows[20][0], rows[3][1], 0), (9000, rows[1][1], 99), (9010, None, 1), (None, rows[1][1], 1), (9020, rows[1][1], None), (9030, [], 1)]
    rows += [(9040, [None] * dimension, 1), (9050, [float("nan")] * dimension, 1), (9060, [1.0, 2.0], 1), (9070, [2.0, 2.0], 1), (9071, [1.0, 1.5], 2)]
    want = brute(rows)
    assert found(frame_of(spark, rows).repartition(3)) == want and len(want) > 1000


def test_few_rows_ties_and_empty(spark):
    rows = [(i, [1.0, float(i % 3)], i % 2) for i in range(25)]
    assert found(frame_of(spark, rows)) == brute(rows)
    assert found(frame_of(spark, rows[:1])) == [] and found(frame_of(spark, rows[:0])) == []
    zero = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2), (3, [5.0, 1.0], 2)]
    assert found(frame_of(spark, zero)) == brute(zero) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]
    negative = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]
    assert found(frame_of(spark, negative)) == brute(negative) == []


def test_extreme_components_are_held_within_bounds(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 0.0], 1), (2, [1e38, 0.0], 2), (3, [1.0, 1.0], 2), (4, [-3e38, 0.0], 2)]
    got = found(frame_of(spark, rows))
    bound = math.floor(math.sqrt(2**55 / 2))
    assert all(r[0] == 0 and r[4] == bound * bound for r in got) and not [r for r in got if r[3] == 4]


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (1000, 1 << 24):
        a, b = rng.integers(-most, most, (9, 64)).astype(np.int32), rng.integers(-most, most, (7, 64)).astype(np.int32)
        assert h.products(a, b).tolist() == [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_centroid_clustering"])
def test_queries_against_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.01") == ""
