"""Connected components against a plain version, and what Spark's planner is left with after many rounds."""

import random

from ledgerflow.llm.components import components


def plain(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_equals_a_plain_version(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(190)] + [(None, 3), (7, None), (9, 9), (500, 501), (501, 500)]
    got = [tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and dict(got) == plain(pairs)
    assert components(spark.createDataFrame([(4, 4), (None, 1)], "a long, b long")).count() == 0


def test_the_planner_is_not_left_with_a_size_that_grows_with_the_rounds(spark):
    order = list(range(300))
    random.Random(8).shuffle(order)
    got = components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long"))
    size = got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 10**9  # of links of 300 nodes
    assert {tuple(r) for r in got.collect()} == {(x, 0) for x in range(300)}
