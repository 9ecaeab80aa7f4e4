"""MinHash near-duplicates against all-pairs Jaccard."""

import random
import re

import pytest

from ledgerflow.llm.minhash_dedup import near_duplicates

SCHEMA = "doc_id long, text string, n_shingles string, node int, kept string"


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", " \n\t", "one", "one two", "One  TWO", "É été", "x " * 4000, "x " * 4001]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 2, 12])):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    base = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(200):  # a large group in a chain, some members of which match few others
        copy = base[:]
        for _ in range(rng.choice([1, 3, 5, 7])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, k, percent):
    rows = [(1000 - i, t) for i, t in enumerate(texts())]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d", "x", 1, "y"), (1, "a b c d", "x", 1, "y"), (None, "a b c d", "x", 1, "y"), (0, "A b c d", "x", 1, "y")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect())
    assert got == [(-1, None, True), (0, 0, True), (1, 0, False), (1, 0, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_several_texts_of_one_id(spark):
    """Texts link, not ids: brute force over the texts, then the smallest id of each component."""
    rng = random.Random(9)
    rows = [(rng.randrange(60), t) for t in texts(5) if t and len(t) < 4000]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    by_text = brute(list(enumerate(t for _, t in rows)), 3, 85)
    ids = {}
    for n, (i, _) in enumerate(rows):
        root = by_text[n][1]
        ids[root] = min(ids.get(root, i), i)
    want = sorted((i, by_text[n][0], ids[by_text[n][1]], i == ids[by_text[n][1]]) for n, (i, _) in enumerate(rows))
    found = near_duplicates(frame, 3, 85, with_row=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == want
    heads = {r.row_hash for r in found if r.first}
    assert len(heads) == len(set(ids)) and all(r.kept for r in found if r.first)
