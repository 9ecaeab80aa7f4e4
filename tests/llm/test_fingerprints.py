"""Fingerprints: edits and order against plain Python, homomorphism, likeness."""

import hashlib

import numpy as np
import pyarrow as pa

from ledgerflow.llm import fingerprints as fp


def of(text):
    return fp.as_text(*fp.vectors(pa.array([text], pa.string())))[0]


def test_paragraph_order_and_increments():
    assert of("one line here\nand two\nthree") == of("three\none line here\nand two")
    assert of("a b c\nd") != of("a b c\ne")
    assert fp.combine(of("a b c\nd e"), of("new words here")) == of("new words here\na b c\nd e")
    assert fp.combine(of("a b c\nd e"), of("d e"), -1) == of("a b c")
    assert of("") == of(None) == "0" * len(of("x"))


def test_edits_follow_the_next_document(spark):
    texts = [(i * 7, f"first {i} paragraph with words {i * i}\n" + "naïve é " * (i % 5) + "\nlast " * (i % 3)) for i in range(60)]
    texts += [(-5, None), (1000, ""), (1001, "x" * 3000 + "\ny"), (14, "again the same id")]
    frame = spark.createDataFrame([(*r, "z") for r in texts], "doc_id long, text string, pid string").repartition(5)
    got = sorted(fp.edited_fingerprints(frame).collect(), key=lambda r: (r.doc_id, r.fingerprint))
    order = sorted(((i, t or "") for i, t in texts))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), of(t), of(edited)))
    want.sort(key=lambda r: (r[0], r[3]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got] == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert fp.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    (row,) = fp.edited_fingerprints(spark.createDataFrame([(None, "abcd")], schema)).collect()
    assert (row.doc_id, row.n_chars, row.edited_sha256, row.near_next) == (None, 4, hashlib.sha256(b"abab").hexdigest(), 1.0)
    assert fp.fingerprints(spark.createDataFrame([(1, "a\nb"), (2, "b\na")], schema).coalesce(1)).select("fingerprint").distinct().count() == 1


def test_likeness_follows_what_is_shared():
    import numpy as np

    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    lines = [" ".join(word() for _ in range(30)) for _ in range(40)]
    equal, like = fp.vectors(pa.array(["\n".join(lines[:20]), "\n".join(lines[10:30]), "\n".join(lines[20:])]))
    half, none = fp.likeness(equal[[0]], like[[0]], equal[[1]], like[[1]])[0], fp.likeness(equal[[0]], like[[0]], equal[[2]], like[[2]])[0]
    assert abs(half - 0.5) < 0.2 and none < 0.25


def test_a_phrase_repeated_often_does_not_wrap():
    texts = ["one two three " * 100_000, "one two three " * 50_000, "one two three " * 13_000]
    equal, like = fp.vectors(pa.array(texts))
    assert abs(like.astype(int)).max() >= 99_999
    for k in (1, 2):
        assert fp.likeness(equal[[0]], like[[0]], equal[[k]], like[[k]])[0] > 0.99
    assert fp.combine(of("\n".join(texts[:2])), of(texts[1]), -1) == of(texts[0])


def test_likeness_against_counted_shingles():
    """The estimate against the cosine of all shingle counts."""
    from collections import Counter

    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, 400)) for _ in range(12)]
    pairs = []
    for t in texts:
        w = t.split()
        for share in (0.1, 0.5, 0.9):
            n = int(len(w) * share)
            pairs.append((t, " ".join(w[:n] + [f"v{x}" for x in rng.integers(0, 900, len(w) - n)])))
    pairs += [(texts[0] + "\n" + texts[1], texts[1] + "\n" + texts[0]), (texts[0], texts[0])]

    def counts(text):
        w = [line.split() for line in text.lower().split("\n")]
        return Counter(tuple(x[k : k + 3]) for x in w for k in range(len(x) - 2))

    def cosine(a, b):
        x, y = counts(a), counts(b)
        return sum(x[g] * y[g] for g in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5

    a, b = fp.vectors(pa.array([p[0] for p in pairs])), fp.vectors(pa.array([p[1] for p in pairs]))
    error = fp.likeness(*a, *b) - np.array([cosine(*p) for p in pairs])
    assert np.abs(error).max() < 0.25 and np.sqrt((error**2).mean()) < 0.08 and (error[-2:] == 0).all()
