"""LM scores: exact counts and base scores, a normalised model, better than the base on held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerflow.llm import lm_scoring
from ledgerflow.llm.lm_scoring import score_documents

SCHEMA = "doc_id long, text string, portion int, counts string"


def split(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    languages = [["".join(rng.choice(list(letters), rng.integers(2, 6))) for _ in range(300)] for letters in ("abcdef", "uvwxyz")]
    out = [(1, None), (2, ""), (3, " \n"), (4, "Only ÉÀ words"), (None, "no id here"), (4, "Only ÉÀ words")]
    for i in range(10, 400):
        vocabulary = languages[i % 2]
        out.append((i, " ".join(vocabulary[int(x)] for x in 300 * rng.random(rng.integers(1, 80)) ** 3)))
    return out


def test_counts_base_and_gain(spark, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEPS", 400)
    frame = spark.createDataFrame([(*r, 5, "c") for r in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.base_score), r) for r in score_documents(frame).collect())
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or 0, len(split(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), sum(counts[w] > 0 for w in split(t)), out(i)) for i, t in rows)
    assert len(got) == len(want)
    for (_, r), (i, size, base, known, held_out) in zip(got, want, strict=True):
        assert (r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (i, size, known, n, held_out)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0
    unseen = [r for _, r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_model_is_normalised(spark, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEPS", 100)
    frame = spark.createDataFrame([(i, t, True, (i or 0) % 3) for i, t in rows], "doc_id long, text string, learn boolean, portion int")
    model, totals = lm_scoring.train(frame)
    size = model.classes.number
    u, v, w = np.indices((size, size, size)).reshape(3, -1)
    assert np.allclose((10.0 ** model.table.of(u, v, w)).reshape(size, size, size).sum(2), 1, atol=1e-4)
    h, c = (np.concatenate(x) for x in zip(*(lm_scoring.unpack_counts(r.counts) for r in totals.filter("portion = -1").collect()), strict=True))
    cls = model.classes.of(h)
    inside = 10.0 ** model.log_in_class(cls, c.astype(np.int64))
    mass = np.bincount(cls, weights=inside, minlength=size)
    groups = np.arange(size) >= model.classes.half
    mass[groups] += 1 / (model.class_tokens + model.class_types + 1)[groups]
    used = np.unique(cls)
    assert np.allclose(mass[used], 1)


def test_classes_and_steps_grow_with_the_corpus():
    assert [lm_scoring.classes_for(n) for n in (0, 10**6, 85 * 10**6, 5 * 10**9)] == [64, 64, 83, 165]


def test_draws_reach_every_block_in_proportion():
    rng = np.random.default_rng(5)
    heavy = (np.array([7]), np.array([5000]))
    blocks = [(np.array([10, 11]), np.array([3000, 1000])), (np.array([20]), np.array([1000]))]
    got = np.concatenate(list(lm_scoring.draws(heavy, iter(blocks), 5000, 100, rng)))
    assert len(got) == 100 * lm_scoring.BATCH
    for cell, share in ((7, 0.5), (10, 0.3), (11, 0.1), (20, 0.1)):
        assert np.mean(got == cell) == pytest.approx(share, abs=0.01)
    alone = np.concatenate(list(lm_scoring.draws(heavy, iter([]), 0, 3, rng)))
    assert set(alone) == {7} and len(alone) == 3 * lm_scoring.BATCH


def test_counts_beyond_32_bits_survive():
    h, c = lm_scoring.unpack_counts(lm_scoring.pack_counts(np.array([3], np.uint64), np.array([5 << 33])))
    assert (int(h[0]), int(c[0])) == (3, 5 << 33)


def test_tokens_keep_the_shape_of_unseen_words():
    ((_, _, h, bounds),) = list(lm_scoring.tokens(pa.array(["Abc abc ABc", None, "abd"], pa.string())))
    assert h[0] == h[1] == h[2] and h[0] != h[5] and list(bounds) == [0, 4, 5, 7] and int(h[3]) == lm_scoring.END


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
