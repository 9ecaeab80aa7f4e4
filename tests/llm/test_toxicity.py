"""Toxicity: held-out accuracy, whole texts, defined edges."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import toxicity


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    clean = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(800)]
    bad = ["moronic", "idiotish", "stupidly"]
    out = []
    for i in range(n):
        w = list(rng.choice(clean, rng.choice([8, 60, 600])))
        if i % 3 == 0:
            for at in rng.integers(0, len(w), max(1, len(w) // 50)):
                b = str(rng.choice(bad))
                w[at] = b[:2] + "x" + b[2:] if rng.random() < 0.2 else b
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows], "doc_id long, text string, source string, toxicity_old double").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, rows=300)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "toxicity"]
    got = {r.doc_id: r.toxicity for r in scored.collect()}
    unseen = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == y for i, y in unseen]) > 0.95
    assert all(0 <= v <= 1 for v in got.values())
    edges = model.score(pa.array([None, "", " \n", "...", "A stupidly thing", "word " * 20000 + "moronic idiotish stupidly"]))
    assert (edges[:4] < 0.5).all() and edges[4] > 0.5 and edges[5] > 0.5


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, empty)).first().toxicity < 0.5
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), empty)).count() == 0


def test_texts_without_words():
    model = toxicity.fit([None, "", "..."], [0, 0, 1])
    assert (model.score(pa.array(["", "a b"])) < 0.5).all()


def test_one_known_word_among_unseen_ones():
    """A toxic word counts in a short text whose other words the model has never met."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    bad = ["idiotx", "moronz", "stupidq"]
    texts = [" ".join([word() for _ in range(rng.choice([20, 100]))] + ([str(rng.choice(bad))] if i % 4 == 0 else [])) for i in range(400)]
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(400)])
    toxic = [" ".join([word() for _ in range(10)] + [str(rng.choice(bad))] + [word() for _ in range(9)]) for _ in range(60)]
    clean = [" ".join(word() for _ in range(20)) for _ in range(200)]
    assert (model.score(pa.array(toxic)) >= 0.5).mean() >= 0.95 and (model.score(pa.array(clean)) >= 0.5).mean() <= 0.02


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_documents_of_the_test_tables(spark):
    """One in twenty toxic documents there has no toxic word (junk texts with a random mark), so recall cannot reach 1."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = docs.select("doc_id", "text").join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(known, toxicity.train(docs, labels)).select("toxic", "toxicity").toPandas()
    flagged = got.toxicity >= 0.5
    assert flagged[got.toxic == 1].mean() >= 0.85 and flagged[got.toxic == 0].mean() <= 0.02


def test_repeated_rows_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "bad word"), (1, "bad word"), (1, "another text"), (2, None), (3, "x " * 90_000 + "bad word")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)] + [(1, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 5 and len({r.toxicity for r in got if r.text == "bad word"}) == 1


def test_long_labelled_texts_take_part(spark):
    """All texts are longer than a fitting text may be; what they hold over their length still teaches the model."""
    rng = random.Random(5)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(120):
        words = [rng.choice(clean) for _ in range(3000)]
        if i % 3 == 0:
            words = [w if rng.random() < 0.9 else rng.choice(["vile", "scum", "filth"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, bytes_each=1 << 12)
    fresh = spark.createDataFrame([(1, "w1 w2 w3 vile scum w4"), (2, "w1 w2 w3 w4 w5 w6")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(fresh, model).collect()}
    assert got[1] > got[2] + 0.2
    spread = docs.select(toxicity._spread(docs.text, 1 << 12).alias("s"), "text").collect()
    assert all(len(r.s) <= (1 << 12) + 64 and r.s.startswith(r.text[:50]) and r.s.endswith(r.text[-50:]) for r in spread)
    assert docs.limit(1).select(toxicity._spread(docs.text, 1 << 20).alias("s"), "text").collect()[0].s == rows[0][1]


def test_the_driver_holds_few_n_grams_at_a_time(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 11))) for _ in range(4000)]
    texts = [None, "", " ."] + [" ".join(rng.choice(names, 300)) for _ in range(600)]
    y = np.arange(len(texts)) % 2
    tracemalloc.start()
    corpus = toxicity._corpus(texts, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20  # 93 MB with runs of 512 KiB that each kept all of their words, 11 MB now
    monkeypatch.setattr(toxicity, "FIT_RUN", 1 << 30)
    whole = toxicity._corpus(texts, y)
    for name in ("text_word", "bounds", "grams", "gram_at"):
        assert np.array_equal(getattr(corpus, name), getattr(whole, name))
    assert toxicity._corpus([None, " "], y[:2]) is None
