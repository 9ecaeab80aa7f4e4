"""Repeated passages against a search over all 50-word windows."""

import random

import numpy as np
import pytest

from ledgerflow.llm import suffix_dedup as sd
from ledgerflow.llm.words import CHUNK_BYTES

SCHEMA = "doc_id long, text string, row string, key int, spans string"


def brute(rows):
    seen, covered = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").lower().split()
        marks = np.zeros(len(w), bool)
        for a in range(len(w) - sd.PASSAGE + 1):
            gram = tuple(w[a : a + sd.PASSAGE])
            if seen.setdefault(gram, i) < i:
                marks[a : a + sd.PASSAGE] = True
        covered[i] = marks
    return covered


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Aa", "bb", "cc"]) + str(rng.randrange(5000))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 200, 30)]
    rows = [(900, None), (901, ""), (902, "x " * 200), (903, "x " * 300), (904, "y z " * 100)]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append([word() for _ in range(rng.randrange(0, 120))])
            if rng.random() < 0.7:
                parts.append(rng.choice(shared))
        rows.append((i * 2, " ".join(w for p in parts for w in p)))
    rows += [(2000 + k, rows[20][1]) for k in range(30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, "r", 3, "s") for r in rows], SCHEMA).repartition(4)
    marks = {i: np.zeros(len((t or "").split()), bool) for i, t in rows}
    texts = dict(rows)
    for r in sd.spans_by_document(frame).collect():
        assert not marks[r.doc_id][r.start_word : r.end_word].any() and r.n_words == r.end_word - r.start_word >= sd.PASSAGE
        marks[r.doc_id][r.start_word : r.end_word] = True
        assert r.source_doc_id < r.doc_id
        assert " ".join(texts[r.doc_id].lower().split()[r.start_word : r.start_word + 50]) in " ".join(texts[r.source_doc_id].lower().split()) or r.n_words > 50
    want = brute(rows)
    assert {i: m.tolist() for i, m in marks.items()} == {i: m.tolist() for i, m in want.items()}
    cut = {r.doc_id: r for r in sd.without_repeats(frame).collect()}
    assert set(cut) == set(texts) and list(cut[900].asDict()) == frame.columns and cut[900].row == "r"
    for i, m in want.items():
        if texts[i] is None:
            assert cut[i].text is None
        else:
            assert cut[i].text.split() == [w for w, gone in zip(texts[i].split(), m, strict=True) if not gone]


def test_repeated_rows_null_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], "doc_id long, text string")
    got = sorted(r.text for r in sd.without_repeats(frame).collect())
    assert got == ["", "", text, text]
    assert sd.without_repeats(frame.limit(0)).count() == 0
    assert sd.spans_by_document(frame.limit(0)).count() == 0


def test_hot_passages_take_the_other_way(spark):
    """With many partitions the keys of common passages are hot; the spans are the same."""
    rows = corpus(3)
    frame = spark.createDataFrame([(*r, "r", 3, "s") for r in rows], SCHEMA).repartition(4)
    ordinary = {(r.row, tuple(r.spans)) for r in sd.repeated_spans(frame).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        _, hot = sd.hot_cells(frame.select("doc_id", "text").filter("text is not null"))
        assert len(hot) > 20
        assert {(r.row, tuple(r.spans)) for r in sd.repeated_spans(frame).collect()} == ordinary
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_very_long_text(spark):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(9000)}" for _ in range(70))
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(300_000))
    assert len(long) > CHUNK_BYTES
    rows = [(1, long + " " + passage), (2, "a b c " + passage), (3, "nothing to see")]
    got = [tuple(r) for r in sd.spans_by_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(2, 3, 73, 70, 1)]
