"""Token files and packing against the tokenizers library and a plain best-fit-decreasing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from ledgerflow.llm import packing, token_output
from ledgerflow.llm.runtime import table_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "It's  two  blanks", "\n\n start", "end \n", "a\n\n\nb \n c", "tab\there\xa0wide　w", "日本 語  x",
    "one two\nthree, four.\nFive's six!", "\x1f!\x1c b", "<|endoftext|> x", "été Über\nß", "x" * 5000, "word " * 3000, "same same", "same same",
]
SCHEMA = "doc_id long, text string, part string, start string, length string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def frame(spark, texts=TEXTS, extra=()):
    rows = [(i * 3, t, "p", None, "9") for i, t in enumerate(texts)] + list(extra)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_every_text_in_order(spark, tokenizer):
    docs = frame(spark, extra=[(0, None, "p", None, "9"), (None, "no id", "p", None, "9")])
    path = table_path(spark, "tokens")
    token_output.write_tokens(docs, path, PATH, end=0)
    rows = token_output.read_tokens(spark, path).orderBy("start").collect()
    want = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in docs.collect())
    before = 0
    assert len(rows) == len(want)
    for row, (doc_id, text) in zip(rows, want, strict=True):
        ids = ids_of(tokenizer, text, 0)
        assert (row.doc_id if row.doc_id is not None else -1, row.start, row.n_tokens, row.ids) == (doc_id, before, len(ids), ids)
        before += len(ids)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in token_output.with_crc32(token_output.read_tokens(spark, path)).collect()}
    assert all(digests[r.doc_id, r.start] == crc(r.ids) for r in rows)


def test_token_files_of_an_empty_table(spark):
    path = table_path(spark, "tokens")
    token_output.write_tokens(spark.createDataFrame([], SCHEMA), path, PATH)
    assert token_output.read_tokens(spark, path).count() == 0


def test_token_files_have_dictionary_delta_and_indexes(spark, tmp_path):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/tokens"
    token_output.write_tokens(frame(spark, [f"text number {i} of many" for i in range(500)]), path, PATH)
    part = max(tmp_path.glob("tokens/part-*"), key=lambda p: p.stat().st_size)
    group = pq.ParquetFile(part).metadata.row_group(0)
    kinds = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings
    assert any("DICTIONARY" in e for e in kinds["ids.list.element"].encodings)
    assert kinds["doc_id"].has_offset_index and kinds["doc_id"].has_column_index


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    lengths = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 7)) for _ in range(rng.choice([1, 50, 700]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan, bins = packing.best_fit_plan(histogram, capacity)
    used = {}
    for n, slots in plan.items():
        for (at, first, offset), end in zip(slots, [s[0] for s in slots[1:]] + [histogram[n]], strict=True):
            for k in range(end - at):
                used.setdefault(first + k, []).append((offset, n))
    rooms = []
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
        rooms.append(capacity - at)
    assert len(used) == bins and sorted(rooms) == plain_best_fit(lengths, capacity)


def test_packing_places_every_piece_once(spark, tokenizer):
    docs = frame(spark, extra=[(0, None, "p", None, "9"), (None, "no id", "p", None, "9")])
    pieces = packing.cut_pieces(docs, PATH, end=2, capacity=64)
    rows = packing.pack(pieces, capacity=64).collect()
    assert len(rows) == pieces.count()
    whole = {}
    for r in docs.collect():
        whole.setdefault(r.doc_id, []).append(ids_of(tokenizer, r.text, 2))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert any(ids[r.start : r.start + r.length] == r.ids for ids in whole[r.doc_id])
        assert r.length == 64 or r.piece == 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(sequences) == len(plain_best_fit([r.length for r in rows], 64))
    assert packing.pack(packing.cut_pieces(docs.limit(0), PATH, end=2)).count() == 0


def test_a_word_before_closing_marks_is_encoded_once(tokenizer):
    from ledgerflow.llm.bpe import TextEncoder

    encoder = TextEncoder(PATH)
    text = "zorbling zorbling. zorbling,, été! Über? x1. ...\nzorbling; \x0bzorbling: ﬁn. 日本!"
    for part in (text, text.replace("\x0b", ""), "zorbling."):
        assert np.frombuffer(encoder.encode(part), np.uint32).tolist() == tokenizer.encode(part, add_special_tokens=False).ids
    encoder = TextEncoder(PATH)
    asked, tokenize = [], encoder._tokenize
    encoder._tokenize = lambda letters: asked.append(letters) or tokenize(letters)
    encoder.encode("the zorbling, zorbling. zorbling! zorbling")
    assert sum("zorbling" in a for a in asked) == 1


def test_lengths_are_counted_without_the_ids(spark, tokenizer):
    docs = frame(spark)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pieces = packing.cut_pieces(docs, PATH, end=2, capacity=64).localCheckpoint()
    packed = packing.pack(pieces.mapInArrow(seen, packing.PIECES), capacity=64, lengths=pieces.select("doc_id", "piece", "length"))
    assert read.value == 0
    places = lambda df: sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in df.collect())
    assert places(packed) == places(packing.pack(pieces, capacity=64))
