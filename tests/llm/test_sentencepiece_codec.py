"""SentencePiece ids and texts against the sentencepiece library, for a byte-pair and a unigram model."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ledgerflow.llm import sentencepiece_codec as spc

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  a  b ", "Hello  world\nfoo ▁x é 日本 <s>", "\n\n", "tab\tx", "a▁b", "▁▁", "emoji 😀 ok", "x" * 300, "    def f():\n        return  1",
    "<0x0A>", "\r\nq", "the the the " * 500, "naïve Über straße ñandú", "https://a.b/c?d=e&f=1,234.5%",
]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces and scores read as a unigram model: only the model type in the trainer's settings is another."""
    raw = open(PATH, "rb").read()
    at = raw.rindex(b"\x18\x02\x20\x80\xfa\x01")  # model_type 2, vocab_size 32000
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(raw[: at + 1] + b"\x01" + raw[at + 2 :])
    return str(path)


def words(seed, n):
    rng = random.Random(seed)
    pieces = ["th", "er", "ing", "a", "é", "ß", "xq", "Zz", "9", "-", ".", "on", "tion", "日", "👍"]
    return [" ".join("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_byte_pair_ids_and_texts_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(TEXTS + words(1, 300)))
    frame = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    encoded = spc.encode(frame, PATH)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: library.encode(t or "") for i, t in rows}
    assert {r.doc_id: r.text for r in spc.decode(encoded, PATH).collect()} == {i: library.decode(library.encode(t or "")) for i, t in rows}
    both = {r.doc_id: r for r in spc.round_trips(frame, PATH).collect()}
    assert all(both[i].n_tokens == len(got[i]) and both[i].same_text == (library.decode(got[i]) == (t or "")) for i, t in rows)
    assert spc.encode(frame.limit(0), PATH).count() == 0


def test_unigram_ids_equal_the_library(unigram):
    library = sentencepiece.SentencePieceProcessor(model_file=unigram)
    codec = spc.Codec(unigram)
    assert codec.kind == spc.UNIGRAM
    texts = [t or "" for t in TEXTS] + words(2, 300)
    # the library adds scores in single precision, so over long texts it may end on a path that is not the best
    total = lambda ids: sum(codec.scores[i] for i in ids)
    equal = 0
    for text, raw in zip(texts, codec.encode_batch(texts), strict=True):
        mine, theirs = np.frombuffer(raw, np.uint32).tolist(), library.encode(text)
        equal += mine == theirs
        assert total(mine) >= total(theirs) - 1e-6 * abs(total(theirs)), text
        assert library.decode(mine) == library.decode(theirs)
    assert equal > 0.9 * len(texts)


def test_a_small_cache_changes_nothing():
    small, large = spc.Codec(PATH, limit=10, longest=4), spc.Codec(PATH)
    for seed in range(4):
        texts = words(seed, 50)
        assert small.encode_batch(texts) == large.encode_batch(texts)
