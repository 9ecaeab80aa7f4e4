"""Rank BPE in matrices against the tiktoken library."""

import base64
import hashlib
import random
import sys
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerflow.llm.bpe_matrix import LONGEST, RankBPE, decode, digests, encode
from ledgerflow.llm.queries import QUERIES, RANKS

PATTERN = public_tokenizers.PATTERN
VOCABULARIES = [RANKS, public_tokenizers.path("byte_bpe_50k.tiktoken")]


@cache
def library(path):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def own(path):
    return RankBPE(path, PATTERN)


def ids(path, text):
    return np.frombuffer(own(path).encode([text])[0], np.uint32).tolist()


@pytest.mark.parametrize("path", VOCABULARIES)
def test_random_texts(path):
    rnd = random.Random(1)
    alphabets = ["ab ", "aAbé'st  \n", "0123456789.,- ", "日本語テキスト、 ", "абвгд ъ\t", "😀👍🏽 ‍", "don't we'll I'd 'RE "]
    texts = ["".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randrange(1, 120))) for _ in range(800)]
    texts += ["".join(rnd.choice(a) for _ in range(rnd.randrange(1, 400))) for a in alphabets for _ in range(40)]
    texts += ["<|endoftext|>", " ", "\n\n", "a" * LONGEST, "", "\x00\x1c\x1d\x85　 x", "the" * 400, "ab" * 700, "é" * 600, "日本" * 500, "-" * 2000]
    got = own(path).encode(texts)
    for text, data in zip(texts, got, strict=True):
        assert np.frombuffer(data, np.uint32).tolist() == library(path).encode_ordinary(text), text
        assert own(path).decode(np.frombuffer(data, np.uint32).tolist()) == text.encode()


def test_every_character():
    text = "".join(f"a{chr(c)} {chr(c)}1" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    for low in range(0, len(text), 100_000):
        assert ids(RANKS, text[low : low + 100_000]) == library(RANKS).encode_ordinary(text[low : low + 100_000])


def test_long_texts_and_matches():
    rnd = random.Random(2)
    word = "".join(rnd.choice("etaoinshrdlu") for _ in range(30_000))
    text = " ".join("".join(rnd.choice("etaoin") for _ in range(rnd.randrange(1, 9))) for _ in range(400_000))
    for t in (word, text, "a" * 20_000, "\t" * 5_000 + "x"):
        assert ids(RANKS, t) == library(RANKS).encode_ordinary(t)


def test_a_pair_of_lower_rank_that_comes_about_on_the_way(tmp_path):
    """Ranks that no training gives: merging a and b makes the pair (ab, a), which goes before the next ab."""
    path = tmp_path / "ranks"
    tokens = [bytes([b]) for b in range(256)] + [b"aba", b"bab", b"ab", b"abab", b"cab"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    coder, lib = RankBPE(str(path), PATTERN), library(str(path))
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 60)))
        want = lib.encode_ordinary(text)
        assert np.frombuffer(coder.encode([text])[0], np.uint32).tolist() == want
        if text.encode() not in coder.ranks:
            assert np.frombuffer(coder.merge_long(text.encode()), np.uint32).tolist() == want


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_byte_bpe"](spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = library(RANKS).encode_ordinary(r.text or "")
        want[r.doc_id] = (len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want


def test_nulls_repeats_names_and_empty(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "é", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = encode(docs, RANKS, PATTERN)
    lists = sorted((r.doc_id or 0, list(r.ids)) for r in found.collect())
    assert lists == sorted((i or 0, library(RANKS).encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in decode(found, RANKS, PATTERN).collect()) == sorted((i or 0, (t or "").encode()) for i, t, _ in rows)
    assert encode(docs.limit(0), RANKS, PATTERN).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode(none, RANKS, PATTERN).collect()[0].decoded is None
    assert digests(none, RANKS, PATTERN).collect()[0].n_tokens == 0
    with pytest.raises(ValueError, match="no token"):
        own(RANKS).decode([10**6])
