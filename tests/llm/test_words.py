"""Hashes of words and windows: no structured collisions, independence of their surroundings."""

import numpy as np
import pyarrow as pa

from ledgerflow.llm import minhash_dedup, words
from ledgerflow.llm.fingerprints import as_text, vectors


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def word_hashes(texts):
    data, offsets = words.text_buffers(pa.array(texts, pa.large_string()))
    return words.hash_words(data, offsets)


def test_repetitive_words_do_not_meet():
    a, b = thue_morse(2048)
    texts = [a, b, a + b, b + a, a * 3, b * 3]
    h, _, _, bounds = word_hashes(texts)
    assert len(set(h.tolist())) == len(texts) == bounds[-1]
    assert len(set(as_text(*vectors(pa.array(texts))))) == len(texts)
    # texts of the same two words in such an order: other windows, other sets
    one, two = (t.replace("a", "a ").replace("b", "b ") for t in (a, b))
    h, _, _, bounds = word_hashes([one, two])
    windows = words.window_hashes(h, 2000)
    assert windows[0] != windows[bounds[1]]
    sets = [s for _, _, s, _ in minhash_dedup.shingle_sets(pa.array([a + " x y", b + " x y"]), 3)]
    assert len(set(sets[0].tolist())) == 2


def test_words_and_windows_do_not_depend_on_their_place():
    rng = np.random.default_rng(1)
    vocabulary = ["", "a", "Ab", "abcdefgh", "abcdefghi", "x" * 100, "é", "é" * 9, "\x00", "\x00\x00"]
    plain = {}
    for w in vocabulary[1:]:
        plain[w.lower()] = int(word_hashes([w])[0][0])
    assert len(set(plain.values())) == len(plain)
    text = [vocabulary[1 + k] for k in rng.integers(0, len(vocabulary) - 1, 500)]
    h, start, end, bounds = word_hashes([" ".join(text[:200]), "\t".join(text[200:])])
    assert [plain[w.lower()] for w in text] == h.tolist() and bounds.tolist() == [0, 200, 500]
    for k in (1, 2, 5, 25, 50, 64):
        seen = {}
        for i, value in enumerate(words.window_hashes(h, k).tolist()):
            assert seen.setdefault(tuple(w.lower() for w in text[i : i + k]), value) == value
        assert len(set(seen.values())) == len(seen)
    assert len(words.window_hashes(h, 501)) == 0
