"""SentencePiece encoding and decoding over a trie of distinct marked words.

Texts are marked as the library does (a blank becomes the mark, one is put in front) and fall apart into marked words,
which no piece crosses.  A batch's distinct new words are sorted, so that walking them in order is a depth-first
traversal of their trie: the forward state of every prefix is kept on a stack, and the next word goes on from its common
prefix with the one before.

Forward state.  For a unigram model it is the best score of a segmentation of the prefix and its last piece (Viterbi).
For a byte-pair model scores of pieces do not add up - a Viterbi path over them is another tokenisation than the model's -
so the state is the last piece of the prefix's merge result: a piece extends the result of a shorter prefix if and only if
merging the last two together gives just these two, and exactly one piece does.  Both give the library's own ids.

Characters outside the vocabulary become the unknown id, or their bytes where the model has byte pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerflow.llm.token_output import id_lists

MARK = "▁"
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


class Codec:
    """Encoder and decoder of one model file; words are cached up to a bound."""

    def __init__(self, path: str, limit: int = 700_000, longest: int = 48):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.dummy, self.squeeze, normaliser = UNIGRAM, True, True, "identity"
        for field, value in _fields(open(path, "rb").read()):
            if field == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(entry[2], "<f4")[0]) if 2 in entry else 0.0)
                kinds.append(entry.get(3, 1))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                entry = dict(_fields(value))
                normaliser = entry.get(1, b"identity").decode()
                self.dummy, self.squeeze = bool(entry.get(3, 1)), bool(entry.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or normaliser != "identity" or 4 in kinds:
            raise ValueError("only unigram and byte-pair models with the identity normaliser and without user-defined pieces")
        self.unknown = kinds.index(2)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        self.silent = {i for i, k in enumerate(kinds) if k == 3}
        self.raw = [bytes([int(p[3:5], 16)]) if k == 6 else p.encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (1, 4, 5)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces cross words")
        self.reach = max(map(len, self.ids), default=1)
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0  # the library's score of an unknown
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.limit, self.longest = limit, longest
        self._breaks = not any("\n" in p for p in self.ids)

    # forward states

    def _merged(self, text: str) -> list[str]:
        """Merge neighbours by score, leftmost of equal ones first, as the model defines its result (short texts only)."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _stands(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            found = self._merged(left + right) == [left, right]
            if len(self.fits) < 2_000_000:
                self.fits[key] = found
        return found

    def _extend(self, word: str, n: int, states: list[tuple[int, float]]) -> tuple[int, float]:
        """State of the prefix of length n: (start of its last piece, score), from the states of the shorter ones."""
        ids = self.ids
        if self.kind == UNIGRAM:
            best = (n - 1, states[n - 1][1] + (self.scores[ids[word[n - 1]]] if word[n - 1] in ids else self.lowest))
            for a in range(max(0, n - self.reach), n - 1):
                i = ids.get(word[a:n])
                if i is not None and (score := states[a][1] + self.scores[i]) > best[1]:
                    best = (a, score)
            return best
        for a in range(max(0, n - self.reach), n):
            piece = word[a:n]
            if piece in ids or a == n - 1:
                if not a:
                    if len(piece) == 1 or self._whole(piece):
                        return 0, 0.0
                elif (a == n - 1 or self._whole(piece)) and self._stands(word[states[a][0] : a], piece):
                    return a, 0.0
        raise AssertionError("no piece extends the prefix")

    def _whole(self, piece: str) -> bool:
        """A piece that its own merges never produce cannot occur."""
        found = self.fits.get((piece, ""))
        if found is None:
            found = self.fits[piece, ""] = self._merged(piece) == [piece]
        return found

    def _emit(self, word: str, states: list[tuple[int, float]]) -> bytes:
        out: list[int] = []
        parts = []
        n = len(word)
        while n:
            a = states[n][0]
            parts.append(word[a:n])
            n = a
        for p in reversed(parts):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:  # the library joins neighbouring unknowns
                out.append(self.unknown)
        return np.array(out, np.uint32).tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct words, in one depth-first walk of their trie."""
        found, before, states = {}, "", [(0, 0.0)]
        for word in sorted(words):
            shared = len(commonprefix((before, word)))
            del states[shared + 1 :]
            for n in range(shared + 1, len(word) + 1):
                states.append(self._extend(word, n, states))
            found[word] = self._emit(word, states)
            before = word
        return found

    # texts

    def split(self, text: str | None) -> list[str]:
        """Marked words of a text: no piece contains a mark after another character, nor, as a rule, a line feed."""
        if not text:
            return []
        if self.squeeze:
            text = " ".join(w for w in text.split(" ") if w)
            if not text:
                return []
        text = text.replace(" ", MARK)
        if self.dummy:
            text = MARK + text
        if MARK + MARK not in text:
            head, *rest = text.split(MARK)
            parts = [MARK + w for w in rest]
            if head:
                parts.insert(0, head)
        else:
            parts, start = [], 0
            for i in range(1, len(text)):
                if text[i] == MARK and text[i - 1] != MARK:
                    parts.append(text[start:i])
                    start = i
            parts.append(text[start:])
        if not self._breaks or "\n" not in text:
            return parts
        out = []
        for p in parts:
            if "\n" not in p:
                out.append(p)
                continue
            lines = p.split("\n")
            for k, line in enumerate(lines):
                if k:
                    out.append("\n")
                if line:
                    out.append(line)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        parts = [self.split(t) for t in texts]
        missing = set().union(*parts).difference(self.words) if parts else set()
        fresh = self.learn(missing)
        room = self.limit - len(self.words)
        if room > 0:
            self.words.update((w, b) for w, b in list(fresh.items())[: 4 * room] if len(w) <= self.longest)
        known = self.words
        if len(fresh) and room <= len(fresh):
            known = {**known, **fresh} if len(known) < 1000 else _Both(known, fresh)
        elif any(len(w) > self.longest for w in fresh):
            known = _Both(known, fresh)
        out = []
        for p in parts:
            b = b"".join(map(known.__getitem__, p))
            if not self.bytes and len(b) >= 8:  # neighbouring unknowns of two words are one as well
                ids = np.frombuffer(b, np.uint32)
                b = ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])].tobytes()
            out.append(b)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, the mark in front taken away, bytes that are no UTF-8 replaced."""
        raw = b"".join([b" \xe2\x81\x87 " if i == self.unknown else b"" if i in self.silent else self.raw[i] for i in ids.tolist()])
        mark = MARK.encode()
        if self.dummy and raw.startswith(mark):
            raw = raw[len(mark) :]
        return raw.replace(mark, b" ").decode(errors="replace")


class _Both(dict):
    """Two dictionaries read as one."""

    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self._first = first

    def __missing__(self, key):
        return self._first[key]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and model."""
    return Codec(path)


_STEP = 1024


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of the whole text of every row of ``docs`` (doc_id, text).

    A null or empty text has no ids; repeated rows are encoded each; other columns are not read.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, _STEP):
                batch = whole.slice(low, _STEP)
                found = codec(model).encode_batch(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), id_lists(found)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            texts = [codec(model).decode(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_crc32 (of the ids as little-endian uint32),
    text_crc32 (of the decoded text as UTF-8) and whether the decoded text is the text (a null one counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, _STEP):
                batch = whole.slice(low, _STEP)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                found = codec(model).encode_batch(texts)
                back = [codec(model).decode(np.frombuffer(b, np.uint32)) for b in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(b) // 4 for b in found], pa.int64()),
                        pa.array([zlib.crc32(b) for b in found], pa.int64()),
                        pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                        pa.array([a == b for a, b in zip(texts, back, strict=True)]),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "text_crc32", "same_text"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, same_text boolean")
