"""Byte-level BPE by ranks: encoding in padded numpy matrices, and decoding.

A text is cut by the vocabulary's pattern, and each match is encoded by itself.  Matches repeat, so each different one is
encoded once per worker (a bounded cache).  New ones are dealt by their length in bytes to matrices of token ids, one row
each, padded at the end.  In every round each row merges its leftmost pair of least rank; pairs are looked up in a hash
table, the row closes up by one column, and rows without a pair to merge leave.  A match longer than ``LONGEST`` bytes has
a row of its own, in which all places of the least pair are merged at once where that comes to the same.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.int32(2**31 - 1)
LONGEST = 512
#: Ids that a matrix holds, and matches that are encoded together, at most.
CELLS = 1 << 21
MATCHES = 200_000
#: Characters of texts that are cut at once; longer texts are cut in portions of matches.
TOGETHER = 1 << 20
CACHED = 500_000
_STEP = 256


class PairTable:
    """Merged id of (left, right) by open addressing; ``NONE`` where there is no such pair."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, slot, todo = self._key(left, right), self._slot(self._key(left, right)), np.arange(len(left))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            at, first = np.unique(slot[todo[free]], return_index=True)
            new = todo[free][first]
            self.keys[at], self.values[at] = key[new], merged[new]
            todo = np.setdiff1d(todo, new)
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.view(np.uint64) ^ (key.view(np.uint64) >> np.uint64(29))
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right).ravel()
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out.reshape(left.shape)


def _width(length: int) -> int:
    """The length bucket of a match: exact up to 16 bytes, then steps of 8, then powers of two."""
    if length <= 16:
        return length
    return -(-length // 8) * 8 if length <= 64 else 1 << (length - 1).bit_length()


class RankBPE:
    """Encoder and decoder of one rank file (``base64 rank`` lines) and the pattern that cuts texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing[:5]}")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        halves = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*(np.array(side, np.int32) for side in zip(*halves, strict=True))) if halves else PairTable(*[np.zeros(0, np.int32)] * 3)
        # white space by its Unicode property: what a plain \s means differs between libraries
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cache: dict[str, bytes] = {}

    def merge_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        """The ids (little-endian uint32) of matches of up to ``width`` bytes."""
        length = np.array([len(r) for r in rows])
        ids = self.byte_ids[np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8)].reshape(len(rows), width)
        rank = self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        rank[np.arange(1, width)[None, :] >= length[:, None]] = NONE
        out, place = [b""] * len(rows), np.arange(len(rows))
        while len(place):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(place), np.int64)
            low = rank[np.arange(len(place)), at] if rank.shape[1] else np.full(len(place), NONE)
            live = low != NONE
            for k in np.flatnonzero(~live):
                out[place[k]] = ids[k, : length[k]].tobytes()
            if not live.all():
                place, ids, rank, length, at, low = place[live], ids[live], rank[live], length[live], at[live], low[live]
                if not len(place):
                    break
            every, column = np.arange(len(place)), np.arange(ids.shape[1] - 1)[None, :]
            ids[every, at] = low
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            length = length - 1
            rank = np.take_along_axis(rank, column[:, :-1] + (column[:, :-1] >= at[:, None]), 1)
            for near in (at - 1, at):  # the pairs of the merged id with what stands before and after it
                k = np.flatnonzero((near >= 0) & (near + 1 < length))
                rank[k, near[k]] = self.pairs.look_up(ids[k, near[k]], ids[k, near[k] + 1])
                past = np.flatnonzero((near >= 0) & (near + 1 >= length) & (near < rank.shape[1]))
                rank[past, near[past]] = NONE
        return out

    def merge_long(self, match: bytes) -> bytes:
        """The ids of one match of any length.

        The places of the least pair are merged together if no pair that comes about on the way is of a lower rank; else
        only the leftmost is, as in a matrix."""
        ids = self.byte_ids[np.frombuffer(match, np.uint8)]
        rank = self.pairs.look_up(ids[:-1], ids[1:])
        while len(rank):
            low = rank.min()
            if low == NONE:
                break
            at = np.flatnonzero(rank == low)
            first = np.concatenate([[True], np.diff(at) > 1])  # of places next to each other every second one
            start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            while True:
                kept = np.ones(len(ids), bool)
                kept[at + 1] = False
                new = ids.copy()
                new[at] = low
                new, now = new[kept], at - np.arange(len(at))
                before, after, between = now[now > 0], now[now + 1 < len(new)], at[at + 2 < len(ids)]
                made = [self.pairs.look_up(new[before - 1], new[before]), self.pairs.look_up(new[after], new[after + 1])]
                seen = self.pairs.look_up(np.full(len(between), low, np.int32), ids[between + 2])
                if len(at) == 1 or min([r.min() for r in (*made, seen) if len(r)], default=NONE) > low:
                    break
                at = at[:1]
            left = np.delete(rank, at)  # the pairs that merged are gone, those beside them are new
            left[before - 1], left[after] = made
            ids, rank = new, left
        return ids.tobytes()

    def encode_matches(self, matches: list[str]) -> dict[str, bytes]:
        """The ids of different matches: whole tokens by name, the others in matrices by length."""
        out, by_width = {}, {}
        for m in matches:
            data = m.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out[m] = np.array([whole], np.uint32).tobytes()
            elif len(data) > LONGEST:
                out[m] = self.merge_long(data)
            else:
                by_width.setdefault(_width(len(data)), []).append((m, data))
        for width, found in by_width.items():
            step = max(1, CELLS // width)
            for low in range(0, len(found), step):
                part = found[low : low + step]
                out |= zip((m for m, _ in part), self.merge_rows([data for _, data in part], width), strict=True)
        return out

    def _portions(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """(number of a text, some of its matches in order); a long text comes in several portions."""
        for i, text in enumerate(texts):
            if len(text) <= TOGETHER:
                yield i, self.pattern.findall(text)
            else:
                found = self.pattern.finditer(text)
                while part := [m.group() for m in islice(found, MATCHES)]:
                    yield i, part

    def _write(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.cache) > CACHED:
            self.cache.clear()
        self.cache |= self.encode_matches(list(set().union(*(part for _, part in held)).difference(self.cache)))
        for i, part in held:
            out[i].append(b"".join(map(self.cache.__getitem__, part)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian uint32; a null text has none."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, n = [], 0
        for i, part in self._portions([t or "" for t in texts]):
            held.append((i, part))
            n += len(part)
            if n >= MATCHES:
                self._write(held, out)
                held, n = [], 0
        self._write(held, out)
        return [b"".join(parts) for parts in out]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; one that is no token is an error."""
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"the vocabulary has no token {e.args[0]}") from None


@lru_cache(maxsize=2)
def rank_bpe(path: str, pattern: str) -> RankBPE:
    """One coder per worker and vocabulary."""
    return RankBPE(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text): doc_id, ids array<int>.

    Each match of ``pattern`` is encoded by itself by the rank file ``ranks``; no string is special.  A null or empty text
    has no ids, repeated rows are each returned, a null doc_id stays; other columns are not read, so their names do not
    matter; a text of any length is cut and encoded in portions; an empty table gives no rows.  No row is moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, _STEP):
                batch = whole.slice(low, _STEP)
                found = rank_bpe(ranks, pattern).encode(batch.column("text").to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray | None]]]:
    for whole in batches:
        for low in range(0, whole.num_rows, _STEP):
            batch = whole.slice(low, _STEP)
            lists = batch.column("ids")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            yield batch.column("doc_id"), [flat[a:b] if valid else None for a, b, valid in zip(ends[:-1], ends[1:], lists.is_valid().to_numpy(zero_copy_only=False), strict=True)]


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The bytes of ``encoded`` (doc_id, ids): doc_id, decoded binary; null ids give null, an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, lists in _id_lists(batches):
            back = [None if ids is None else rank_bpe(ranks, pattern).decode(ids.tolist()) for ids in lists]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(back, pa.binary())], ["doc_id", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """For each row of ``encoded`` (doc_id, ids): n_tokens, ids_sha256 of the ids as little-endian unsigned 32-bit integers,
    and decoded_sha256 of the bytes that they decode to; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for doc_id, lists in _id_lists(batches):
            lists = [np.zeros(0, np.int32) if ids is None else ids for ids in lists]
            made = [
                pa.array([len(ids) for ids in lists], pa.int64()),
                pa.array([sha(ids.astype("<u4").tobytes()) for ids in lists], pa.string()),
                pa.array([sha(rank_bpe(ranks, pattern).decode(ids.tolist())) for ids in lists], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([doc_id, *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
