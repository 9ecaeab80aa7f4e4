"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Best fit only looks at lengths, and there are at most ``capacity`` different ones.  So the plan is made from the
histogram of lengths: lengths in falling order, for each the tightest open bin from a segment tree over remaining
capacities, for a whole run of equal pieces at a time.  The plan's size depends on the capacity alone, never on the
number of documents; pieces then find their slots by their ordinal among the pieces of their length.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.runtime import group_bounds
from ledgerflow.llm.token_output import encode_batches, id_lists

#: Pieces of one length are counted and numbered in this many shares, so that no task holds all pieces of a length.
SHARES = 64


class OpenBins:
    """Open bins by remaining capacity: a segment tree of how many there are, and at each leaf the runs of their numbers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: dict[int, deque[list[int]]] = defaultdict(deque)

    def _add(self, room: int, n: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` with an open bin."""
        at = self.size + length
        if self.count[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs[room].append([first, n])
            self._add(room, n)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """(first number, how many) of a run of at most ``most`` bins with exactly ``room``."""
        run = self.runs[room][0]
        first, n = run[0], min(most, run[1])
        if n == run[1]:
            self.runs[room].popleft()
        else:
            run[0] += n
            run[1] -= n
        self._add(room, -n)
        return first, n


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Best-fit decreasing: for each length the slots (first ordinal, first bin, offset) of runs of pieces, and the number of bins."""
    bins, plan, opened = OpenBins(capacity), {}, 0
    for length in sorted(histogram, reverse=True):
        left, ordinal, slots = histogram[length], 0, []
        if not 0 < length <= capacity:
            raise ValueError("lengths must lie in 1..capacity")
        while left:
            room = bins.tightest(length)
            if room is None:
                each = capacity // length
                n = left // each or 1
                bins.put(capacity, opened, n)
                opened += n
                continue
            # the tightest bin takes pieces until it has no room; so do all of a run, except that the last may stay partly filled
            each = room // length
            first, n = bins.take(room, max(1, left // each))
            layers = min(each, left) if n == 1 else each
            for k in range(layers):
                slots.append((ordinal, first, capacity - room + k * length))
                ordinal += n
            left -= layers * n
            bins.put(room - layers * length, first, n)
        plan[length] = slots
    return plan, opened


def pack(pieces: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece"), lengths: DataFrame | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, which have a ``length`` of 1 to ``capacity``.

    Two passes over the pieces: one counts lengths in shares (the driver receives at most capacity * SHARES counts), one
    numbers each share and looks the slots up.  Equal pieces, repeated rows included, get slots of their own; other
    columns are carried along (one that has the name of an added one is replaced); an empty table stays empty.
    ``lengths`` has the same rows with ``length`` and ``order`` at least; where it is given the first pass reads it, so that
    other columns are made or read only once.
    """
    pieces = pieces.drop("sequence_id", "offset")
    share = F.pmod(F.xxhash64(*order), F.lit(SHARES)).cast("int")
    dealt = pieces.withColumn("_pack_share", share)
    counted = (pieces if lengths is None else lengths).groupBy("length", share.alias("_pack_share")).count().collect()
    counts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(SHARES, np.int64))
    for r in counted:
        counts[r["length"]][r["_pack_share"]] = r["count"]
    plan, _ = best_fit_plan({k: int(v.sum()) for k, v in counts.items()}, capacity)
    before = {k: np.cumsum(v) - v for k, v in counts.items()}
    shared = pieces.sparkSession.sparkContext.broadcast((plan, before))
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, offsets = shared.value
        current, done = None, 0
        for batch in batches:
            length, part = batch.column("length").to_numpy(), batch.column("_pack_share").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            bounds = group_bounds(length, part)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                key = (int(length[a]), int(part[a]))
                done = done if key == current else 0
                current = key
                ordinal = offsets[key[0]][key[1]] + done + np.arange(b - a)
                done += b - a
                table = np.array(slots[key[0]], np.int64)
                row = np.searchsorted(table[:, 0], ordinal, side="right") - 1
                sequence[a:b] = table[row, 1] + ordinal - table[row, 0]
                offset[a:b] = table[row, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return dealt.repartition("length", "_pack_share").sortWithinPartitions("length", "_pack_share", *order).mapInArrow(place, schema)


PIECES = "doc_id long, piece int, start long, length long, ids array<int>"


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = 1024) -> DataFrame:
    """Token pieces (doc_id, piece, start, length, ids) of whole documents (doc_id, text).

    Each document's ids, with ``end`` appended, are one piece; only those longer than ``capacity`` are cut, into pieces
    of the capacity of which the first may be shorter.  A null or empty text is one piece of the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs_in, found in encode_batches(batches, tokenizer, end):
            row, piece, start, parts = [], [], [], []
            for i, b in enumerate(found):
                n = len(b) // 4
                at, k = 0, 0
                while at < n:
                    to = min(n, at + ((n - at) % capacity or capacity))
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    parts.append(b[4 * at : 4 * to])
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays(
                [docs_in.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()), id_lists(parts)],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)
