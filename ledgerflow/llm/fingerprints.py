"""Order-independent document fingerprints by a homomorphic multiset hash.

A paragraph (a line of the text) hashes to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo a power of two.  So paragraphs can be added or taken away by adding or subtracting their
vectors, their order does not matter, and equal multisets have equal fingerprints.

The vector has 4 lanes modulo 2**64, three independent hashes of the paragraph's bytes and a count, which decide
equality, and 256 lanes modulo 2**32, more than a text has words: each of the paragraph's three-word shingles adds 1 or
-1 to one of them.  Read as signed numbers, the latter are a linear sketch of the document's shingles, so the cosine of
two fingerprints estimates how much of two documents is alike (standard error about 0.06).  Texts that differ in the
line feed at their end alone, or in the order of their lines, are equal multisets and have one fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import words
from ledgerflow.llm.runtime import shuffle_partitions

EQUAL_LANES, LIKE_LANES = 4, 256
SHINGLE = 3
_U = np.uint64
#: Bytes of text hashed at a time.
_RUN = 1 << 20


def _paragraph_hashes(data: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Independent hashes of the bytes between each two consecutive edges, without a closing line feed, so that a paragraph may stand anywhere."""
    start, end = edges[:-1], edges[1:] - (data[edges[1:] - 1] == 10)
    return [words.hash_ranges(data, start, end, seed) for seed in range(1, EQUAL_LANES)]


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(equality lanes uint64, likeness lanes int32) of each text; an empty or null text is the empty multiset, all zeros."""
    data, offsets = words.text_buffers(texts)
    n = len(offsets) - 1
    equal, like = np.zeros((n, EQUAL_LANES), _U), np.zeros((n, LIKE_LANES), np.int32)
    for i, j in words.runs(offsets, _RUN):
        piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if not len(piece):
            continue
        # a paragraph ends with its line feed or with its text
        edges = np.unique(np.concatenate([at, np.flatnonzero(piece == 10) + 1]))
        owner = np.searchsorted(at, edges[:-1], side="right") - 1
        lanes = np.stack([*_paragraph_hashes(piece, edges), np.ones(len(edges) - 1, _U)], axis=1)
        first = np.searchsorted(owner, np.arange(j - i))
        have = np.flatnonzero(np.diff(np.append(first, len(owner))) > 0)
        equal[i + have] = np.add.reduceat(lanes, first[have], axis=0)
        hashes, _, _, bounds = words.hash_words(piece, edges)
        grams, gram_bounds = words.shingles(hashes, bounds, SHINGLE)
        if len(grams):
            doc = np.repeat(owner, np.diff(gram_bounds))
            lane = (grams >> _U(20)).astype(np.int64) % LIKE_LANES
            sign = np.where(grams & _U(1), 1.0, -1.0)
            sums = np.bincount(doc * LIKE_LANES + lane, weights=sign, minlength=(j - i) * LIKE_LANES)
            like[i:j] = sums.astype(np.int64).astype(np.uint32).view(np.int32).reshape(j - i, LIKE_LANES)
    return equal, like


def likeness(equal_a: np.ndarray, like_a: np.ndarray, equal_b: np.ndarray, like_b: np.ndarray) -> np.ndarray:
    """Cosine of the likeness lanes, cut to 0..1; 1 for equal fingerprints."""
    a, b = like_a.astype(np.float64), like_b.astype(np.float64)
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)
    same = (equal_a == equal_b).all(1) & (like_a == like_b).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def as_text(equal: np.ndarray, like: np.ndarray) -> list[str]:
    raw = np.concatenate([equal.astype(">u8").view(np.uint8).reshape(len(equal), -1), like.astype(">i4").view(np.uint8).reshape(len(like), -1)], axis=1)
    return [r.tobytes().hex() for r in raw]


def combine(first: str, second: str, sign: int = 1) -> str:
    """The fingerprint of a document after inserting (``sign`` 1) or deleting (-1) the paragraphs that ``second`` stands for."""
    parts = []
    for text in (first, second):
        raw = bytes.fromhex(text)
        parts.append((np.frombuffer(raw[: 8 * EQUAL_LANES], ">u8").astype(_U), np.frombuffer(raw[8 * EQUAL_LANES :], ">u4").astype(np.uint32)))
    (e1, l1), (e2, l2) = parts
    equal, like = (e1 + e2, l1 + l2) if sign > 0 else (e1 - e2, l1 - l2)
    return as_text(equal[None], like.view(np.int32)[None])[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text); see ``vectors`` for nulls and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(as_text(*vectors(batch.column("text"))))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _dealt_with_next(docs: DataFrame) -> DataFrame:
    """Rows (pid, guest, doc_id, text) such that, sorted within a pid, each row but the guest is followed by the next document.

    Ids are cut into ranges at approximate quantiles; each range also gets, as its guest, the first document of the
    next one (of the first range for the last).  Only texts are shuffled, once; the driver sees one id per range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long").alias("k"), "doc_id", "text")
    n = shuffle_partitions(spark)
    bounds = sorted({int(x) for x in rows.select("k").stat.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    step = max(1, int(len(bounds) ** 0.5))
    pid = F.lit(0)
    if bounds:  # two levels, so that a row is compared with few bounds
        shelves = [bounds[i : i + step] for i in range(0, len(bounds), step)]
        ids = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        shelf = F.size(F.filter(ids([s[0] for s in shelves[1:]]), lambda b: b <= F.col("k"))) if len(shelves) > 1 else F.lit(0)
        inner = F.element_at(F.array(*[ids(s) for s in shelves]), shelf + 1)
        pid = shelf * step + F.size(F.filter(inner, lambda b: b <= F.col("k")))
    firsts = sorted((r["pid"], r["k"]) for r in rows.select(pid.cast("int").alias("pid"), "k").groupBy("pid").agg(F.min("k").alias("k")).collect())
    guests = spark.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "k long, before int")
    own = rows.withColumn("pid", pid.cast("int")).join(F.broadcast(guests), "k", "left")
    places = F.array_compact(
        F.array(F.struct(F.col("pid").alias("pid"), F.lit(0).alias("guest")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("pid"), F.lit(1).alias("guest"))))
    )
    return own.select("doc_id", "text", F.explode(places).alias("p")).select("p.pid", "p.guest", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and their likeness.

    The edit replaces the last half of the text (floor of its code points) by as many first code points, or all, of the
    next document in ascending doc_id; the first document follows the last.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.  A null text is empty; null ids come first; rows of one id
    follow each other by text; a lone row is its own next document; an empty table gives no rows.
    """
    dealt = _dealt_with_next(docs).repartition("pid").sortWithinPartitions("pid", "guest", "doc_id", "text")

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        texts = pa.array([r[1] for r in rows] + [rows[-1][4]], pa.large_string())
        edited = [r[1][: len(r[1]) - len(r[1]) // 2] + r[4][: len(r[1]) // 2] for r in rows]
        equal, like = vectors(texts)
        equal_e, like_e = vectors(pa.array(edited, pa.large_string()))
        # each row's next document is the next row, but at the end of a range
        ends = [i for i in range(len(rows) - 1) if rows[i][3]]
        follow_equal, follow_like = equal[1:].copy(), like[1:].copy()
        if ends:
            e, k = vectors(pa.array([rows[i][4] for i in ends], pa.large_string()))
            follow_equal[ends], follow_like[ends] = e, k
        equal, like = equal[:-1], like[:-1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(as_text(equal, like)),
                pa.array(as_text(equal_e, like_e)),
                pa.array(likeness(equal, like, equal_e, like_e)),
                pa.array(likeness(equal, like, follow_equal, follow_like)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, size = [], None, 0  # held: (doc_id, text, pid, ends its range, next text)
        for batch in batches:
            for pid, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("pid", "guest", "doc_id", "text")), strict=True):
                text = text or ""
                if last is not None and last[2] == pid:
                    held.append((*last[:3], bool(guest), text))
                    size += len(text)
                last = None if guest else (doc_id, text, pid)
                if size > _RUN or len(held) >= 4096:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
