"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's signature is 48 MinHash values of 16 bits.  It is split into 8 chunks of 6 values; by the pigeonhole
principle, signatures that differ in at most 15 values have a chunk with at most one difference.  Each chunk is indexed
once per allowed error position (the chunk without that value), so two such signatures meet in at least one of 48
buckets: no pair under the distance is lost.  A pair of Jaccard similarity 0.85 whose signatures are farther apart is
still met unless all 8 chunks have two differences or more (probability 6e-6; 2e-4 at 0.80, the least that is allowed).

Buckets only propose: documents that meet form loose families, and links are confirmed on the full shingle sets.
Equal sets are one class from the start, so copies never meet in buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import words
from ledgerflow.llm.links import confirmed_components, families
from ledgerflow.llm.runtime import cut, filter_position, group_bounds, membership_filter, rows_by_key

CHUNKS, WIDTH = 8, 6
VALUES = CHUNKS * WIDTH
#: In small buckets, pairs whose 2-bit sketches differ in more places are not proposed; at similarity 0.8, 1 pair in 10**5.
SKETCH_DISTANCE = 18
#: Buckets up to this size are compared pair by pair on sketches; the members of a larger one are joined in one family.
SMALL_BUCKET = 48


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes, their offsets) for runs of texts."""
    data, offsets = words.text_buffers(texts)
    for i, j in words.runs(offsets):
        hashes, _, _, bounds = words.hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, *words.distinct_per_text(*words.shingles(hashes, bounds, k))


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, sets, at in shingle_sets(batch.column("text"), k):
            values = (words.minima(sets, at, VALUES) & np.uint32(0xFFFF)).astype(np.uint16)
            total = np.zeros(len(sets) + 1, np.uint64)
            np.cumsum(words.mix(sets), out=total[1:])
            other = np.zeros(len(sets) + 1, np.uint64)
            np.cumsum(words.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), out=other[1:])
            flat = pa.py_buffer(np.ascontiguousarray(values).tobytes())
            places = pa.py_buffer(np.arange(0, (j - i + 1) * VALUES * 2, VALUES * 2, dtype=np.int32)[: j - i + 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    batch.column("row_hash").slice(i, j - i),
                    pa.array(np.diff(at)),
                    pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                    pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)),
                    pa.Array.from_buffers(pa.binary(), j - i, [None, places, flat]),
                ],
                ["doc_id", "row_hash", "n_shingles", "set_a", "set_b", "signature"],
            )


def _bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, 2000):
            batch = whole.slice(low, 2000)
            n = batch.num_rows
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, VALUES).astype(np.uint64)
            two = values & np.uint64(3)
            place = np.uint64(2) * np.arange(32, dtype=np.uint64)
            near = (two[:, :32] << place).sum(1, dtype=np.uint64)
            far = (two[:, 32:] << place[: VALUES - 32]).sum(1, dtype=np.uint64)
            keys = []
            for c in range(CHUNKS):
                part = [words.mix(values[:, c * WIDTH + x] + np.uint64((c * WIDTH + x + 1) << 20)) for x in range(WIDTH)]
                every = np.sum(part, axis=0, dtype=np.uint64)
                keys += [words.mix(every - part[x] + np.uint64(c * WIDTH + x)) for x in range(WIDTH)]
            repeat = lambda v: np.tile(v, CHUNKS * WIDTH)
            node, size = batch.column("node").to_numpy(), batch.column("n").to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.concatenate(keys).view(np.int64), repeat(size), repeat(node), repeat(near.view(np.int64)), repeat(far.astype(np.int64).astype(np.int32)))],
                ["key", "n", "node", "near", "far"],
            )


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x ^ y
    return np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).astype(np.int16)


def propose(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each bucket of a stream sorted by (key, n, node)."""
    for rows in rows_by_key(batches, ["key"]):
        key, n, node = (rows.column(c).to_numpy() for c in ("key", "n", "node"))
        near = rows.column("near").to_numpy().astype(np.int64).view(np.uint64)
        far = rows.column("far").to_numpy().astype(np.int32).view(np.uint32).astype(np.uint64)
        cuts = group_bounds(key)
        size = np.diff(cuts)
        left, right = [], []
        for a, b in zip(cuts[:-1][size > SMALL_BUCKET], cuts[1:][size > SMALL_BUCKET], strict=True):
            left.append(node[a + 1 : b])
            right.append(np.full(b - a - 1, node[a]))
        # pairs of small buckets, by distance within the bucket: all of distance 1 at once, then of 2, ...
        bucket_end = np.repeat(cuts[1:], size)
        small = np.repeat(size <= SMALL_BUCKET, size)
        for d in range(1, SMALL_BUCKET):
            i = np.flatnonzero(small[: len(key) - d] & (np.arange(len(key) - d) + d < bucket_end[: len(key) - d])) if len(key) > d else []
            if not len(i):
                break
            j = i + d
            i, j = i[100 * n[i] >= percent * n[j]], j[100 * n[i] >= percent * n[j]]
            ok = _differing(near[i], near[j]) + _differing(far[i], far[j]) <= SKETCH_DISTANCE
            left.append(node[j[ok]])
            right.append(node[i[ok]])
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])


def row_hash() -> Column:
    """Stands for a row's id and text."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, with_row: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, and if asked for ``row_hash``,
    the ``row_hash`` of its id and text, and ``first``, whether its text stands for its component.

    Documents whose sets of distinct ``k``-word shingles have 100 * |intersection| >= percent * |union| are linked;
    ``component_id`` is the smallest doc_id a document reaches over links, ``kept`` whether that is itself.
    A null, empty or blank text has no shingles and links with nothing; fewer than ``k`` words are one shingle.  A null
    doc_id links with nothing, has a null component and is kept.  What links are texts, not ids: rows of one doc_id with
    different texts have each their own component, all of them are kept where it is their id, and one of them is ``first``.
    Rows of one doc_id and one set are one document in two rows, each of which is returned.  A row stands by a hash of 64
    bits of its id and text; other columns of ``docs`` are not read.  ``percent`` must be at least
    80: the signature index is built for similarities from there up to 1, and loses pairs below.  An empty table gives no rows.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie in 80..100")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash().alias("row_hash"))
    summary = cut(texts.mapInArrow(lambda b: _signatures(b, k), "doc_id long, row_hash long, n_shingles long, set_a long, set_b long, signature binary"))
    classes = cut(
        summary.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b", F.col("n_shingles").alias("n"))
        .agg(F.min(F.struct("doc_id", "row_hash")).alias("least"), F.any_value("signature").alias("signature"))
        .select("set_a", "set_b", "n", "signature", F.col("least.doc_id").alias("id"), F.col("least.row_hash").alias("node"))
    )
    keys = classes.select("node", "n", "signature").mapInArrow(_bucket_keys, "key long, n int, node long, near long, far int")
    loose = keys.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(lambda b: propose(b, percent), "a long, b long")
    members = families(loose)
    inside = membership_filter(members, "node")

    def sets_of_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(inside(batch.column("p").to_numpy())))
            for i, j, sets, at in shingle_sets(batch.column("text"), k):
                values = [sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row_hash").slice(i, j - i), pa.array(values, pa.binary())], ["node", "hashes"])

    sets = texts.filter("doc_id is not null").withColumn("p", filter_position(F.col("row_hash"))).mapInArrow(sets_of_members, "node long, hashes binary")
    roots = cut(confirmed_components(members, sets, percent))
    rooted = cut(classes.drop("signature").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    heads = rooted.groupBy("root").agg(F.min(F.struct("id", "node")).alias("head"))
    named = cut(rooted.join(heads, "root").select("set_a", "set_b", "n", F.col("head.id").alias("component"), F.col("head.node").alias("head")))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    first = F.coalesce(F.col("doc_id").isNull() | (F.col("row_hash") == F.col("head")), F.lit(True)).alias("first")
    return (
        summary.drop("signature")
        .join(named.withColumnRenamed("n", "n_shingles"), ["set_a", "set_b", "n_shingles"], "left")
        .select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"), *([] if not with_row else ["row_hash", first]))
    )
