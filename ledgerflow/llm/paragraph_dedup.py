"""Near-duplicate paragraphs and repeated passages across documents by MinHash banding, exact confirmation and components.

Paragraphs are of two sorts.  A *line* of a text is one if it has a shingle (``MIN_WORDS`` words or more).  A *segment* is a
piece of running text across line ends, cut where the words themselves say so (the hash of two words is the least of all
within ``REACH`` words, or a run of one word begins or ends), so that a passage falls into the same segments wherever it
stands.  Paragraphs of equal words are one node from the start.  Segments have 11 words on average, of which one changed
word leaves less than four fifths, so they are compared as wholes; lines are compared by similarity.

Sets of up to ``FEW`` shingles are only similar if equal and meet by a hash of the whole set.  Of a larger one, 36 MinHash
values of five-word shingles make 12 bands of 3: a pair of similarity 0.8 shares no band with probability
0.488**12 = 2e-4, and one of 0.9 with 3e-7.  Nodes that collide in a band form loose families, in which exact Jaccard
similarity is confirmed on full shingle sets; classes are the components of confirmed links.  Within a band, nodes are
sorted by size and only neighbours are joined: where the size of one allows no similarity of the threshold, none beyond
it does either.

Passages are joined from paragraphs with a copy in another document that overlap or adjoin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import words
from ledgerflow.llm.links import confirmed_components, families
from ledgerflow.llm.runtime import FILTER_BITS, cut, group_bounds, membership_filter, rows_by_key

SHINGLE = 5
PERCENT = 80
MIN_WORDS = SHINGLE
#: A set of f shingles and another one share at most f of f + 1; below 4 of 5 that is no similarity of PERCENT.
FEW = 3
BANDS, ROWS = 12, 3
#: Words to either side that a segment's first word is compared with; segments have 2 * REACH + 1 words on average.
REACH = 5
#: A segment without a place to cut, such as a run of one word, is cut every so many words.
LONGEST = 64
#: Least words of a passage: what is surely left of 50 words when the cut segments at its ends are lost, in all but 5 of 1,000 cases.
PASSAGE = 30
_U = np.uint64


def _nodes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's words in order."""
    count = np.diff(bounds)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], count)
    steps = words.mix(place.astype(_U) + _U(1)) | _U(1)
    return words.mix(np.add.reduceat(h * steps, bounds[:-1]) + count.astype(_U)).view(np.int64)


def _lines(piece: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, number within the text, first word within the text, words, node, hashes of all words, their offsets) of the
    lines of at least ``least`` words of texts with the byte offsets ``at``."""
    edges = np.unique(np.concatenate([at, np.flatnonzero(piece == 10) + 1]))
    h, _, _, bounds = words.hash_words(piece, edges)
    count = np.diff(bounds)
    owner = np.searchsorted(at, edges[:-1], side="right") - 1
    opening = np.searchsorted(owner, owner)
    keep = np.flatnonzero(count >= least)
    take = np.repeat(bounds[:-1][keep] - np.concatenate([[0], np.cumsum(count[keep])[:-1]]), count[keep]) + np.arange(count[keep].sum())
    own = np.concatenate([[0], np.cumsum(count[keep])])
    node = _nodes(h[take], own) if len(keep) else np.zeros(0, np.int64)
    return owner[keep], keep - opening[keep], (bounds[:-1] - bounds[opening])[keep], count[keep], node, h[take], own


def segment_starts(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First words of the segments of texts with the word offsets ``bounds``; each text begins one.

    Words are compared within their text only, so a text has the same segments whatever stands beside it in a batch."""
    n, count = len(h), np.diff(bounds)
    owner = np.repeat(np.arange(len(count)), count)
    after = np.append(h[1:], _U(0))
    after[bounds[1:][count > 0] - 1] = _U(0)
    pair = words.mix(h * _U(3) + after)
    lower, run = np.ones(n, bool), np.zeros(n, bool)
    for k in range(1, REACH + 1):
        apart = owner[k:] != owner[:-k]
        lower[k:] &= (pair[k:] < pair[:-k]) | apart
        lower[:-k] &= (pair[:-k] < pair[k:]) | apart
    same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    run[1:-1] = ~same[:-1] & same[1:]  # a run of one word begins
    run[2:] |= same[:-1] & ~same[1:]  # or has ended
    starts = np.unique(np.concatenate([np.flatnonzero(lower | run), bounds[:-1][np.diff(bounds) > 0]]))
    more = (np.diff(np.append(starts, n)) - 1) // LONGEST
    return np.repeat(starts, more + 1) + LONGEST * (np.arange(len(starts) + more.sum()) - np.repeat(np.arange(len(starts)) + np.cumsum(more) - more, more + 1))


def paragraphs(texts: pa.Array, least: int, segments: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts: (text, number of the line or -1 of a segment, first word within the text, words, node)."""
    data, offsets = words.text_buffers(texts)
    for i, j in words.runs(offsets):
        piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        text, number, first, count, node, _, _ = _lines(piece, at, least)
        if segments:
            h, _, _, bounds = words.hash_words(piece, at)
            if len(h):
                starts = segment_starts(h, bounds)
                size = np.diff(np.append(starts, len(h)))
                owner = np.searchsorted(bounds, starts, side="right") - 1
                long = np.flatnonzero(size >= SHINGLE)
                text = np.concatenate([text, owner[long]])
                number = np.concatenate([number, np.full(len(long), -1)])
                first = np.concatenate([first, (starts - bounds[owner])[long]])
                count = np.concatenate([count, size[long]])
                node = np.concatenate([node, _nodes(h, np.append(starts, len(h)))[long]])
        if len(text):
            yield i + text, number, first, count, node


def _line_sets(texts: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts, of their lines: (node, shingle hashes, their offsets)."""
    data, offsets = words.text_buffers(texts)
    for i, j in words.runs(offsets):
        _, _, _, _, node, h, own = _lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least)
        if len(node):
            yield node, *words.shingles(h, own, SHINGLE)


def _bands(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Band keys of each node, once per task as far as a bounded memory of nodes goes."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        for node, grams, at in _line_sets(batch.column("text"), least):
            fresh, where = np.unique(node, return_index=True)
            new = ~np.isin(fresh, seen)
            where = where[new]
            if not len(where):
                continue
            seen = np.concatenate([seen, fresh[new]])[-500_000:]
            size = np.diff(at)[where]
            take = np.repeat(at[:-1][where] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            bounds = np.concatenate([[0], np.cumsum(size)])
            sets, set_at = words.distinct_per_text(grams[take], bounds)
            n = np.diff(set_at)
            few = np.flatnonzero(n <= FEW)
            many = np.flatnonzero(n > FEW)
            whole = words.mix(np.add.reduceat(words.mix(sets), set_at[:-1]) + n.astype(_U))
            values = words.minima(sets[np.repeat(n > FEW, n)], np.concatenate([[0], np.cumsum(n[many])]), BANDS * ROWS).astype(_U)
            keys = [whole[few]]
            for b in range(BANDS):
                key = np.full(len(many), b + 1, _U)
                for r in range(ROWS):
                    key = words.mix(key * _U(0x9E3779B97F4A7C15) + values[:, b * ROWS + r])
                keys.append(key)
            own = np.concatenate([few, np.tile(many, BANDS)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(n[own].astype(np.int32)), pa.array(node[where][own])], ["key", "n", "node"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a band: in order of size, nodes of which each allows the similarity with the next are linked with the first."""
    for rows in rows_by_key(batches, ["key"]):
        key, n, node = (rows.column(c).to_numpy() for c in ("key", "n", "node"))
        apart = (key[1:] != key[:-1]) | (100 * n[:-1].astype(np.int64) < PERCENT * n[1:])
        first = np.concatenate([[0], np.flatnonzero(apart) + 1])
        hub = np.repeat(node[first], np.diff(np.append(first, len(node))))
        ok = np.flatnonzero(hub != node)
        if len(ok):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[ok], hub[ok])), pa.array(np.minimum(node[ok], hub[ok]))], ["a", "b"])


def _line_roots(texts: DataFrame, least: int) -> DataFrame:
    """(node, root) of the lines that are similar to another one."""
    keys = texts.select("text").mapInArrow(lambda b: _bands(b, least), "key long, n int, node long")
    loose = keys.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_chains, "a long, b long")
    members = families(loose)
    inside = membership_filter(members, "node")

    def sets_of_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, grams, at in _line_sets(batch.column("text"), least):
                fresh, where = np.unique(node, return_index=True)
                where = where[inside(np.mod(fresh, FILTER_BITS))]
                values = [np.unique(grams[at[k] : at[k + 1]]).tobytes() for k in where]
                yield pa.RecordBatch.from_arrays([pa.array(node[where]), pa.array(values, pa.binary())], ["node", "hashes"])

    sets = texts.select("text").mapInArrow(sets_of_members, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
    return cut(confirmed_components(members, sets, PERCENT))


def _shared(texts: DataFrame, least: int, segments: bool) -> DataFrame:
    """(node, class_id, owner_doc_id) of the paragraphs whose class has several documents."""

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, _, _, _, node in paragraphs(batch.column("text"), least, segments):
                yield pa.RecordBatch.from_arrays([pa.array(node), batch.column("doc_id").take(pa.array(text))], ["node", "doc_id"])

    # the first and last document of each node, then of each class, by combinable aggregates
    nodes = texts.select("doc_id", "text").mapInArrow(owners, "node long, doc_id long").groupBy("node")
    nodes = nodes.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    classed = nodes.join(_line_roots(texts, least), "node", "left").withColumn("class_id", F.coalesce("root", "node"))
    # a node in no class of lines stands for itself, and most of them are in one document
    several = "low is not null and (low <> high or unnamed > 0)"
    classed = cut(classed.filter(f"root is not null or {several}").drop("root"))
    classes = classed.groupBy("class_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("unnamed").alias("unnamed"))
    classes = cut(classes.filter(several).select("class_id", F.col("low").alias("owner_doc_id")))
    return cut(classed.select("node", "class_id").join(classes, "class_id"))


def _found(texts: DataFrame, shared: DataFrame, least: int, segments: bool) -> DataFrame:
    """(row, doc_id, paragraph, first_word, n_words, class_id, owner_doc_id, kept) of the paragraphs that ``shared`` has."""
    inside = membership_filter(shared, "node")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, number, first, count, node in paragraphs(batch.column("text"), least, segments):
                own = np.flatnonzero(inside(np.mod(node, FILTER_BITS)))
                take = pa.array(text[own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(take), batch.column("doc_id").take(take), *(pa.array(x[own].astype(np.int32)) for x in (number, first, count)), pa.array(node[own])],
                    ["row", "doc_id", "paragraph", "first_word", "n_words", "node"],
                )

    rows = texts.mapInArrow(occurrences, "row long, doc_id long, paragraph int, first_word int, n_words int, node long")
    return rows.join(shared, "node").drop("node").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("owner_doc_id"), F.lit(False)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())


def duplicate_paragraphs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row per line that has a near-duplicate in another document, its class's first document included.

    Returns doc_id, paragraph (number of the line, from 0), n_words, class_id (one number per class), owner_doc_id (the
    smallest doc_id of the class) and kept (the row is of the owner).  Lines of fewer than ``least`` words, and
    classes within one document, give no rows.  Null and empty texts have no paragraphs; a null doc_id owns nothing but
    may repeat; repeated rows of one doc_id are one document, each returned; other columns are not read.
    """
    texts = _texts(docs)
    found = _found(texts, _shared(texts, least, False), least, False)
    return found.select("doc_id", "paragraph", "n_words", "class_id", "owner_doc_id", "kept")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjoining paragraphs of a stream sorted by (row, kept, first_word, n_words, class_id) joined to passages."""
    for rows in rows_by_key(batches, ["row", "kept"]):
        rows = rows.combine_chunks()
        row, kept, first, count, class_id, owner = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("row", "kept", "first_word", "n_words", "class_id", "owner_doc_id"))
        cuts = group_bounds(row, kept)
        lift = np.repeat(np.arange(len(cuts) - 1, dtype=np.int64) << 40, np.diff(cuts))
        begin, end = first + lift, np.maximum.accumulate(first.astype(np.int64) + count + lift)
        new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
        close = np.append(new[1:], len(row)) - 1
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").chunk(0).take(pa.array(new)),
                pa.array(first[new]),
                pa.array((end[close] - begin[new]).astype(np.int32)),
                pa.array((close - new + 1).astype(np.int32)),
                pa.array(class_id[new]),
                pa.array(np.minimum.reduceat(owner, new)),
                pa.array(kept[new]),
            ],
            ["doc_id", "first_word", "n_words", "n_paragraphs", "class_id", "owner_doc_id", "kept"],
        )


def duplicate_passages(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """One row per passage of ``least`` words or more of which all is in another document too.

    A passage joins the lines and segments, near-duplicates of those of another document, that overlap or adjoin.  Returns
    doc_id, first_word (from 0), n_words, n_paragraphs (lines and segments joined), class_id (of the first of them; of those
    that begin at one word the shortest, then the smallest class), owner_doc_id (the smallest doc_id of their classes) and
    kept: true for the passages that begin with this document, false for the copies, which may be removed; the two are
    joined apart.  Words are as in ``words``.

    Nulls, empty texts and null ids as in ``duplicate_paragraphs``; rows of one doc_id and text are returned once; an
    empty table gives no rows; other columns are not read.
    """
    texts = _texts(docs)
    found = _found(texts, _shared(texts, MIN_WORDS, True), MIN_WORDS, True)
    schema = "doc_id long, first_word int, n_words int, n_paragraphs int, class_id long, owner_doc_id long, kept boolean"
    dealt = found.drop("paragraph").repartition("row").sortWithinPartitions("row", "kept", "first_word", "n_words", "class_id")
    return dealt.mapInArrow(_joined, schema).filter(F.col("n_words") >= least)
