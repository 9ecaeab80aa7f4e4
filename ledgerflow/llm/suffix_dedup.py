"""Repeated passages across documents by a sparse suffix array.

Of all suffixes (by words) only those at minimisers are kept: a position whose hash of the next ``K`` words is the least
in some window of ``W`` positions.  Two copies of a passage of K + W - 1 = 50 words or more have such a position in
common, whatever stands around them, and about 2 / (W + 1) of all positions are kept.

Kept suffixes are sorted by the 64-bit hash of their first K words (equal ones are neighbours), with the hashes of the W
ways to extend these to 50 words at hand: s words to the left and W - 1 - s to the right.  Among neighbours, each way is
sorted and neighbours compared; one that is found in an earlier document (by doc_id) lies in a repeated passage, which
extends to the left and right as long as its 50-word windows do.  The result is exactly the union of all 50-word windows
that occur in an earlier document; windows are told apart by the hash of the first K words and 40 bits of their own.

A passage that a large part of all documents shares has keys with very many suffixes.  Keys are counted first, in cells
of a hash; suffixes of cells with more than a quarter of a partition take another way, in which no task gathers a key:
those that look alike with all their extensions are one look, the earliest document of each extension comes from a
combinable aggregate over the looks, and each suffix is joined with its look's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import words
from ledgerflow.llm.runtime import cut, group_bounds, rows_by_key, shuffle_partitions

K, W = 25, 26
PASSAGE = K + W - 1
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)
_LAST = 2**63 - 1


def _sliding(x: np.ndarray, width: int, ufunc) -> np.ndarray:
    """ufunc over x[i : i + width], for all i but the last width - 1; blocks of running results from both ends."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, x[-1], x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(rows, width)
    ahead = ufunc.accumulate(table, axis=1).ravel()
    behind = ufunc.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[:n], ahead[width - 1 : width - 1 + n])


def minimisers(grams: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Positions of ``grams`` (of texts with the offsets ``texts``) that are the least of a window of W, or of a shorter text; all of equal ones."""
    count = np.diff(texts)
    # texts apart by W - 1 places, so that no window joins two
    place = np.arange(len(grams)) + np.repeat(np.arange(len(count)), count) * (W - 1)
    size = len(grams) + (len(count) + 1) * (W - 1)
    spread = np.full(size, _TOP)
    spread[place] = grams
    least = _sliding(spread, W, np.minimum)  # window from i
    valid = np.zeros(len(least), bool)
    first = texts[:-1] + np.arange(len(count)) * (W - 1)
    windows = np.where(count > 0, np.maximum(count - W + 1, 1), 0)
    valid[np.repeat(first - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())] = True
    least[~valid] = 0
    most = _sliding(np.concatenate([np.zeros(W - 1, _U), least]), W, np.maximum)  # over the windows that hold i
    return np.flatnonzero(most[place] == grams)


def kept_suffixes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (first row, text, word position, key, windows) of kept suffixes; window s is the hash of the 50
    words that begin s words before, 0 where they leave the text."""
    data, offsets = words.text_buffers(texts)
    for i, j in words.runs(offsets):
        h, _, _, bounds = words.hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        count = np.diff(bounds)
        have = np.where(count >= PASSAGE, count - K + 1, 0)
        if not have.sum():
            continue
        at = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(have)[:-1]]), have) + np.arange(have.sum())
        grams = words.window_hashes(h, K)[at]
        kept = minimisers(grams, np.concatenate([[0], np.cumsum(have)]))
        text = np.searchsorted(bounds, at[kept], side="right") - 1
        low, high, p = bounds[text], bounds[text + 1], at[kept]
        whole = words.window_hashes(h, PASSAGE) | _U(1 << 63)
        begin = p[:, None] - np.arange(W)
        inside = (begin >= low[:, None]) & (begin + PASSAGE <= high[:, None])
        yield i, text, (p - low).astype(np.int32), grams[kept], np.where(inside, whole[np.clip(begin, 0, len(whole) - 1)], _U(0))


#: Most cells that keys are counted in.
_CELLS = 1 << 20


def _cell(key: np.ndarray, cells: int) -> np.ndarray:
    return (words.mix(key) & _U(cells - 1)).astype(np.int64)


def hot_cells(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(number of cells, the cells of keys that have more than a quarter of a partition's suffixes); these are at most 4 a partition."""
    parts = shuffle_partitions(rows.sparkSession)
    cells = min(_CELLS, 1 << max(16, (64 * parts - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, _, _, key, _ in kept_suffixes(batch.column("text")):
                total += np.bincount(_cell(key, cells), minlength=cells)
        some = np.flatnonzero(total)
        for low in range(0, len(some), 1 << 16):
            part = some[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["cell", "n"])

    counted = cut(rows.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.filter(F.col("n") > total / (4 * parts) + 4 * total / cells).select("cell").collect()
    return cells, np.sort(np.array([r["cell"] for r in hot], np.int64))


_KEPT = "key long, place long, row long, positions array<int>, windows binary"


def _emit(batches: Iterator[pa.RecordBatch], cells: int, hot: np.ndarray, want_hot: bool) -> Iterator[pa.RecordBatch]:
    """Kept suffixes, those of hot cells or the others.  Suffixes of a text that look alike with all their extensions are one
    row with all their positions, so a text that repeats a few words for long has few rows.  The key of a hot one is its look."""
    weight = words.mix(np.arange(W, dtype=_U) + _U(5)) | _U(1)
    size = 8 if want_hot else 5
    for batch in batches:
        for i, text, position, key, windows in kept_suffixes(batch.column("text")):
            mine = np.flatnonzero(np.isin(_cell(key, cells), hot) == want_hot)
            if not len(mine):
                continue
            text, position, key, windows = text[mine], position[mine], key[mine], windows[mine]
            look = words.mix((words.mix(windows) * weight).sum(1, dtype=_U) + key)
            order = np.lexsort((position, look, text))
            cuts = group_bounds(text[order], look[order])
            first = order[cuts[:-1]]
            take = pa.array(text[first] + i)
            raw = np.ascontiguousarray(windows[first].view(np.uint8).reshape(len(first), W, 8)[:, :, 8 - size :])
            places = pa.array(np.arange(len(first) + 1, dtype=np.int32) * (W * size))
            packed = pa.Array.from_buffers(pa.binary(), len(first), [None, places.buffers()[1], pa.py_buffer(raw.tobytes())])
            positions = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(position[order]))
            name = look if want_hot else key
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[first].view(np.int64)), batch.column("place").take(take), batch.column("row").take(take), positions, packed], ["key", "place", "row", "positions", "windows"]
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated stretches (row, start, end, source) of a stream sorted by (key, place, row)."""
    for rows in rows_by_key(batches, ["key"]):
        rows = rows.combine_chunks()
        key, place = rows.column("key").to_numpy(), rows.column("place").to_numpy()
        cuts = group_bounds(key)
        # neighbours that are all in one document repeat nothing
        alone = place[cuts[:-1]] == place[cuts[1:] - 1]
        take = np.flatnonzero(np.repeat(~alone, np.diff(cuts)))
        for part in np.split(take, np.flatnonzero(np.diff(np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[take] // 4096)) + 1):
            if len(part):
                found = _extend(rows.take(pa.array(part)))
                if found is not None:
                    yield found


def _extend(rows: pa.Table) -> pa.RecordBatch | None:
    rows = rows.combine_chunks()
    key, place, row = (rows.column(c).to_numpy() for c in ("key", "place", "row"))
    raw = np.zeros((len(key), W, 8), np.uint8)
    raw[:, :, 3:] = np.frombuffer(b"".join(rows.column("windows").to_pylist()), np.uint8).reshape(len(key), W, 5)
    windows = raw.view("<u8").reshape(len(key), W)
    mixed = words.mix(key.view(_U))
    source = np.full((len(key), W), _LAST)
    for s in range(W):
        ok = np.flatnonzero(windows[:, s])
        if not len(ok):
            continue
        extended = windows[ok, s] ^ mixed[ok]
        order = np.argsort(extended, kind="stable")  # rows come by place, so the first of equal ones is the earliest
        cuts = group_bounds(extended[order])
        source[ok[order], s] = np.repeat(place[ok[order[cuts[:-1]]]], np.diff(cuts))
    return _stretches(row, place, rows.column("positions").chunk(0), source)


def _stretches(row: np.ndarray, place: np.ndarray, lists: pa.ListArray, source: np.ndarray) -> pa.RecordBatch | None:
    """(row, start, end, source) of what an earlier document holds: ``source`` is the earliest document of each window."""
    repeated = source < place[:, None]
    # runs of consecutive extensions are one stretch
    edge = np.zeros((len(row), W + 2), np.int8)
    edge[:, 1:-1] = repeated
    change = np.diff(edge, axis=1)
    which, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    if not len(which):
        return None
    out = np.minimum.reduceat(np.append(source.ravel(), 0), np.stack([which * W + first, which * W + last], 1).ravel())[::2]
    at, position = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(at)[which]
    each = np.repeat(np.arange(len(which)), size)
    position = position[np.repeat(at[:-1][which] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row[which][each]),
            pa.array((position - last[each] + 1).astype(np.int32)),
            pa.array((position - first[each] + PASSAGE).astype(np.int32)),
            pa.array(out[each]),
        ],
        ["row", "start", "end", "source"],
    )


def _hot_stretches(kept: DataFrame) -> DataFrame:
    """The stretches of suffixes of hot cells (with their looks as keys); no task gathers more than the combined rows of a key."""
    kept = cut(kept)
    looks = kept.groupBy("key").agg(F.min("place").alias("first"), F.any_value("windows").alias("windows"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                window = np.frombuffer(b"".join(batch.column("windows").to_pylist()), np.int64)
                which = pa.array(np.repeat(np.arange(batch.num_rows), W))
                s = np.tile(np.arange(W, dtype=np.int32), batch.num_rows)
                table = pa.RecordBatch.from_arrays([batch.column("key").take(which), batch.column("first").take(which), pa.array(s), pa.array(window)], ["key", "first", "s", "window"])
                yield table.filter(pa.array(window != 0))

    single = cut(looks.mapInArrow(windows, "key long, first long, s int, window long"))
    earliest = cut(single.groupBy("window").agg(F.min("first").alias("source")))
    sources = cut(single.join(earliest, "window").groupBy("key").agg(F.collect_list(F.struct("s", "source")).alias("sources")))  # at most W

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = np.full((batch.num_rows, W), _LAST)
            lists = batch.column("sources")
            which = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            source[which, flat.field("s").to_numpy()] = flat.field("source").to_numpy()
            found = _stretches(batch.column("row").to_numpy(), batch.column("place").to_numpy(), batch.column("positions"), source)
            if found is not None:
                yield found

    return kept.select("key", "place", "row", "positions").join(sources, "key").select("place", "row", "positions", "sources").mapInArrow(run, _FOUND)


_FOUND = "row long, start int, end int, source long"
_SPAN = "array<struct<start:int,end:int,source:bigint>>"


def _merged(found: DataFrame) -> DataFrame:
    """(row, spans): overlapping and adjoining stretches of a row joined, in order; a span's source is its smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by_key(batches, ["row"]):
            rows = rows.combine_chunks()
            row, start, end, source = (rows.column(c).to_numpy() for c in ("row", "start", "end", "source"))
            ids, lists = [], []
            cuts = group_bounds(row)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                spans: list[list[int]] = []
                for s, e, f in zip(start[a:b].tolist(), end[a:b].tolist(), source[a:b].tolist(), strict=True):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1:] = [max(e, spans[-1][1]), min(f, spans[-1][2])]
                    else:
                        spans.append([s, e, f])
                ids.append(int(row[a]))
                lists.append([{"start": s, "end": e, "source": f} for s, e, f in spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, kind)], ["row", "spans"])

    return found.repartition("row").sortWithinPartitions("row", "start", "end").mapInArrow(run, f"row long, spans {_SPAN}")


def _with_row(docs: DataFrame) -> DataFrame:
    """``row`` stands for a document's id and text; ``place`` is its order, a null id comes last."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row, spans) of the documents of ``docs`` (doc_id, text) that hold passages of an earlier document.

    ``spans`` are word ranges, in order, each with the smallest doc_id it was found in.  A passage has 50 words or more;
    words are as in ``words``.  Repeats within a document, or between rows of one doc_id, are none.  Null, empty and
    short texts have no spans; an empty table gives no rows.  Rows of one id and text have one row here.
    """
    rows = _with_row(docs.select("doc_id", "text")).filter(F.col("text").isNotNull())
    cells, hot = hot_cells(rows)
    rows = rows.select("place", "row", "text")
    kept = rows.mapInArrow(lambda b: _emit(b, cells, hot, False), _KEPT)
    found = kept.repartition("key").sortWithinPartitions("key", "place", "row").mapInArrow(_compare, _FOUND)
    if len(hot):
        found = found.unionByName(_hot_stretches(rows.mapInArrow(lambda b: _emit(b, cells, hot, True), _KEPT)))
    return _merged(found)


def spans_by_document(docs: DataFrame) -> DataFrame:
    """One row per span: doc_id, start_word, end_word, n_words, source_doc_id (an earlier document that holds its text)."""
    names = _with_row(docs.select("doc_id", "text")).select("row", "doc_id")
    spans = repeated_spans(docs).select("row", F.explode("spans").alias("s"))
    return names.join(spans, "row").select(
        "doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), (F.col("s.end") - F.col("s.start")).alias("n_words"), F.col("s.source").alias("source_doc_id")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; all rows and columns stay, a text may become empty.

    Of each passage the earliest document keeps its copy.  A cut takes the words of a span and what stands between them.
    """
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # no name of the table meets one used here
    row = F.xxhash64(f"c{names.index('doc_id')}", f"c{at}")
    marked = plain.withColumn("row", row).join(repeated_spans(docs), "row", "left").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(batch.num_columns - 1).to_pylist(), batch.column(at)
            hit = [i for i, s in enumerate(spans) if s]
            if hit:
                values = texts.to_pylist()
                some = texts.take(pa.array(hit))
                data, offsets = words.text_buffers(some)
                for n, i in enumerate(hit):
                    raw = data[offsets[n] : offsets[n + 1]]
                    _, start, end, _ = words.hash_words(raw, np.array([0, len(raw)]))
                    parts, before = [], 0
                    for s in spans[i]:
                        parts.append(raw[before : start[s["start"]]].tobytes())
                        before = end[s["end"] - 1]
                    values[i] = (b"".join(parts) + raw[before:].tobytes()).decode()
                texts = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(len(names))], [f"c{k}" for k in range(len(names))])

    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return marked.mapInArrow(run, schema).toDF(*names)
