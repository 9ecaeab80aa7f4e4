"""Document scores by a log-bilinear neural language model over word classes.

A token is a word (``[^\\x20\\x09-\\x0D]+``, A-Z lowered) or the end of its text.  Its probability is

    P(token | two tokens before) = P(class of token | classes of the two before) * P(token | class).

Classes: the end, the most frequent words (one class each), and groups of the other words.  A group is a cluster of word
shapes (first and last letters, from which any unseen word gets its class too), clustered by the frequent words around
them over the whole training corpus, so groups follow the text's language and the place in a sentence.  The number of
classes grows with the sixth root of the training tokens (``classes_for``), so the table of contexts with their cube root.

The class model is log-bilinear: each context position has a matrix, the sum of the transformed context vectors predicts
the next class vector.  It is trained in numpy by noise-contrastive estimation on the counts of all class triples of the
training corpus: few heavy triples stay at hand, the others pass by in blocks dealt by their hashes, and the steps grow
with the number of different triples.  Scores are sums over the two positions, so the model is two tables of pairs and an
exact normaliser of every context, from one matrix product.
P(token | class) has add-one counts over the class's training words and one unknown word for each group.

Counts of every word come from the whole training corpus and never meet in one place: each portion of the documents
counts its words, counts are summed in shares of the hash space, and each portion is sent the totals of its own words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import words
from ledgerflow.llm.runtime import cut, portions_of, shuffle_partitions

SHAPES = 2048
DIMENSIONS = 24
#: Least number of training steps; beyond it there are ``DRAWS`` draws for each different triple of classes.
STEPS = 2500
DRAWS = 2
BATCH = 2048
#: A triple with more than this part of all tokens is heavy; there are fewer heavy ones than the inverse.
HEAVY = 1 / 4096
_U = np.uint64
END = int(words.mix(np.array([0xE0D], _U))[0])
_SHAPE_BITS = _U(SHAPES - 1)


def classes_for(train_tokens: int) -> int:
    """Half the number of classes: as many groups of words as frequent words and the end together."""
    return max(64, int(4 * train_tokens ** (1 / 6)))


def excluded(doc_id: Column) -> Column:
    """Documents that the model never learns from: crc32 of the id modulo 7 is 2; a null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: (first row, end row, token hashes with the ends, token offsets).  A word's hash carries its shape in its low bits."""
    data, offsets = words.text_buffers(texts)
    for i, j in words.runs(offsets):
        piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        hashes, start, end, bounds = words.hash_words(piece, at)
        count = np.diff(bounds) + 1
        out_bounds = np.concatenate([[0], np.cumsum(count)])
        out = np.full(out_bounds[-1], END, _U)
        if len(hashes):
            low = words._LOWER[piece].astype(_U)
            pick = lambda p: low[np.clip(p, start, end - 1)]
            shape = pick(start) * _U(0x1F3) + pick(start + 1) * _U(0x3D1F) + pick(end - 1) * _U(0x95A7) + pick(end - 2) * _U(0xD3F31) + pick(end - 3) * _U(0x2C1B3)
            shape = words.mix(shape) & _SHAPE_BITS
            place = np.arange(len(hashes)) + np.repeat(np.arange(j - i), np.diff(bounds))
            out[place] = (hashes & ~_SHAPE_BITS) | shape
        yield i, j, out, out_bounds


def pack_counts(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    return hashes.astype("<u8").tobytes() + counts.astype("<u8").tobytes()


def unpack_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 16
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64)


def _sum_sorted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(hashes, return_inverse=True)
    return unique, np.bincount(back, weights=counts.astype(float), minlength=len(unique)).astype(np.int64)


def share_of(hashes: np.ndarray, shares: int) -> np.ndarray:
    return ((hashes >> _U(32)) % _U(shares)).astype(np.int32)


@dataclass
class Classes:
    """``frequent``: hashes of the frequent words, sorted; ``group``: the group of each shape, below ``half``."""

    frequent: np.ndarray
    group: np.ndarray
    half: int

    @property
    def number(self) -> int:
        return 2 * self.half

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = (self.half + self.group[(hashes & _SHAPE_BITS).astype(np.int64)]).astype(np.int32)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            hit = self.frequent[at] == hashes
            out[hit] = 1 + at[hit]
        out[hashes == _U(END)] = 0
        return out


def cluster_shapes(around: np.ndarray, total: np.ndarray, groups: int, seed: int = 3) -> np.ndarray:
    """Groups of shapes by k-means on smoothed profiles of the frequent words around them, weighted by their counts."""
    rng = np.random.default_rng(seed)
    base = around.sum(0) + 1.0
    base /= base.sum()
    profile = np.sqrt((around + 20 * base) / (around.sum(1, keepdims=True) + 20))
    weight = total + 1e-3
    centre = profile[rng.choice(len(profile), groups, replace=False, p=weight / weight.sum())]
    group = np.zeros(len(profile), np.int64)
    for _ in range(15):
        group = (profile @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        mass = np.bincount(group, weights=weight, minlength=groups)
        sums = np.zeros_like(centre)
        np.add.at(sums, group, profile * weight[:, None])
        centre = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-12)[:, None], profile[rng.integers(len(profile), size=groups)])
    return group


@dataclass
class LogBilinear:
    """log10 P(class w | classes u, v before) = first[u, w] + second[v, w] - norm[u, v]."""

    first: np.ndarray
    second: np.ndarray
    norm: np.ndarray

    def of(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.first[u, w] + self.second[v, w] - self.norm[u, v]


def _normalised(first: np.ndarray, second: np.ndarray) -> LogBilinear:
    a, b = first.max(1, keepdims=True), second.max(1, keepdims=True)
    norm = np.log(np.exp(first - a) @ np.exp(second - b).T) + a + b.T
    return LogBilinear(first / np.log(10), second / np.log(10), norm / np.log(10))


def draws(heavy: tuple[np.ndarray, np.ndarray], blocks: Iterator[tuple[np.ndarray, np.ndarray]], light: int, steps: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Batches of packed triples, drawn in proportion to their counts: heavy ones from ``heavy`` (places, counts), the others,
    ``light`` in sum, from one block after another, each for a part of the steps that follows from its own sum."""

    def pick(cells: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
        return cells[np.minimum(np.searchsorted(edges, rng.random(n) * edges[-1]), len(cells) - 1)] if n else cells[:0]

    cells, edges = heavy[0], np.cumsum(heavy[1].astype(np.float64))
    mass = edges[-1] if len(edges) else 0.0
    if not light and mass:
        for _ in range(steps):
            yield pick(cells, edges, BATCH)
    for block, counts in blocks:
        sums = np.cumsum(counts.astype(np.float64))
        for _ in range(int(np.ceil(steps * sums[-1] / light))):
            n = int(rng.binomial(BATCH, light / (light + mass)))
            yield np.concatenate([pick(block, sums, n), pick(cells, edges, BATCH - n)])


def train_log_bilinear(batches: Iterator[np.ndarray], frequency: np.ndarray, steps: int, seed: int = 11) -> LogBilinear:
    """The class model, by noise-contrastive estimation from ``batches`` of packed triples; ``frequency``: tokens of each class."""
    rng = np.random.default_rng(seed)
    size = len(frequency)
    frequency = frequency + 0.5
    noise = frequency / frequency.sum()
    log_noise = np.log(noise)
    r = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)  # context vectors
    q = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)  # target vectors
    c = np.stack([np.eye(DIMENSIONS, dtype=np.float32) * s for s in (0.6, 1.0)])
    b = log_noise.astype(np.float32)
    sums = [np.full_like(p, 1e-3) for p in (r, q, c, b)]
    k = 12
    one_hot = np.eye(size, dtype=np.float32)
    edges = np.cumsum(noise)

    def step(which: int, p: np.ndarray, grad: np.ndarray, rate: float) -> None:
        sums[which] += grad**2
        p -= rate * grad / np.sqrt(sums[which])

    for it, packed in enumerate(batches):
        rate = 0.15 * max(0.0, 1 - it / steps) + 0.01
        fake = np.minimum(np.searchsorted(edges, rng.random(8 * k)), size - 1)  # shared by the batch
        u, v, w = packed // size**2, packed // size % size, packed % size
        hidden = r[u] @ c[0] + r[v] @ c[1]
        s_true = (hidden * q[w]).sum(1) + b[w] - np.log(k) - log_noise[w]
        s_fake = hidden @ q[fake].T + b[fake] - np.log(k) - log_noise[fake]
        e_true = (-1 / (1 + np.exp(np.clip(s_true, -30, 30)))).astype(np.float32)
        e_fake = (1 / (1 + np.exp(-np.clip(s_fake, -30, 30))) / 8).astype(np.float32)
        # scatter-adds as products with one-hot rows: there are few classes
        grad_q = one_hot[w].T @ (e_true[:, None] * hidden) + one_hot[fake].T @ (e_fake.T @ hidden)
        grad_b = np.bincount(w, weights=e_true, minlength=size) + np.bincount(fake, weights=e_fake.sum(0), minlength=size)
        grad_h = e_true[:, None] * q[w] + e_fake @ q[fake]
        grad_r = one_hot[u].T @ (grad_h @ c[0].T) + one_hot[v].T @ (grad_h @ c[1].T)
        grad_c = np.stack([r[u].T @ grad_h, r[v].T @ grad_h])
        for which, (p, g) in enumerate(((r, grad_r), (q, grad_q), (c, grad_c), (b, grad_b))):
            step(which, p, (g / len(packed)).astype(np.float32), rate)
    wide = q.astype(np.float64)
    return _normalised((r @ c[0]) @ wide.T, (r @ c[1]) @ wide.T + b)


@dataclass
class Model:
    classes: Classes
    table: LogBilinear
    class_tokens: np.ndarray
    class_types: np.ndarray
    train_tokens: int
    train_types: int

    def log_in_class(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(token | class); groups have one unknown word more, a frequent word or the end is its class's only token."""
        group = cls >= self.classes.half
        inside = np.log10((count + 1.0) / (self.class_tokens[cls] + self.class_types[cls] + 1.0))
        return np.where(group, inside, 0.0)


def _local_counts(batches: Iterator[pa.RecordBatch], shares: int) -> Iterator[pa.RecordBatch]:
    """Each portion's distinct words with their counts in its training texts, packed by share of the hash space."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for portion, parts in held.items():
            h, c = _sum_sorted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            share = share_of(h, shares)
            order = np.argsort(share, kind="stable")
            at = np.searchsorted(share[order], np.arange(shares + 1))
            some = np.flatnonzero(np.diff(at))
            blobs = [pack_counts(h[order[at[s] : at[s + 1]]], c[order[at[s] : at[s + 1]]]) for s in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), portion, np.int32)), pa.array(blobs, pa.binary())], ["share", "portion", "counts"]
            )
        held.clear()

    size = 0
    for batch in batches:
        portion, learn = batch.column("portion").to_numpy(), batch.column("learn").to_numpy(zero_copy_only=False)
        for p in np.unique(portion):
            part = batch.filter(pa.array(portion == p))
            teach = learn[portion == p]
            for i, j, h, bounds in tokens(part.column("text")):
                u, back = np.unique(h, return_inverse=True)
                c = np.bincount(back, weights=np.repeat(teach[i:j], np.diff(bounds)).astype(float), minlength=len(u)).astype(np.int64)
                held.setdefault(int(p), []).append((u, c))
                size += len(u)
        if size > 4_000_000:
            yield from flush()
            size = 0
    yield from flush()


#: Portion number of the row that holds a share's distinct words.
_WHOLE = -1


def _share_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum each share over all portions; send every portion the totals of its words, and keep the share's words once."""
    for batch in _whole_shares(batches):
        parts = [unpack_counts(b) for b in batch[1]]
        h, c = _sum_sorted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        portions, blobs = [_WHOLE], [pack_counts(h, c)]
        for portion, (words_in, _) in zip(batch[0], parts, strict=True):
            portions.append(portion)
            blobs.append(pack_counts(words_in, c[np.searchsorted(h, words_in)]))
        yield pa.RecordBatch.from_arrays([pa.array(portions, pa.int32()), pa.array(blobs, pa.binary())], ["portion", "counts"])


def _whole_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    current, portions, blobs = None, [], []
    for batch in batches:
        for share, portion, blob in zip(*(batch.column(c).to_pylist() for c in ("share", "portion", "counts")), strict=True):
            if share != current and portions:
                yield portions, blobs
                portions, blobs = [], []
            current = share
            portions.append(portion)
            blobs.append(blob)
    if portions:
        yield portions, blobs


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Add up sparse vectors of length ``size``: rows (block, cells: packed place and count), summed by block, then joined.

    The result is of fixed size, whatever the number of documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portions, blobs in _whole_shares(batches):
            found = [unpack_counts(b) for b in blobs]
            at, n = _sum_sorted(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<u8").tobytes() + n.astype("<i8").tobytes()], pa.binary())], ["cells"])
            del portions

    out = np.zeros(size, np.int64)
    for (raw,) in parts.repartition("share").sortWithinPartitions("share").mapInArrow(add, "cells binary").toLocalIterator():
        n = len(raw) // 16
        out[np.frombuffer(raw, "<u8", n).astype(np.int64)] += np.frombuffer(raw, "<i8", n, 8 * n)
    return out


_BLOCKS = 64


def _sparse_rows(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    block = at * _BLOCKS // len(total)
    cuts = np.searchsorted(block, np.arange(_BLOCKS + 1))
    some = np.flatnonzero(np.diff(cuts))
    blobs = [pack_counts(at[cuts[b] : cuts[b + 1]], total[at[cuts[b] : cuts[b + 1]]]) for b in some]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.zeros(len(some), np.int32)), pa.array(blobs, pa.binary())], ["share", "portion", "counts"])


def _around(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, half: int) -> Iterator[pa.RecordBatch]:
    """How often each frequent word stands one or two places from a word of each shape; last column: the shape's tokens."""
    width = half + 1
    total = np.zeros(SHAPES * width, np.int64)
    plain = Classes(frequent, np.zeros(SHAPES, np.int64), half)
    for batch in batches:
        for _, _, h, _ in tokens(batch.column("text")):
            cls = plain.of(h)
            shape = (h & _SHAPE_BITS).astype(np.int64)
            rare = cls >= half
            total += np.bincount(shape[rare] * width + half, minlength=len(total))
            for d in (1, 2):
                for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
                    hit = rare[a] & (cls[b] < half)
                    total += np.bincount(shape[a][hit] * width + cls[b][hit], minlength=len(total))
    yield _sparse_rows(total)


def _triples(batches: Iterator[pa.RecordBatch], classes: Classes, shares: int) -> Iterator[pa.RecordBatch]:
    """Counts of packed class triples, dealt to shares by their hashes."""
    size = classes.number
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            at, n = _sum_sorted(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held.clear()
            share = share_of(words.mix(at.astype(_U)), shares)
            order = np.argsort(share, kind="stable")
            cuts = np.searchsorted(share[order], np.arange(shares + 1))
            some = np.flatnonzero(np.diff(cuts))
            blobs = [pack_counts(at[order[cuts[x] : cuts[x + 1]]], n[order[cuts[x] : cuts[x + 1]]]) for x in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.zeros(len(some), np.int32)), pa.array(blobs, pa.binary())], ["share", "portion", "counts"])

    many = 0
    for batch in batches:
        for _, _, h, bounds in tokens(batch.column("text")):
            one, two, cls = _contexts(classes.of(h), bounds)
            held.append(np.unique((one * size + two) * size + cls, return_counts=True))
            many += len(held[-1][0])
            if many > 4_000_000:
                yield from flush()
                many = 0
    yield from flush()


def _blocks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Each share's triples, summed: rows (heavy, different, mass, counts), those above ``least`` apart from the others."""
    for _, blobs in _whole_shares(batches):
        parts = [unpack_counts(b) for b in blobs]
        at, n = _sum_sorted(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
        for heavy in (True, False):
            mine = (n > least) == heavy
            if mine.any():
                row = [heavy], [int(mine.sum())], [int(n[mine].sum())], [pack_counts(at[mine], n[mine])]
                yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1]), pa.array(row[2]), pa.array(row[3], pa.binary())], ["heavy", "different", "mass", "counts"])


def _contexts(cls: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes two before, one before and of each token; before its first token a text has ends."""
    cls = cls.astype(np.int64)
    two, one = np.zeros_like(cls), np.zeros_like(cls)
    two[1:] = cls[:-1]
    one[2:] = cls[:-2]
    first = bounds[:-1]
    two[first] = 0
    one[first] = 0
    second = first[np.diff(bounds) > 1] + 1
    one[second] = 0
    return one, two, cls


_PACKED = "share int, portion int, counts binary"


def train(rows: DataFrame, portions: int | None = None) -> tuple[Model, DataFrame]:
    """The model, and the table (portion, counts) that holds for each portion of ``rows`` the totals of its words.

    ``rows``: doc_id, text, learn, portion.  The driver receives tables of pairs of classes and blocks of triples, one at a
    time; counts of words stay in the workers."""
    shares = portions or shuffle_partitions(rows.sparkSession)
    local = rows.repartition(shares, "portion").mapInArrow(lambda b: _local_counts(b, shares), _PACKED)
    totals = cut(local.repartition(shares, "share").sortWithinPartitions("share").mapInArrow(_share_totals, "portion int, counts binary"))
    whole = totals.filter(F.col("portion") == _WHOLE).select("counts")

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(unpack_counts(b)[1].sum()) for b in batch.column("counts").to_pylist()], pa.int64())], ["n"])

    train_tokens = whole.mapInArrow(size, "n long").agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    half = classes_for(train_tokens)

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                h, c = unpack_counts(blob)
                h, c = h[h != _U(END)], c[h != _U(END)]
                top = np.argsort(-c, kind="stable")[: half - 1]
                yield pa.RecordBatch.from_arrays([pa.array(h[top].astype(np.uint64).view(np.int64)), pa.array(c[top])], ["h", "c"])

    top = whole.mapInArrow(most, "h long, c long").filter("c > 0").orderBy(F.desc("c"), "h").limit(half - 1).collect()
    frequent = np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))
    taught = rows.filter("learn").select("text")
    width = half + 1
    around = _summed(taught.mapInArrow(lambda b: _around(b, frequent, half), _PACKED), SHAPES * width).reshape(SHAPES, width).astype(float)
    classes = Classes(frequent, cluster_shapes(around[:, :-1], around[:, -1], half), half)
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(2 * half, np.int64), np.zeros(2 * half, np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                h, c = unpack_counts(blob)
                cls = shared.value.of(h)
                n += np.bincount(cls, weights=c.astype(float), minlength=2 * half).astype(np.int64)
                v += np.bincount(cls[c > 0], minlength=2 * half)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * half)), pa.array(n), pa.array(v)], ["cls", "n", "v"])

    class_tokens, class_types = np.zeros(2 * half), np.zeros(2 * half)
    for r in whole.mapInArrow(stats, "cls long, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        class_tokens[r["cls"]], class_types[r["cls"]] = r["n"], r["v"]
    if not train_tokens:
        return Model(classes, _normalised(np.zeros((2 * half, 2 * half)), np.zeros((2 * half, 2 * half))), class_tokens, class_types, 0, 0), totals
    dealt = taught.mapInArrow(lambda b: _triples(b, shared.value, shares), _PACKED).repartition(shares, "share").sortWithinPartitions("share")
    cells = cut(dealt.mapInArrow(lambda b: _blocks(b, train_tokens * HEAVY), "heavy boolean, different long, mass long, counts binary"))
    known = {r["heavy"]: r for r in cells.groupBy("heavy").agg(F.sum("different").alias("different"), F.sum("mass").alias("mass")).collect()}
    heavy = [unpack_counts(r["counts"]) for r in cells.filter("heavy").select("counts").collect()]
    at, n = (np.concatenate([np.zeros(0, np.int64), *(x[i].astype(np.int64) for x in heavy)]) for i in (0, 1))
    steps = max(STEPS, DRAWS * sum(r["different"] for r in known.values()) // BATCH)
    light = cells.filter("not heavy").select("counts").toLocalIterator()
    blocks = ((x.astype(np.int64), y) for x, y in (unpack_counts(r["counts"]) for r in light))
    batches = draws((at, n), blocks, known[False]["mass"] if False in known else 0, steps, np.random.default_rng(7))
    table = train_log_bilinear(batches, class_tokens, steps)
    return Model(classes, table, class_tokens, class_types, train_tokens, int(class_types.sum())), totals


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    portion, known, hashes, counts = None, [], np.zeros(0, _U), np.zeros(0, np.int64)
    for batch in batches:
        at = batch.column("portion").to_numpy()
        is_counts = batch.column("counts").is_valid().to_numpy(zero_copy_only=False)
        for low, high in _even_runs(at, is_counts):
            part = batch.slice(low, high - low)
            if at[low] != portion:
                portion, known, hashes = int(at[low]), [], None
            if is_counts[low]:
                known += [unpack_counts(b) for b in part.column("counts").to_pylist()]
                hashes = None
                continue
            if hashes is None:
                h = np.concatenate([k[0] for k in known]) if known else np.zeros(0, _U)
                c = np.concatenate([k[1] for k in known]) if known else np.zeros(0, np.int64)
                order = np.argsort(h)
                hashes, counts = h[order], c[order].astype(np.int64)
                twice = np.ones(len(hashes), bool)
                twice[1:] = hashes[1:] != hashes[:-1]
                hashes, counts = hashes[twice], counts[twice]
            n, v = model.train_tokens, model.train_types
            out = []
            for i, j, h, bounds in tokens(part.column("text")):
                unique, back = np.unique(h, return_inverse=True)
                c = counts[np.searchsorted(hashes, unique)][back]
                one, two, cls = _contexts(model.classes.of(unique)[back], bounds)
                first = bounds[:-1]
                out.append(
                    (
                        np.diff(bounds),
                        np.add.reduceat((c > 0).astype(np.int64), first),
                        np.add.reduceat(np.log10((c + 1.0) / (n + v + 1.0)), first),
                        np.add.reduceat(model.table.of(one, two, cls) + model.log_in_class(cls, c), first),
                    )
                )
            size, hit, base, score = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(~part.column("learn").to_numpy(zero_copy_only=False)), *(pa.array(x) for x in (size, hit, np.full(len(size), n), base, score))],
                [f.split()[0] for f in _SCORED.split(", ")],
            )


def _even_runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    from ledgerflow.llm.runtime import group_bounds

    cuts = group_bounds(*keys)
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one unigram log10 probability of the text, ``score`` the model's.  A null or empty text is
    its end alone.  Documents that ``excluded`` marks (held_out) are scored but not learnt from.  Repeated rows each
    count and each get a score; an empty table gives no rows; without training documents every token is unknown.
    """
    portions = portions_of(docs)
    rows = docs.select("doc_id", "text", (~excluded(F.col("doc_id"))).alias("learn"), F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(portions)).cast("int").alias("portion"))
    model, totals = train(rows, portions)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    empty = lambda kind: F.lit(None).cast(kind)
    counts = totals.filter(F.col("portion") != _WHOLE).select("portion", F.lit(0).alias("turn"), empty("long").alias("doc_id"), empty("string").alias("text"), F.lit(False).alias("learn"), "counts")
    texts = rows.select("portion", F.lit(1).alias("turn"), "doc_id", "text", "learn", empty("binary").alias("counts"))
    # a portion's totals come first, then its texts, one batch after the other
    dealt = counts.unionByName(texts).repartition(portions, "portion").sortWithinPartitions("portion", "turn")
    return dealt.mapInArrow(lambda b: _scores(b, shared.value), _SCORED)
