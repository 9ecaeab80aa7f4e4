"""Toxicity scores from subword bags.

A word is the mean of its character n-gram vectors (hashed into a fixed number of buckets), a passage of a few words is
the mean of its words, and a linear softmax over two classes reads the passage.  Vectors and softmax are trained jointly
in numpy.  A document is as toxic as the most toxic of its passages, which begin at every word, so a few words are not
diluted by a long clean text; in training, each toxic document's passage is the one that the current model scores
highest, and clean documents learn from the passages that it scores highest as well.  Words of a training passage but
its highest are dropped at random, so that a toxic word counts beside any others.  Misspelt words share n-grams with
their originals.  Scores are calibrated by a model of four fifths of the documents on the fifth that it has not seen.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows per class, the driver's only rows; since averaging and softmax
are linear in the vectors, all it hands out is one number per bucket, of fixed size, and scoring needs one pass over the
texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import words

BUCKETS = 1 << 17
DIMENSIONS = 12
GRAMS = (3, 4, 5, 6)
#: Words of a passage; a shorter text is one passage.
PASSAGE = 3
#: How many of a training passage's words, but its highest, are dropped.
DROPPED = 0.4
#: Most labelled rows per class that the model is fitted on, chosen by a hash of the id.
TRAIN_ROWS = 2000
#: About so many bytes of a text are in the fitting sample; of a longer one they are spread over its whole length.
TRAIN_BYTES = 1 << 16
WINDOWS = 64
#: Bytes of text whose n-grams the driver holds at a time when it fits.
FIT_RUN = 1 << 16
EPOCHS = 14
_U = np.uint64

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def word_grams(texts: pa.Array, run: int = 1 << 19) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]]:
    """For runs of texts, of about ``run`` bytes: (first row, end row, for each n-gram length (bucket, word) of all n-grams, word offsets of the
    texts, hash of each word).  Words are runs of letters and digits, folded to lower case, and a word that repeats the
    one before it is left out; n-grams may include the blanks around a word, of which every word has one of length 3."""
    data, offsets = words.text_buffers(texts)
    for i, j in words.runs(offsets, run):
        piece, at = _FOLD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        hashes, start, end, bounds = words.hash_words(piece, at)
        if len(hashes):
            fresh = np.ones(len(hashes), bool)
            fresh[1:] = hashes[1:] != hashes[:-1]
            fresh[bounds[:-1][np.diff(bounds) > 0]] = True
            bounds = np.concatenate([[0], np.cumsum(fresh)])[bounds]
            hashes, start, end = hashes[fresh], start[fresh], end[fresh]
        else:
            yield i, j, [], bounds, hashes
            continue
        # every word with a blank on either side, one after the other
        inner = end - start
        before = np.concatenate([[0], np.cumsum(inner)])
        flat = np.full(before[-1] + 2 * len(inner), 32, np.uint8)
        here = np.arange(before[-1])
        word = np.repeat(np.arange(len(inner)), inner)
        flat[here + 2 * word + 1] = piece[here + (start - before[:-1])[word]]
        first = before + 2 * np.arange(len(before))
        ahead = words.eight_bytes(flat)
        word = np.repeat(np.arange(len(inner), dtype=np.int32), inner + 2)
        room = first[1:][word] - np.arange(len(flat))
        found = []
        for n in GRAMS:
            p = np.flatnonzero(room >= n)
            grams = words.mix((ahead[p] & _U(2 ** (8 * n) - 1)) + _U(n << 56))
            found.append(((grams >> _U(64 - BUCKETS.bit_length() + 1)).astype(np.int32), word[p]))
        yield i, j, found, bounds, hashes


def _passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all passages, the words after them, and passage offsets of the texts."""
    words_in = np.diff(bounds)
    count = np.where(words_in >= PASSAGE, words_in - PASSAGE + 1, np.minimum(words_in, 1))
    per_text = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(per_text[-1]) + np.repeat(bounds[:-1] - per_text[:-1], count)
    return start, np.minimum(start + PASSAGE, np.repeat(bounds[1:], count)), per_text


def _passage_means(word: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(word, dtype=np.float64)])
    return (total[stop] - total[start]) / (stop - start)


def _passage_maxima(word: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return np.max([word[np.minimum(start + k, stop - 1)] for k in range(PASSAGE)], axis=0)


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1]) / np.diff(bounds)


@dataclass
class Model:
    """``weight``: a bucket's vector times the difference of the classes' softmax rows."""

    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of the toxic class of each text's most toxic passage; a text without words has the bias alone."""
        out = np.full(len(texts), self.bias)
        for i, j, grams, bounds, hashes in word_grams(texts):
            if not len(hashes):
                continue
            word, count = np.zeros(len(hashes)), np.zeros(len(hashes))
            for bucket, owner in grams:
                word += np.bincount(owner, weights=self.weight[bucket], minlength=len(hashes))
                count += np.bincount(owner, minlength=len(hashes))
            word /= count
            start, stop, per_text = _passages(bounds)
            passage = _passage_means(word, start, stop) + self.bias
            have = np.flatnonzero(np.diff(per_text) > 0)
            out[i + have] = np.maximum.reduceat(passage, per_text[:-1][have])
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


@dataclass
class _Corpus:
    """Labelled texts as numbers of distinct words, and the n-gram buckets of these."""

    y: np.ndarray
    text_word: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray

    def __post_init__(self):
        self.start, self.stop, self.per_text = _passages(self.bounds)
        self.size_of = np.diff(self.gram_at)

    def grams_of(self, w: np.ndarray) -> np.ndarray:
        n = self.size_of[w]
        return self.grams[np.repeat(self.gram_at[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def word_scores(self, difference: np.ndarray) -> np.ndarray:
        """Of each word of the texts."""
        return _means(difference[self.grams], self.gram_at)[self.text_word]

    def text_scores(self, model: Model, texts: np.ndarray) -> np.ndarray:
        passage = _passage_means(self.word_scores(model.weight), self.start, self.stop) + model.bias
        return np.array([passage[self.per_text[t] : self.per_text[t + 1]].max() for t in texts])


def _corpus(texts: list[str | None], y: np.ndarray) -> _Corpus | None:
    """Short runs of texts one after the other, each giving the n-grams of words not met before, so the driver holds little
    more than the result."""
    hashes, counts, known, takes, grams = [], [], [], [], []
    seen = np.zeros(0, np.uint64)
    for _, _, found, bounds, h in word_grams(pa.array(texts, pa.large_string()), FIT_RUN):
        hashes.append(h)
        counts.append(np.diff(bounds))
        if not len(h):
            continue
        unique, where = np.unique(h, return_index=True)
        if len(seen):
            at = np.minimum(np.searchsorted(seen, unique), len(seen) - 1)
            unique, where = unique[seen[at] != unique], where[seen[at] != unique]
        owner = np.concatenate([o for _, o in found])
        order = np.argsort(owner, kind="stable")
        word_at = np.searchsorted(owner[order], np.arange(len(h) + 1))
        take = np.diff(word_at)[where]
        index = np.repeat(word_at[where], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        known.append(unique)
        takes.append(take)
        grams.append(np.concatenate([b for b, _ in found])[order][index])
        seen = np.insert(seen, np.searchsorted(seen, unique), unique)
    if not len(seen):
        return None
    # each run's words take their places among all words by hash
    ats = [np.searchsorted(seen, unique) for unique in known]
    size_of = np.zeros(len(seen), np.int64)
    for at, take in zip(ats, takes, strict=True):
        size_of[at] = take
    gram_at = np.concatenate([[0], np.cumsum(size_of)])
    all_grams = np.zeros(gram_at[-1], np.int32)
    for at, take, part in zip(ats, takes, grams, strict=True):
        all_grams[np.repeat(gram_at[at] - np.cumsum(take) + take, take) + np.arange(len(part))] = part
    text_word = np.concatenate([np.searchsorted(seen, h) for h in hashes])
    return _Corpus(y, text_word, np.concatenate([[0], np.cumsum(np.concatenate(counts))]), all_grams, gram_at)


def _guess(corpus: _Corpus, texts: np.ndarray) -> np.ndarray:
    """A first score of each passage: its highest word by the mean log odds of the word's n-grams over ``texts`` of either class."""
    seen = np.zeros((2, BUCKETS))
    for t in texts:
        g = corpus.grams_of(np.unique(corpus.text_word[corpus.bounds[t] : corpus.bounds[t + 1]]))
        seen[int(corpus.y[t])][np.unique(g)] += 1
    share = (seen + 0.5) / (np.bincount(corpus.y[texts].astype(int), minlength=2)[:, None] + 1)
    return _passage_maxima(corpus.word_scores(np.log(share[1] / share[0])), corpus.start, corpus.stop)


def _trained(corpus: _Corpus, texts: np.ndarray, seed: int) -> Model:
    """Vectors and softmax from ``texts``, which have words, by Adagrad."""
    rng = np.random.default_rng(seed)
    y, per_text, passages = corpus.y[texts], corpus.per_text, np.diff(corpus.per_text)[texts]
    mine = np.repeat(per_text[texts], passages) + np.arange(passages.sum()) - np.repeat(np.cumsum(passages) - passages, passages)
    first = np.cumsum(passages) - passages
    start, stop = corpus.start[mine], corpus.stop[mine]
    vectors = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = np.stack([np.full(DIMENSIONS, -0.5), np.full(DIMENSIONS, 0.5)]).astype(np.float32) * rng.choice([-1, 1], DIMENSIONS)
    bias = np.array([0.0, -1.0], np.float32)
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full_like(softmax, 1e-2), np.full(2, 1e-2, np.float32)
    guess = _guess(corpus, texts)[mine]
    epochs = min(4 * EPOCHS, max(EPOCHS, 40_000 // len(y)))  # few examples are seen more often
    clean = np.flatnonzero(y == 0)
    for epoch in range(epochs):
        rate = 1 - 0.95 * epoch / epochs
        word = corpus.word_scores(vectors @ (softmax[1] - softmax[0]))
        score = guess if epoch < 3 else _passage_means(word, start, stop)  # at first the model knows nothing
        best = np.maximum.reduceat(score, first)
        top = np.flatnonzero(score == np.repeat(best, passages))
        owner = np.searchsorted(first, top, side="right") - 1
        picked = [top[np.unique(owner, return_index=True)[1]]]
        picked += [first[clean] + (rng.random(len(clean)) * passages[clean]).astype(np.int64) for _ in range(4)]
        chosen = rng.permutation(np.concatenate(picked))
        target = y[np.searchsorted(first, chosen, side="right") - 1]
        size = min(256, max(8, len(chosen) // 24))  # few examples still make enough steps
        for low in range(0, len(chosen), size):
            seg, t = chosen[low : low + size], target[low : low + size]
            count = stop[seg] - start[seg]
            seg_of_word = np.repeat(np.arange(len(seg)), count)
            place = np.repeat(start[seg], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            value = word[place]
            highest = value == np.maximum.reduceat(value, np.cumsum(count) - count)[seg_of_word]
            keep = highest | (rng.random(len(place)) >= DROPPED)
            w, seg_of_word = corpus.text_word[place[keep]], seg_of_word[keep]
            n_words = np.bincount(seg_of_word, minlength=len(seg))
            n_grams = corpus.size_of[w]
            g = corpus.grams_of(w)
            per_gram = np.repeat((1 / n_words[seg_of_word] / n_grams).astype(np.float32), n_grams)
            seg_of_gram = np.repeat(seg_of_word, n_grams)
            seg_at = np.searchsorted(seg_of_gram, np.arange(len(seg)))
            mean = np.add.reduceat(vectors[g] * per_gram[:, None], seg_at)
            logit = mean @ softmax.T + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.stack([1 - t, t], 1)) / len(seg)
            grad_s, grad_b, grad_mean = error.T @ mean, error.sum(0), error @ softmax
            unique, back = np.unique(g, return_inverse=True)
            grad_v = np.stack([np.bincount(back, weights=per_gram * grad_mean[seg_of_gram, d], minlength=len(unique)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            seen_v[unique] += (grad_v**2).mean(1)
            vectors[unique] -= 0.1 * rate * grad_v / np.sqrt(seen_v[unique])[:, None]
            seen_s += grad_s**2
            softmax -= 0.05 * rate * grad_s / np.sqrt(seen_s)
            seen_b += grad_b**2
            bias -= 0.1 * rate * grad_b / np.sqrt(seen_b)
    return Model((vectors @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Joint training of n-gram vectors and softmax; with fewer than two classes or no words, a constant score.

    Repeated texts count as often as they come; the order of the texts decides which of them calibrate the scores."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 9.0 if len(y) and y.min() == 1 else -9.0)
    corpus = _corpus(texts, y)
    if corpus is None:  # no text has a word
        return Model(np.zeros(BUCKETS, np.float32), float(np.clip(np.log(y.mean() / (1 - y.mean())), -9, 9)))
    have = np.flatnonzero(np.diff(corpus.bounds) > 0)
    if y[have].min() == y[have].max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.clip(np.log(y.mean() / (1 - y.mean())), -9, 9)))
    # every fifth text of either class is held back
    rank = np.zeros(len(have), np.int64)
    for c in (0, 1):
        rank[y[have] == c] = np.arange((y[have] == c).sum())
    back, rest = have[rank % 5 == 4], have[rank % 5 != 4]
    model = _trained(corpus, have, seed)
    if len(np.unique(y[back])) < 2:
        back, trial = have, model
    else:
        trial = _trained(corpus, rest, seed)
    slope, shift = _calibrated(corpus.text_scores(trial, back), y[back])
    return Model((model.weight * slope).astype(np.float32), model.bias * slope + shift)


def _calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the texts' scores log odds of their labels, were both classes as frequent: Platt scaling by
    Newton steps, then half of the classes' own log odds taken off: a toxic document that is missed weighs more than a clean
    one that is flagged, by the root of how much rarer it is.

    Passages are trained one by one, but a text is read by its highest, which lies higher the longer it is."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([score, np.ones(len(score))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (p - target) + 1e-2 * (at - np.array([1.0, 0.0]))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(curve, grad)
        at = at - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(at[0], 1e-3)), float(at[1] + 0.5 * np.log(n0 / n1))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _spread(text: Column, most: int) -> Column:
    """``text``, or where it is longer than ``most`` bytes, windows over its whole length, a blank between them."""
    size, room = F.length(text), F.greatest(F.lit(1), F.floor(F.lit(most).cast("long") * F.length(text) / F.octet_length(text) / WINDOWS).cast("int"))
    at = lambda k: (k.cast("long") * (size - room) / F.lit(WINDOWS - 1)).cast("int") + 1
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring(text, at(k), room))
    return F.when(F.octet_length(text) > most, F.array_join(windows, " ")).otherwise(text)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bytes_each: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``rows`` labelled documents per class, never on those held out (crc32 of the id modulo 5 is 0).

    Labels with a null id or mark are ignored; of several marks of one document the larger counts, of several rows of one
    id the one with the least hash of its text.  Only the labels are ranked (by a hash of the id); the chosen ids, of
    bounded number, are broadcast to fetch their texts.  Of a chosen text of more than ``bytes_each`` bytes, ``WINDOWS``
    windows spread evenly from its start to its end take part, of ``bytes_each`` bytes together at its mean width of a
    character, so the driver gets a bounded sample of texts of any length; scoring reads every text whole.
    An empty table or no label gives a constant score.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    chosen = marks.filter("toxic = 1").orderBy("h", "doc_id").limit(rows).unionAll(marks.filter("toxic = 0").orderBy("h", "doc_id").limit(rows))
    ids = [(r["doc_id"], r["toxic"]) for r in chosen.collect()]
    spark = docs.sparkSession
    small = spark.createDataFrame(ids, "doc_id long, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").withColumn("text", _spread(F.col("text"), bytes_each))
    found = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([r["text"] for r in found], [r["toxic"] for r in found])


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (by default all) with ``toxicity`` from 0 to 1 of its ``text``; a null text is
    empty, a column that already has the name ``toxicity`` is replaced.  Every row is scored by itself, repeated rows alike
    and texts of any length whole; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [n for n in (docs.columns if carry is None else carry) if n != "toxicity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shared.value.score(batch.column("text")).astype(np.float64))], [*names, "toxicity"])

    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names) + ", toxicity double"
    return docs.mapInArrow(run, schema)
