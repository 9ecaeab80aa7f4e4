"""Hard negatives by exact search over one-dimensional distance keys.

Vectors become integers; one more component brings all to the same length, so the inner product with an anchor falls as
the distance to it grows.  A few pivots are fitted on a bounded sample.  Each vector is stored under its key (pivot,
distance to it), sorted, in blocks of consecutive keys.  By the triangle inequality a vector within r of an anchor has a
key within r of the anchor's own distance to that pivot, so a search scans, for every pivot, the blocks that overlap a
key interval, and widens it round by round.  It ends when the last of its k scores beats whatever may lie outside of the
intervals.  A search within a band of scores starts beyond the blocks that lie wholly nearer than the band.

Searches meet blocks in groups of near keys: a pair of a group and a block is one row of a join and one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.embedding_dedup import _kmeans
from ledgerflow.llm.runtime import cut, shuffle_partitions, table_path

SAMPLE = 20_000
PIVOTS = 256
BLOCK = 1024
GROUP = 256
_KEY = ["anchor", "tag"]
_QUERY = "anchor long, tag long, label long, vector array<int>, cap long, least long, squared long, reach double, pivot int, dist double"
_BLOCKS = "block long, pivot int, low double, high double, ids binary, labels binary, vectors binary"
_GROUPS = "group long, near array<double>, far array<double>, done_near array<double>, done_far array<double>, inner array<double>, anchors binary, tags binary, labels binary, vectors binary, caps binary, least binary"


def floor_div(value: Column, by: int) -> Column:
    """The whole quotient rounded down, without a detour through doubles."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


@dataclass(frozen=True)
class Space:
    """The pivots, the length that all vectors are brought to, and how far each pivot's keys reach."""

    pivots: np.ndarray
    squared: int
    start: float  # the radius of the second round
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.squared - (x * x).sum(1)))[:, None]], 1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """Distances to the pivots."""
        d = (lifted * lifted).sum(1)[:, None] - 2 * (lifted @ self.pivots.T) + (self.pivots**2).sum(1)[None, :]
        return np.sqrt(np.maximum(0.0, d))

    def anchored(self, x: np.ndarray) -> np.ndarray:
        """Distances of anchors, which have no further component, to the pivots."""
        return self.distances(np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], 1))

    @property
    def error(self) -> float:
        """More than a distance can be off by rounding."""
        return 1e-6 * (1 + self.squared**0.5)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(lists), -1)


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def fit(sample: np.ndarray, squared: int, n: int, k: int) -> Space:
    """Pivots of a sample, more for more vectors; the first radius is how far the k-th neighbour within the sample is, and
    no tiny part of the whole, so that few rounds reach everything."""
    rng = np.random.default_rng(7)
    space = Space(np.zeros((1, sample.shape[1] + 1)), squared, 0.0)
    lifted = space.lifted(sample)
    pivots = _kmeans(lifted, int(min(PIVOTS, len(sample), max(8, n**0.5 / 8))), rng)
    some = lifted[rng.permutation(len(lifted))[:256]]
    d = np.sort(np.maximum(0.0, (some * some).sum(1)[:, None] - 2 * (some @ lifted.T) + (lifted**2).sum(1)[None, :]), 1)
    start = float(np.sqrt(np.median(d[:, min(k, d.shape[1] - 1)])))
    return replace(space, pivots=pivots, start=max(start, squared**0.5 / 16))


def _keys(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = space.distances(space.lifted(_matrix(batch.column("vector")))) if batch.num_rows else np.zeros((0, 1))
        own = d.argmin(1)
        made = [pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "vector")), *made], ["vec_id", "label", "vector", "pivot", "dist"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows into blocks: consecutive keys of one pivot; rows of a block stand by id."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []

    def made(rows: pa.Table) -> pa.RecordBatch:
        nonlocal number
        rows = rows.sort_by("vec_id").combine_chunks()
        dist = rows.column("dist").to_numpy()
        number += 1
        values = [[number - 1], [rows.column("pivot")[0].as_py()], [dist.min()], [dist.max()]]
        data = [rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("vector").combine_chunks())]
        types = [pa.int64(), pa.int32(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(v, t) for v, t in zip(values, types, strict=True)), *(pa.array([_bytes(v)], pa.binary()) for v in data)], [f.split()[0] for f in _BLOCKS.split(", ")]
        )

    def ready(rows: pa.Table, last: bool) -> Iterator[tuple[pa.Table, bool]]:
        """Whole blocks of ``rows``, and what is left of them."""
        pivot = rows.column("pivot").to_numpy()
        bounds = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), len(pivot)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for at in range(a, b, BLOCK):
                whole = last or b < len(pivot) or at + BLOCK <= b
                yield rows.slice(at, min(BLOCK, b - at)), whole

    for batch in batches:
        if batch.num_rows:
            rows, held = pa.Table.from_batches([*held, batch]), []
            for part, whole in ready(rows, last=False):
                if whole:
                    yield made(part)
                else:
                    held = part.combine_chunks().to_batches()
    if held:
        for part, _ in ready(pa.Table.from_batches(held), last=True):
            yield made(part)


def _placed(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """Anchors with the nearest pivot and how far their keys can be from any vector's."""
    for batch in batches:
        x = _matrix(batch.column("vector")) if batch.num_rows else np.zeros((0, space.pivots.shape[1] - 1), np.int32)
        d = space.anchored(x)
        own = d.argmin(1)
        held = np.isfinite(space.low)  # pivots with vectors
        reach = np.maximum(np.abs(d - space.low)[:, held], np.abs(d - space.high)[:, held]).max(1)
        squared = (x.astype(np.int64) ** 2).sum(1)
        made = [pa.array(squared), pa.array(reach + space.error), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])]
        names = ["anchor", "tag", "label", "vector", "cap", "least"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [f.split()[0] for f in _QUERY.split(", ")])


def _groups(batches: Iterator[pa.RecordBatch], space: Space, size: int) -> Iterator[pa.RecordBatch]:
    """Searches of near keys together, with the key intervals that they have to scan and those that all of them have scanned."""
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for low in range(0, whole.num_rows, size):
            rows = whole.slice(low, size)
            x = _matrix(rows.column("vector"))
            d = space.anchored(x)
            r, was, first = (rows.column(c).to_numpy()[:, None] for c in ("radius", "was", "first"))
            value = lambda a: pa.array([a.tolist()], pa.list_(pa.float64()))
            spans = [(d - r).min(0), (d + r).max(0), (d - was).max(0), (d + was).min(0), (first - d).min(0)]
            floor = np.maximum(rows.column("least").to_numpy(), rows.column("kth").to_numpy())
            data = [*(rows.column(c).to_numpy() for c in ("anchor", "tag", "label")), x, rows.column("cap").to_numpy(), floor]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *map(value, spans), *(pa.array([_bytes(v)], pa.binary()) for v in data)], [f.split()[0] for f in _GROUPS.split(", ")]
            )
            number += 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of integers."""
    top = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0)) * a.shape[1]
    if top < 1 << 53:  # every sum on the way is a whole number that a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _scores(batches: Iterator[pa.RecordBatch], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each block for each search of the group: least id first among equal scores."""
    for batch in batches:
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(batch.num_rows):
            data = lambda name, kind=np.int64, i=i: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
            anchors, tags, ids = data("anchors"), data("tags"), data("ids")
            each, back = np.unique(anchors, return_index=True)[1], np.unique(anchors, return_inverse=True)[1]
            s = products(data("vectors", np.int32).reshape(len(anchors), -1)[each], data("block_vectors", np.int32).reshape(len(ids), -1))[back]
            fits = ((data("labels")[:, None] == data("block_labels")[None, :]) == same) & (anchors[:, None] != ids[None, :])
            fits &= (s <= data("caps")[:, None]) & (s >= data("least")[:, None])
            if len(ids) > k:
                held = np.where(fits, s, np.iinfo(np.int64).min)
                fits &= s >= np.partition(held, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
            q, at = np.nonzero(fits)
            order = np.lexsort((at, -s[q, at], q))
            q, at = q[order], at[order]
            place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            q, at = q[place < k], at[place < k]
            out.append((anchors[q], tags[q], ids[at], s[q, at]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], [*_KEY, "id", "score"])


class KeyIndex:
    """Vectors (vec_id, label, vector) of one length, stored by (pivot, distance)."""

    def __init__(self, rows: DataFrame, k: int):
        self.spark: SparkSession = rows.sparkSession
        norm = F.aggregate("vector", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v.cast("long"))
        n, squared = rows.agg(F.count(F.lit(1)), F.max(norm)).collect()[0]
        self.n = n
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
        space = fit(_matrix(sample), squared, n, k)
        self.keys = rows.mapInArrow(lambda b, s=space: _keys(b, s), "vec_id long, label long, vector array<int>, pivot int, dist double")
        parts = max(1, min(shuffle_partitions(self.spark), -(-n // BLOCK)))
        path = table_path(self.spark, "distance-keys")
        self.keys.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id").mapInArrow(_blocks, _BLOCKS).write.parquet(path)
        self.blocks = self.spark.read.schema(_BLOCKS).parquet(path)
        low, high = np.full(len(space.pivots), -np.inf), np.full(len(space.pivots), np.inf)
        for r in self.blocks.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a row for each pivot
            low[r["pivot"]], high[r["pivot"]] = r["low"], r["high"]
        self.space = replace(space, low=low, high=high)

    def _radius(self, score: Column) -> Column:
        """The distance at which a vector has this score, a little further by rounding."""
        return F.sqrt(F.greatest(F.lit(0.0), F.lit(float(self.space.squared)) + F.col("squared") - 2.0 * score))

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, tag, id, score): the first ``k`` vectors of each search, or all that fit, higher scores and then smaller
        ids first.

        ``queries``: anchor, tag, label, vector, cap, least.  Fitting vectors have another id than the anchor, a label equal
        to its own (``same``) or different, and a score between least and cap."""
        space, error = self.space, self.space.error
        placed = queries.mapInArrow(lambda b: _placed(b, space), _QUERY)
        first = F.greatest(F.lit(-1.0), self._radius(F.col("cap").cast("double")) - error)
        floor = F.least(F.col("reach"), self._radius(F.col("least").cast("double")) + error)
        lowest = F.lit(-(2**62)).cast("long")
        active = placed.withColumn("first", first).withColumn("last", floor).withColumn("was", F.lit(float("-inf"))).withColumn("radius", F.lit(error)).withColumn("kth", lowest)
        active, found = cut(active), None
        while n := active.count():
            size = int(min(GROUP, max(32, n // (4 * shuffle_partitions(self.spark)))))
            sorted_by_key = active.repartitionByRange(max(1, -(-n // size)), "pivot", "dist", *_KEY).sortWithinPartitions("pivot", "dist", *_KEY)
            groups = cut(sorted_by_key.mapInArrow(lambda b, size=size: _groups(b, space, size), _GROUPS))
            spans = groups.select("group", F.posexplode(F.arrays_zip("near", "far", "done_near", "done_far", "inner")).alias("pivot", "s")).select("group", "pivot", "s.*")
            meets = (F.col("low") <= F.col("far")) & (F.col("high") >= F.col("near")) & (F.col("high") >= F.col("inner"))
            known = (F.col("low") <= F.col("done_far")) & (F.col("high") >= F.col("done_near"))
            pairs = self.blocks.select("block", "pivot", "low", "high").join(spans, "pivot").filter(meets & ~known).select("group", "block")
            theirs = groups.select("group", "anchors", "tags", "labels", "vectors", "caps", "least")
            stored = self.blocks.select("block", "ids", F.col("labels").alias("block_labels"), F.col("vectors").alias("block_vectors"))
            scored = pairs.join(theirs, "group").join(stored, "block").mapInArrow(lambda b: _scores(b, same, k), "anchor long, tag long, id long, score long")
            every = scored if found is None else scored.unionByName(found).distinct()  # a block may be scanned again with other company
            rank = F.expr(f"row_number() over (partition by {', '.join(_KEY)} order by score desc, id)")
            found = cut(every.withColumn("r", rank).filter(F.col("r") <= k).drop("r"))
            last = found.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("new")).filter(F.col("n") == k)
            active = active.join(last, _KEY, "left").withColumn("kth", F.coalesce("new", "kth"))
            bound = F.when(F.col("new").isNotNull(), F.least(F.col("last"), self._radius(F.col("new").cast("double")) + error)).otherwise(F.col("last"))
            active = active.withColumn("bound", bound).filter(F.col("radius") < F.col("bound"))
            active = active.withColumn("was", F.col("radius")).withColumn("radius", F.least(F.col("bound"), F.greatest(3 * F.col("radius"), F.lit(space.start))))
            active = cut(active.drop("n", "new", "bound"))
        return found if found is not None else self.spark.createDataFrame([], "anchor long, tag long, id long, score long")


def whole_components(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vector array<int>) of the rows that take part: floor(scale * x), one row for each id."""
    wide = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    fine &= ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    bound = F.floor(F.sqrt(F.lit(float(1 << 55)) / F.size("embedding"))).cast("double")  # so that a score times 100 fits in 64 bits
    held = F.transform("embedding", lambda v: F.floor(F.greatest(-bound, F.least(bound, v * scale))).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), wide.alias("embedding"))
    rows = rows.filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.struct("label", held.alias("vector")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.vector")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives in a band below the positive's score.

    ``vectors`` has vec_id, label and embedding; ``anchor`` tells which rows are anchors.  A component becomes
    floor(scale * x); a score is the inner product with the anchor; higher scores come first, ties by smaller vec_id.
    Positives are the first ``positives`` other rows of the anchor's label, negatives the first ``negatives`` rows of other
    labels whose score is ``low`` to ``high`` per cent of the positive's, ends included.  Returns anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score.

    Rows of a null vec_id or label, a null or empty vector, or a component that is null or not finite take no part.  Of
    several rows of one vec_id the least by label and then components takes part, so repeated rows count once.  Only vectors
    of one length are compared; scaled components are held within sqrt(2**55 / length) either way.  Anchors without
    positives, and positives without negatives, give no rows, nor does an empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut(whole_components(vectors, scale))
    results = None
    for (dimension,) in [tuple(r) for r in rows.select(F.size("vector")).distinct().collect()]:  # one, but for mixed tables
        index = KeyIndex(rows.filter(F.size("vector") == dimension), positives)
        anchors = rows.filter((F.size("vector") == dimension) & anchor).withColumnRenamed("vec_id", "anchor")
        unbounded = [F.lit(0).cast("long").alias("tag"), "label", "vector", F.lit(2**60).alias("cap"), F.lit(-(2**60)).alias("least")]
        found = index.search(anchors.select("anchor", *unbounded), True, positives)
        p = F.col("score")
        bands = found.select("anchor", F.col("id").alias("tag"), floor_div(p * high, 100).alias("cap"), (-floor_div(-p * low, 100)).alias("least"))
        bands = bands.filter("least <= cap").join(anchors, "anchor").select(*_KEY, "label", "vector", "cap", "least")
        negative = index.search(bands, False, negatives)
        rank = F.expr("row_number() over (partition by anchor, tag order by score desc, id)")
        positive = found.select("anchor", F.col("id").alias("tag"), F.col("score").alias("positive_score"))
        part = negative.withColumn("rank", rank).join(positive, _KEY).select(
            F.col("anchor").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        results = part if results is None else results.unionByName(part)
    return results if results is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
