"""Exact integer k-means over all vectors, with Hamerly's bounds.

Vectors become integers and are written once, bucketed by row.  After each assignment a table with the same buckets holds,
for each vector, its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to the
second-nearest one.  The next round reads both tables bucket by bucket, without a shuffle, and loosens the bounds by the
centroids' drift; only a vector whose bounds leave its nearest centroid open is compared with all centroids, in exact
integers.  Each task adds up what its moved vectors take from one cluster and give to another, so centroids follow from
sums of a few rows for each task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.runtime import cut, remove, shuffle_partitions, table_path

#: Scaled components are held within these bounds, so that no squared distance leaves 64 bits.
MOST = 1 << 27
_SLACK = 1e-12
_STATE = "row long, kind string, cluster int, upper double, lower double, sums array<long>"


@dataclass
class Clusters:
    rows: DataFrame  # vec_id, cluster, distance (squared)
    centroids: list[list[int]]
    scanned: list[int] = field(default_factory=list)  # vectors compared with all centroids, by assignment


def whole_components(vectors: DataFrame, scale: int, dimension: int) -> DataFrame:
    """(vec_id, vector array<int>): floor(scale * x) of the vectors of that many components, none null or not finite."""
    wide = F.col("embedding").cast("array<double>")
    fine = (F.size("embedding") == dimension) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    bounded = lambda v: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v * scale))
    return vectors.select("vec_id", wide.alias("embedding")).filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("embedding", lambda v: F.floor(bounded(v)).cast("int")).alias("vector"))


def seeds(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of smallest sha256 of ``<seed>:<vec_id>``, in that order; null ids last, ties by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["vector"]) for r in rows.orderBy(key.asc_nulls_last(), "vector").limit(k).collect()]


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors x centroids) of integers."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every sum on the way is a whole number that a double holds
        xs, cs = x.astype(np.float64), centroids.astype(np.float64)
        return ((xs * xs).sum(1)[:, None] - 2 * (xs @ cs.T) + (cs * cs).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


@dataclass
class Step:
    """One assignment: the centroids and, but for the first, how far they moved."""

    centroids: np.ndarray
    drift: np.ndarray | None = None

    def __post_init__(self):
        k = len(self.centroids)
        between = np.sqrt(squared_distances(self.centroids, self.centroids).astype(np.float64))
        between[np.arange(k), np.arange(k)] = np.inf
        self.half = between.min(1) / 2 * (1 - _SLACK)  # nearer to its centroid than this, a vector has no other
        if self.drift is not None:
            others = np.where(np.eye(k, dtype=bool), 0.0, self.drift[None, :])
            self.most_other = others.max(1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest centroid, the smaller number on ties; upper and lower bound) by exact comparison with all."""
        d = squared_distances(x, self.centroids)
        own = d.argmin(1)
        every = np.arange(len(x))
        upper = np.sqrt(d[every, own].astype(np.float64)) * (1 + _SLACK)
        if d.shape[1] == 1:
            return own, upper, np.full(len(x), np.inf)
        second = np.partition(d, 1, axis=1)[:, 1]
        return own, upper, np.sqrt(second.astype(np.float64)) * (1 - _SLACK)

    def open(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The loosened bounds, and which vectors they leave open."""
        upper = (upper + self.drift[cluster]) * (1 + _SLACK)
        lower = lower - self.most_other[cluster] - (np.abs(lower) * _SLACK if len(self.centroids) > 1 else 0)
        return upper, lower, ~(upper < np.maximum(lower, self.half[cluster]))

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State rows for the vectors, and at the end of the task the sums by cluster of what moved: components, vectors,
        and vectors compared with all centroids (under cluster 0).  A sum's row is one of the task's, so it stays in its bucket."""
        sums, some_row = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, row = _matrix(batch, "vector"), batch.column("row").to_numpy()
            if sums is None:
                sums, some_row = np.zeros((len(self.centroids), x.shape[1] + 2), np.int64), int(row[0])
            if self.drift is None:
                cluster, upper, lower = self.scan(x)
                moved = scanned = np.arange(len(x))
            else:
                was = batch.column("cluster").to_numpy()
                upper, lower, doubt = self.open(was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
                cluster, scanned = was.copy(), np.flatnonzero(doubt)
                cluster[scanned], upper[scanned], lower[scanned] = self.scan(x[scanned])
                moved = np.flatnonzero(cluster != was)
                np.add.at(sums[:, :-2], was[moved], -x[moved])
                np.add.at(sums[:, -2], was[moved], -1)
            np.add.at(sums[:, :-2], cluster[moved], x[moved])
            np.add.at(sums[:, -2], cluster[moved], 1)
            sums[0, -1] += len(scanned)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(["state"] * n), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.nulls(n, pa.list_(pa.int64()))],
                ["row", "kind", "cluster", "upper", "lower", "sums"],
            )
        if sums is not None:
            k = len(sums)
            none = pa.nulls(k, pa.float64())
            made = [pa.array([some_row] * k), pa.array(["sums"] * k), pa.array(np.arange(k, dtype=np.int32)), none, none, pa.array(list(sums), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, ["row", "kind", "cluster", "upper", "lower", "sums"])


class Bucketed:
    """Tables of one run in the shared folder, bucketed alike by ``row``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets, self.paths = spark, shuffle_partitions(spark), {}

    def write(self, rows: DataFrame, *parts: str) -> str:
        name = f"ledgerflow_{uuid.uuid4().hex}"
        self.paths[name] = table_path(self.spark, "clustering")
        out = rows.write.format("parquet").bucketBy(self.buckets, "row").sortBy("row").option("path", self.paths[name])
        (out.partitionBy(*parts) if parts else out).saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            remove(self.spark, self.paths.pop(name))


def _totals(state: DataFrame, width: int) -> list[list[int]]:
    """Sums of the tasks' sums, by cluster."""
    parts = state.filter("kind = 'sums'").groupBy("cluster").agg(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
    return [[int(v) for v in r[1:]] for r in sorted(map(tuple, parts.collect()))]


def cluster(rows: DataFrame, centroids: list[list[int]], rounds: int) -> Clusters:
    """Assign and update ``rounds`` times, then assign once more.

    ``rows`` has vec_id and vector (integers, all of one length).  A vector goes to the nearest centroid, on ties the one
    of smaller number; a centroid becomes the componentwise floor of its vectors' mean, and stays where it has none.
    Repeated rows count as often as they occur.  Without rows, or without centroids, there is no result row.
    """
    spark = rows.sparkSession
    tables = Bucketed(spark)
    if not centroids:
        return Clusters(rows.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [])
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).repartition(tables.buckets, "row")
    vectors = tables.write(numbered)

    def both(state: str) -> DataFrame:
        return spark.table(vectors).join(spark.table(state).filter("kind = 'state'").hint("merge"), "row")

    now = np.array(centroids, np.int64)
    step, state = Step(now), None
    held, scanned = None, []
    for at in range(rounds + 1):
        before = spark.table(vectors).select("row", "vector") if state is None else both(state).select("row", "vector", "cluster", "upper", "lower")
        new = tables.write(before.mapInArrow(step.run, _STATE), "kind")
        if state is not None:
            tables.drop(state)
        state = new
        change = _totals(spark.table(state), now.shape[1] + 2)
        held = change if held is None else [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(held, change, strict=True)]
        scanned.append(sum(c[-1] for c in change))
        if at == rounds:
            break
        after = np.array([[s // h[-2] for s in h[:-2]] if h[-2] else list(map(int, old)) for h, old in zip(held, now, strict=True)], np.int64)
        if (after == now).all():
            break
        drift = np.sqrt(((after - now).astype(np.float64) ** 2).sum(1)) * (1 + _SLACK)
        now, step = after, Step(after, drift)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch, "vector"), batch.column("cluster").to_numpy()
            d = ((x - now[own]) ** 2).sum(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    final = cut(both(state).select("vec_id", "vector", "cluster").mapInArrow(distances, f"vec_id {kind}, cluster int, distance long"))
    tables.drop(state, vectors)
    return Clusters(final, now.tolist(), scanned)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dimension: int = 64, seed: int = 3) -> DataFrame:
    """One row per vector of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another number of components, null ones and those with a null or a component that is not finite are left
    out.  Components become floor(scale * x), held within 2**27 either way.  Vectors of a null vec_id take part, as seeds
    only where fewer than ``k`` others are there; rows of one id are each a vector.  With fewer vectors than ``k`` there
    are as many clusters as vectors, equal ones leaving the later clusters empty.  Other columns are not read; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = whole_components(vectors, scale, dimension)
    found = cluster(rows, seeds(rows, k, seed), rounds)
    inertia = {r["cluster"]: int(r["total"]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    facts = spark.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), digest[c]) for c in range(len(digest))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
