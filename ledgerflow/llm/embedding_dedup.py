"""Embedding near-duplicates by inverted lists with product-quantised residuals and an exact rerank.

Vectors are scaled to length 1.  A coarse quantiser deals them to lists; a residual is coded by one byte per subspace.
Both quantisers are fitted on a bounded sample, every vector is indexed.  Two bounds keep the search whole:

* Probes.  If cos(x, y) >= t then |x - y| <= r = sqrt(2 - 2t).  y is in the list of c only if c is its best centroid, so x
  lies within r of the half-space where c beats x's own centroid; x probes exactly the lists for which that holds.  A pair
  is sought in one direction only, from the list with the smaller number.
* Candidates.  The asymmetric distance x . y^ differs from x . y by at most |y - y^|, which is kept with each code; a
  candidate is a pair that may reach t by this bound.

Candidates are reranked by the cosine in double precision.  Links are never written out: a task counts them per vector
and reports a star per connected group.  Lists of many vectors are cut into blocks; a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.components import components
from ledgerflow.llm.runtime import cut, group_bounds, rows_by_key

LISTS = 64
SUBSPACES = 8
CODES = 256
SAMPLE = 20_000
BLOCK = 512
_SLACK = 1e-9


@dataclass
class Index:
    coarse: np.ndarray  # lists x dimension
    books: list[np.ndarray]  # for each subspace, codes x width
    cuts: list[int]

    def __post_init__(self):
        self.apart = np.stack([np.sqrt(((self.coarse - c) ** 2).sum(1)) for c in self.coarse])  # between centroids

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)).argmax(1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of each vector from its reconstruction)."""
        left = x - self.coarse[own]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        for s, book in enumerate(self.books):
            part = left[:, self.cuts[s] : self.cuts[s + 1]]
            codes[:, s] = (part @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
            left[:, self.cuts[s] : self.cuts[s + 1]] -= book[codes[:, s]]
        return codes, np.sqrt((left**2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Which lists can hold a vector within ``radius`` of x (rows x lists), for lists from x's own on."""
        value = x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)
        ahead = value[np.arange(len(x)), own][:, None] - value
        return (ahead <= radius * self.apart[own] + _SLACK) & (np.arange(len(self.coarse))[None, :] >= own[:, None])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        count = np.bincount(at, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, at, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def build_index(x: np.ndarray, seed: int = 5) -> Index:
    """Coarse lists and residual codebooks from unit vectors ``x``; fewer vectors than lists give fewer lists."""
    rng = np.random.default_rng(seed)
    coarse = _kmeans(x, min(LISTS, len(x)), rng)
    dimension = x.shape[1]
    cuts = [round(i * dimension / min(SUBSPACES, dimension)) for i in range(min(SUBSPACES, dimension) + 1)]
    own = (x @ coarse.T - 0.5 * (coarse**2).sum(1)).argmax(1)
    left = x - coarse[own]
    return Index(coarse, [_kmeans(left[:, a:b], min(CODES, len(x)), rng) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts)


def _unit(column: pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)
    # a power of two first, which rounds nothing, so that squares of very large or small components stay numbers
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pairs(rows: pa.Table, a: int, b: int, index: Index, threshold: float, dimension: int) -> tuple[np.ndarray, ...]:
    """Linked (query row, member row) of one block pair, rows numbered from a."""
    member = rows.column("member").slice(a, b - a).to_numpy()
    x = _unit(rows.column("embedding").slice(a, b - a), dimension)
    m, q = np.flatnonzero(member), np.flatnonzero(~member)
    if not len(m) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node = rows.column("vec_id").slice(a, b - a).to_numpy()
    row = rows.column("row").slice(a, b - a).to_numpy()
    here = rows.column("list").slice(a, b - a).to_numpy()
    own = rows.column("own").slice(a, b - a).to_numpy()
    codes, error = index.encode(x[m], here[m])
    close = x[q] @ index.coarse[here[m][0]]
    estimate = np.repeat(close[:, None], len(m), 1)
    for s, book in enumerate(index.books):
        estimate += (x[q][:, index.cuts[s] : index.cuts[s + 1]] @ book.T)[:, codes[:, s]]
    may = estimate + error[None, :] >= threshold - _SLACK
    # within one list a pair shows up in both orders; rows of one id are one vector
    same = own[q] == here[q]
    may &= (node[q][:, None] != node[m][None, :]) & (~same[:, None] | (row[q][:, None] < row[m][None, :]))
    i, j = np.nonzero(may)
    exact = np.zeros(len(i), bool)
    for low in range(0, len(i), 1 << 16):
        at = slice(low, low + (1 << 16))
        exact[at] = np.einsum("nd,nd->n", x[q[i[at]]], x[m[j[at]]]) >= threshold
    return q[i[exact]], m[j[exact]]


def _links(batches: Iterator[pa.RecordBatch], index: Index, threshold: float, dimension: int) -> Iterator[pa.RecordBatch]:
    for rows in rows_by_key(batches, ["label", "list", "i", "j"]):
        rows = rows.combine_chunks()
        cuts = group_bounds(*(rows.column(k).to_numpy() for k in ("label", "list", "i", "j")))
        ids = rows.column("vec_id").to_numpy()
        out_id, out_root, out_n = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p, q = _pairs(rows, a, b, index, threshold, dimension)
            if not len(p):
                continue
            node, back = np.unique(np.concatenate([ids[a + p], ids[a + q]]), return_inverse=True)
            count = np.bincount(back)
            x, y = back[: len(p)], back[len(p) :]
            label = np.arange(len(node))
            while True:
                least = label.copy()
                np.minimum.at(least, x, label[y])
                np.minimum.at(least, y, least[x])
                least = least[least]
                if (least == label).all():
                    break
                label = least
            out_id.append(node)
            out_root.append(node[label])
            out_n.append(count)
        if out_id:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (out_id, out_root, out_n)], ["vec_id", "root", "n"])


def _deal(batches: Iterator[pa.RecordBatch], index: Index, radius: float, dimension: int) -> Iterator[pa.RecordBatch]:
    """Each vector as a member of its list and as a query of the lists it probes."""
    for whole in batches:
        for low in range(0, whole.num_rows, 2000):
            batch = whole.slice(low, 2000)
            x = _unit(batch.column("embedding"), dimension)
            own = index.nearest(x)
            q, to = np.nonzero(index.probes(x, own, radius))
            take = np.concatenate([np.arange(len(x)), q])
            lists = np.concatenate([own, to]).astype(np.int32)
            member = np.concatenate([np.ones(len(x), bool), np.zeros(len(q), bool)])
            at = pa.array(take)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(at) for n in ("vec_id", "label", "row", "embedding")), pa.array(own[take].astype(np.int32)), pa.array(lists), pa.array(member)],
                ["vec_id", "label", "row", "embedding", "own", "list", "member"],
            )


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label are linked if their cosine in double precision is at least ``threshold``.  A vector
    that is null, empty, zero or holds a null or a component that is not finite links with nothing, nor does one of a
    null vec_id (whose component is null, and which is kept).  Vectors of different lengths are never compared.  Rows of
    one vec_id are one vector: they do not link with each other, each is returned, with the links of all of them; where
    they hold different embeddings, a neighbour of several counts once for each.  Components of any finite size are
    compared; a vector of any length is; other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("embedding"))
    fine = rows.filter(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    ).dropDuplicates(["vec_id", "label", "embedding"])
    fine = cut(fine.withColumn("row", F.xxhash64("vec_id", "label", "embedding")))
    found = None
    for (dimension,) in [tuple(r) for r in fine.select(F.size("embedding")).distinct().collect()]:  # one, but for mixed tables
        same = fine.filter(F.size("embedding") == dimension)
        sample = same.orderBy(F.xxhash64(F.col("row")), "row").limit(SAMPLE).select("embedding").toArrow().column("embedding")
        index = build_index(_unit(sample, dimension))
        shared = spark.sparkContext.broadcast(index)
        radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        dealt = same.mapInArrow(
            lambda b, s=shared, d=dimension, r=radius: _deal(b, s.value, r, d), "vec_id long, label long, row long, embedding array<double>, own int, list int, member boolean"
        )
        counts = cut(
            dealt.groupBy("label", "list").agg(
                F.ceil(F.count_if("member") / BLOCK).cast("int").alias("rows_m"), F.ceil(F.count_if(~F.col("member")) / BLOCK).cast("int").alias("rows_q")
            )
        )
        blocks = dealt.join(counts, ["label", "list"]).filter("rows_m > 0 and rows_q > 0")
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("rows_q")).otherwise(F.col("rows_m")) - 1))
        blocks = blocks.withColumn("mine", F.pmod(F.xxhash64("row"), F.when(F.col("member"), F.col("rows_m")).otherwise(F.col("rows_q"))).cast("int")).withColumn("other", other)
        blocks = blocks.select(
            "vec_id", "label", "row", "embedding", "own", "list", "member",
            F.when(F.col("member"), F.col("mine")).otherwise(F.col("other")).alias("i"),
            F.when(F.col("member"), F.col("other")).otherwise(F.col("mine")).alias("j"),
        )
        blocks = blocks.repartition("label", "list", "i", "j").sortWithinPartitions("label", "list", "i", "j")
        part = blocks.mapInArrow(lambda b, s=shared, d=dimension: _links(b, s.value, threshold, d), "vec_id long, root long, n long")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "vec_id long, root long, n long")
    found = cut(found)
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vec_id")
    named = cut(counts.join(roots, "vec_id", "left"))
    component = F.coalesce("root", "vec_id")
    return (
        rows.select("vec_id")
        .join(named, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    )
